"""All registered queries and their SQL answers."""

from __future__ import annotations

import importlib

from eqpanel.plans.registry import ORACLES, QUERIES

AREAS = ("market", "signal", "quality", "validation", "ingest", "profile", "research", "structure", "policy")

for _area in AREAS:
    importlib.import_module(f"eqpanel.plans.{_area}_queries")
    importlib.import_module(f"eqpanel.plans.{_area}_oracles").register()

__all__ = ["ORACLES", "QUERIES"]
