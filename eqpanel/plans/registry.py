"""Registering queries next to the rounding both sides of a comparison use."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    digits: dict[str, int]


QUERIES: dict[str, Entry] = {}
ORACLES: dict[str, str] = {}


def _digits(spec: str) -> dict[str, int]:
    return {w.split(":")[0]: int(w.split(":")[1]) if ":" in w else 6 for w in spec.split()}


def query(name: str, floats: str = "") -> Callable[[Query], Query]:
    """Register a query. ``floats`` lists its double columns, ``name:digits`` or 6."""
    digits = _digits(floats)

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Entry(lambda spark, sf_dir: settle(fn(spark, sf_dir), digits), digits)
        return fn

    return register


def settle(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Whole numbers as bigint, doubles rounded (and -0.0 made 0.0)."""
    cols = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = f"bigint({c}) AS {c}"
        elif isinstance(f.dataType, T.DoubleType):
            unit = f"1e{digits.get(f.name, 6)}D"
            c = f"rint({c} * {unit}) / {unit} + 0.0D AS {c}"
        cols.append(c)
    return df.selectExpr(*cols)


def oracle(name: str, ctes: str, body: str) -> None:
    """Register the SQL of a query: shared CTEs, its body, then the rounding."""
    digits = QUERIES[name].digits
    rounded = ", ".join(f"round_even({c}::DOUBLE * 1e{d}, 0) / 1e{d} + 0.0 AS {c}" for c, d in digits.items())
    pick = f"* REPLACE ({rounded})" if rounded else "*"
    head = "WITH RECURSIVE " + ctes + ",\n" if ctes else "WITH "
    ORACLES[name] = f"{head}answer AS (\n{body}\n)\nSELECT {pick} FROM answer"
