"""Licence notices by template markup compiled into token automata.

A template is mandatory wording with two kinds of regions: ``[[...]]`` may be
absent and ``{{lo,hi}}`` stands for lo to hi words of any kind. It is compiled
into a non-deterministic automaton over words; a label is given where the
automaton accepts, so all mandatory words must be there, in order, exactly.

Null and empty texts give zero counts, no labels and score 0. Repeated rows
each give their row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from eqpanel.llm.common import each_row, table, utf8

#: Phrases and labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "mit": "[[released]] under the mit license",
    "apache-2.0": "licensed under the apache license [[version]] 2 0",
    "gpl": "licensed under the [[gnu]] general public license [[version {{1,1}}]]",
    "lgpl": "licensed under the [[gnu]] lesser general public license",
    "cc-by": "licensed under [[a]] [[the]] creative commons attribution {{0,3}} license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "reserved": "copyright {{0,8}} all rights reserved",
}
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+),(\d+)\}\}|[^\s\[\]{}]+")


class Automaton:
    """States 0..n; ``steps[s]`` is (word or None for any word, next state); ``free[s]`` are moves without a word."""

    def __init__(self, template: str):
        self.steps: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[set[int]] = [set()]
        opened = []
        #: Words outside optional regions: each stands in whatever is accepted.
        self.needed: set[bytes] = set()
        for m in _MARK.finditer(template):
            here = len(self.steps) - 1
            if m[0] == "[[":
                opened.append(here)
            elif m[0] == "]]":
                self.free[opened.pop()].add(here)
            elif m[1]:
                for k in range(int(m[2])):
                    self._add(None)
                    if k >= int(m[1]):
                        self.free[len(self.steps) - 2].add(len(self.steps) - 1)
            else:
                self._add(m[0].encode())
                if not opened:
                    self.needed.add(m[0].encode())
        self.last = len(self.steps) - 1
        self.starts = {w for s in self._closed({0}) for w, _ in self.steps[s]}
        #: A template may begin with a word of any kind; then every place can be its first.
        self.anywhere = None in self.starts

    def _add(self, word: bytes | None) -> None:
        self.steps[-1].append((word, len(self.steps)))
        self.steps.append([])
        self.free.append(set())

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            new = self.free[todo.pop()] - states
            states |= new
            todo += new
        return states

    def accepts(self, words: list[bytes], at: int) -> int:
        """Words read by the longest accepted run from ``at``; 0 if none."""
        states, best, i = self._closed({0}), 0, at
        while states:
            if self.last in states:
                best = i - at
            if i == len(words):
                break
            states = self._closed({t for s in states for w, t in self.steps[s] if w is None or w == words[i]})
            i += 1
        return best


def scanner():
    phrases = [(p.encode().split(), label, re.compile(rb"(?<![^ ])" + p.encode().replace(b" ", rb" +") + rb"(?![^ ])")) for p, label in PHRASES.items()]
    machines = [(label, Automaton(t)) for label, t in TEMPLATES.items()]
    anchors = {label: max(sorted(a.needed), key=len, default=b"") for label, a in machines}

    def row(doc_id, text):
        flat = utf8(text).translate(_TABLE)
        words = flat.split()
        places, base = [], set()
        for parts, label, at in phrases:
            for m in at.finditer(flat) if parts[-1] in flat else ():
                places.append(len(flat[: m.start()].split()))
                base.add(label)
        found = set()
        for label, a in machines:
            if anchors[label] in flat and (a.anywhere or any(w in flat for w in a.starts)):
                if any((a.anywhere or w in a.starts) and a.accepts(words, i) for i, w in enumerate(words)):
                    found.add(label)
        score = 1.0 if found else 0.5 if base else 0.0
        yield doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score

    return row


def scan(docs: DataFrame) -> DataFrame:
    """Counts, places, labels and score: 1 for an accepted template, a half for a phrase alone."""
    return each_row(docs, ["doc_id", "text"], scanner, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
