"""Rule statistics judged by an isolation forest.

The forest judges what the base rule lets pass, and is fitted on such rows only,
of at most ``SAMPLE`` labelled documents (lowest hashes of doc_id). Its trees
hold the good rows, but split the box around the rows of both labels: a
statistic that never changes among good rows still gets splits, and what stands
where no good row does ends on a short path. The threshold on the path score is
calibrated on the same rows: the one that separates the two labels best while it
rejects at most ``CLEAN_LOSS`` of those labelled good.

Null and empty texts hold no words and fail the base rule. Only the base rule
decides unless labelled rows of both kinds pass it. Repeated rows each give their
row; null labels or ids are left out of the fit.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eqpanel.llm.common import each_row, table, vacate

#: Bound of the labelled rows the forest is fitted on.
SAMPLE = 4000
TREES, SUBSAMPLE, DEPTH = 64, 256, 8
CLEAN_LOSS = 0.002
_STRIP = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))
_SYMBOLS = b"#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_caps long"


def stats(text: str | None) -> tuple[int, ...]:
    """Words, code points in words, symbols, repeated lines, words in repeated 3-word windows, lines, capitals."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    lines = Counter(line for line in data.split(b"\n") if line.strip())
    repeat = 0
    if n > 3:
        first: dict[bytes, int] = {}
        ids = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
        windows = _triples(ids)
        _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(counts[back.ravel()] > 1)
        mark = np.zeros(n, bool)
        for k in range(3):
            mark[hit + k] = True
        repeat = int(mark.sum())
    n_lines = sum(lines.values())
    caps = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return n, len(text.translate(_STRIP)) if not text.isascii() else sum(map(len, words)), len(data) - len(data.translate(None, _SYMBOLS)), n_lines - len(lines), repeat, n_lines, caps


def _triples(ids: np.ndarray) -> np.ndarray:
    """One number per window of three, equal only for equal windows."""
    pair = ids[:-1] * len(ids) + ids[1:]
    _, pair = np.unique(pair, return_inverse=True)
    return pair.ravel()[:-1] * len(ids) + ids[2:]


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def features(s: tuple[int, ...]) -> np.ndarray:
    """Logarithms, so that a few extreme rows do not take all splits of a heavy-tailed share."""
    n, chars, symbols, dup, repeat, lines, caps = s
    n, chars = max(n, 1), max(chars, 1)
    return np.log1p([n, chars / n, 1000 * symbols / n, 100 * dup / max(lines, 1), 100 * repeat / n, 1000 * caps / chars])


def _harmonic(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Complete binary trees as arrays; a leaf's split is infinite and holds its path length.

    Splits are drawn from the box ``low`` to ``high``, halved on the way down, not from the range of ``rows``.
    """

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        nodes = 2 ** (DEPTH + 1)
        self.column = np.zeros((TREES, nodes), np.int64)
        self.split = np.full((TREES, nodes), np.inf)
        self.path = np.zeros((TREES, nodes))
        size = min(SUBSAMPLE, len(rows))
        for t in range(TREES):
            self._grow(t, 1, 0, rows[rng.choice(len(rows), size, replace=False)], low, high, rng)
        self.norm = max(_harmonic(size), 1e-9)

    def _grow(self, t: int, node: int, depth: int, rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> None:
        open_ = np.flatnonzero(high > low) if len(rows) > 1 else ()
        if depth == DEPTH or not len(open_):
            at = node
            for d in range(depth, DEPTH + 1):
                self.path[t, at : at + 2 ** (d - depth)] = depth + _harmonic(len(rows))
                at *= 2
            return
        c = rng.choice(open_)
        self.column[t, node] = c
        self.split[t, node] = s = rng.uniform(low[c], high[c])
        at = np.arange(len(low)) == c
        self._grow(t, 2 * node, depth + 1, rows[rows[:, c] <= s], low, np.where(at, s, high), rng)
        self._grow(t, 2 * node + 1, depth + 1, rows[rows[:, c] > s], np.where(at, s, low), high, rng)

    def score(self, row: np.ndarray) -> float:
        trees, at = np.arange(TREES), np.ones(TREES, np.int64)
        for _ in range(DEPTH):
            at = 2 * at + (row[self.column[trees, at]] > self.split[trees, at])
        return float(2 ** (-self.path[trees, at].mean() / self.norm))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Forest, float] | None:
    """Forest and threshold, or None unless labelled rows of both kinds pass the base rule."""
    picked = labels.select("doc_id", "quality").dropna().dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    known = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    measured = each_row(known, ["doc_id", "quality", "text"], lambda: lambda d, q, t: ((d, q) + stats(t),), "doc_id long, quality long, " + STATS)
    rows = measured.groupBy("doc_id").agg(F.min(F.struct(*[c for c in measured.columns if c != "doc_id"])).alias("s")).orderBy("doc_id").collect()
    passing = [tuple(r.s) for r in rows if not base_failed(r.s.n_words, r.s.n_repeat_words)]
    return calibrated([s[1:] for s in passing], np.array([s[0] == 1 for s in passing], bool))


def calibrated(rows: list[tuple[int, ...]], good: np.ndarray) -> tuple[Forest, float] | None:
    """Forest and threshold from the statistics of labelled rows that pass the base rule."""
    if not good.any() or good.all():
        return None
    points = np.array([features(s) for s in rows])
    forest = Forest(points[good], points.min(axis=0), points.max(axis=0))
    scores = np.array([forest.score(p) for p in points])
    floor = float(np.quantile(scores[good], 1 - CLEAN_LOSS, method="higher"))
    best = max((float((scores[~good] > c).mean() - (scores[good] > c).mean()), c) for c in {floor, *scores[scores >= floor].tolist()})
    return forest, best[1]


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict of every row."""
    model = fit(docs, labels)

    def make():
        def row(doc_id, text):
            s = stats(text)
            failed = base_failed(s[0], s[4])
            odd = model is not None and not failed and model[0].score(features(s)) > model[1]
            return ((doc_id, *s[:5], failed, not failed and not odd),)

        return row

    return each_row(docs, ["doc_id", "text"], make, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def kept_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass; no shuffle, every row is judged in place."""
    import pyspark.sql.types as T
    from pyspark.sql.functions import pandas_udf

    model = fit(docs, labels)

    @pandas_udf(T.BooleanType())
    def passes(text):
        vacate()

        def one(t):
            s = stats(t)
            return not base_failed(s[0], s[4]) and not (model is not None and model[0].score(features(s)) > model[1])

        return text.map(one).astype(bool)

    return docs.filter(passes(F.coalesce("text", F.lit(""))))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
