"""Substring deduplication by sliding spans of sentences.

A text is cut after ``.``, ``!``, ``?`` and line ends, and within a sentence
wherever a word's hash is the smallest of some ``NEAR`` words in a row (the last
of equals). Such a cut depends on fewer than ``NEAR`` words on either side and
comes every ``NEAR`` words at least, so a passage is cut alike in all documents,
wherever it begins. From every sentence a run goes on until it has ``RUN``
sentences and ``LEAST`` words, and likewise back from every sentence; both are
hashed (case and spacing aside). Of all places of a hash in the corpus the first
(by doc_id, then place) stays; sentences that any other place covers are removed.

A passage of 4 * NEAR + LEAST - 3 = 48 words or more holds a run wherever it stands.
Its words before the first common cut and after the last one stay.

Null and empty texts stay as they are. Rows alike in doc_id and text are one
document and keep or lose the same sentences.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eqpanel.llm.common import alone, table, vacate

RUN, LEAST, NEAR = 2, 15, 9
#: Runs compared within a task before they are sent on (about 100 bytes each).
BLOCK_RUNS = 1 << 20
_LOW = 0xFFFFFFFF
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+\Z")
_WORD = re.compile(r"\S+\s*")


def sentences(text: str) -> list[str]:
    """Pieces that join to ``text``."""
    words, closing, sentence = [], [], []
    for m in _SENTENCE.finditer(text):
        own = _WORD.findall(m[0])
        if own:
            own[0] = m[0][: len(m[0]) - sum(map(len, own))] + own[0]
        words += own or [m[0]]
        sentence += [len(closing)] * max(len(own), 1)
        closing.append(len(words) - 1)
    if len(words) >= NEAR:
        closing = sorted({*closing, *_smallest(words, sentence)})
    return ["".join(words[a + 1 : b + 1]) for a, b in zip([-1, *closing], closing)]


def _smallest(words: list[str], sentence: list[int]) -> list[int]:
    """Places of the last smallest hash of each ``NEAR`` words in a row of one sentence."""
    hashes = np.fromiter((zlib.crc32(w.strip().lower().encode()) for w in words), np.int64, len(words))
    of = np.array(sentence)
    whole = np.flatnonzero(of[: len(of) - NEAR + 1] == of[NEAR - 1 :])
    windows = np.lib.stride_tricks.sliding_window_view(hashes, NEAR)[whole]
    return (whole + NEAR - 1 - windows[:, ::-1].argmin(axis=1)).tolist()


def runs(text: str, run: int = RUN, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(hash, first sentence, last sentence) of the shortest long enough run from, and up to, every sentence."""
    places, starts, words = [], [0], []
    for i, s in enumerate(sentences(text)):
        if ws := s.lower().split():
            places.append(i)
            words += ws
            starts.append(len(words))
    found, k = set(), 0
    for end in range(run, len(places) + 1):
        # the latest start is the shortest run up to here; starts passed over have their shortest run here too
        while k + run <= end and starts[end] - starts[k] >= least:
            found.add((k, end))
            k += 1
        if k and starts[end] - starts[k - 1] >= least:
            found.add((k - 1, end))
    out = []
    for k, end in sorted(found):
        h = hashlib.blake2b(" ".join(words[starts[k] : starts[end]]).encode(), digest_size=8).digest()
        out.append((int.from_bytes(h, "big", signed=True), places[k], places[end - 1]))
    return out


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First place of each hash of a block of runs, and what the others certainly cover.

    A place that has another before it in its block is not the first of all, so
    only the block's first ones have to meet those of other blocks. The rest are
    united to intervals of their documents.
    """
    names = ["certain", "key", "doc_id", "text_hash", "span"]
    ids, hashes, of, keys, spans = [], [], array("q"), array("q"), array("q")

    def block() -> pa.RecordBatch:
        null = np.array([d is None for d in ids], bool)
        doc, text, row = np.array([d or 0 for d in ids], np.int64), np.array(hashes, np.int32), np.array(of, np.int64)
        key, span = np.array(keys, np.int64), np.array(spans, np.int64)
        by = np.lexsort((span, text[row], doc[row], ~null[row], key))
        row, key, span = row[by], key[by], span[by]
        new = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        same = (span == span[first]) & (doc[row] == doc[row[first]]) & (text[row] == text[row[first]]) & (null[row] == null[row[first]])
        over = np.sort(row[~same] << 32 | span[~same] >> 32), (row[~same] << 32 | span[~same] & _LOW)[np.argsort(row[~same] << 32 | span[~same] >> 32, kind="stable")]
        reach = np.maximum.accumulate(over[1]) if len(over[1]) else over[1]
        opens = np.append(True, over[0][1:] > reach[:-1]) if len(reach) else np.zeros(0, bool)
        start, end = over[0][opens], reach[np.append(opens[1:], True)] if len(reach) else reach
        sure_row, sure_span = start >> 32, (start & _LOW) << 32 | end & _LOW
        all_rows = np.concatenate([row[new], sure_row])
        # certain rows meet no others; any spread key will do
        spread = (doc[sure_row] * np.int64(2654435761)) ^ sure_span
        out = pa.RecordBatch.from_arrays([
            pa.array(np.arange(len(all_rows)) >= new.sum()), pa.array(np.concatenate([key[new], spread])), pa.array(doc[all_rows], mask=null[all_rows]),
            pa.array(text[all_rows]), pa.array(np.concatenate([span[new], sure_span])),
        ], names)
        for held in (ids, hashes, of, keys, spans):
            del held[:]
        return out

    for batch in batches:
        for d, t, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = runs(x) if x else []
            if found:
                ids.append(d)
                hashes.append(t)
                for h, a, b in found:
                    of.append(len(ids) - 1)
                    keys.append(h)
                    spans.append(a << 32 | b)
            if len(keys) >= BLOCK_RUNS:
                yield block()
    if keys:
        yield block()


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans): for each document that loses any, spans (first << 32 | last) of sentences to remove.

    One exchange by hash: a hash brings at most one row per block of runs,
    however many places it has, so a passage of many documents is no hot key.
    """
    keyed = docs.select("doc_id", F.hash("text").alias("text_hash"), "text")
    rows = keyed.mapInArrow(alone(_places), "certain boolean, key long, doc_id long, text_hash int, span long")
    # rows alike in all of doc_id, text and span are one place and share the first rank
    rank = F.rank().over(Window.partitionBy("certain", "key").orderBy("doc_id", "text_hash", "span"))
    later = rows.withColumn("k", rank).filter("certain or k > 1")
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with texts free of repeated spans, and ``__removed``, the sentences lost."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("text string, removed long")
    def without(text, spans):
        vacate()

        def one(t, spans):
            if t is None or spans is None:
                return t, 0
            lost = {i for s in spans for i in range(s >> 32, (s & _LOW) + 1)}
            return "".join(s for i, s in enumerate(sentences(t)) if i not in lost), len(lost)

        return pd.DataFrame([one(t, s) for t, s in zip(text, spans, strict=True)], columns=["text", "removed"])

    names = docs.columns
    gone = covered(docs).select(F.struct("doc_id", "text_hash").alias("__doc"), F.col("spans").alias("__spans"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.struct("doc_id", F.hash("text").alias("text_hash")).alias("__key"))
    joined = own.join(gone, F.col("__key").eqNullSafe(F.col("__doc")), "left").withColumn("__new", without("__row.text", "__spans"))
    return joined.select(*[(F.col("__new.text") if c == "text" else F.col("__row")[c]).alias(c) for c in names], F.col("__new.removed").alias("__removed"))


def op2_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__removed").alias("n_removed"), "text")
