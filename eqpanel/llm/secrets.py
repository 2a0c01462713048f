"""Secrets by patterns and sliding-window entropy, in DataFrame functions only.

A text is split by a pattern and, beside it, the matches are taken; lengths of
the pieces give the places. Candidate strings are runs of key characters; a
window slides over each and the entropy of its character class is kept by
changing two counts per step. Windows above the class's threshold make the run
a span of kind ``entropy``, unless the allow-list names it. The allow-list never
touches the fixed kinds.

Null and empty texts have no spans. Repeated rows each give their row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eqpanel.llm.common import table

#: Pattern and least length, by kind. A kind's least length is checked after matching where a shorter match hides a later one.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Candidate characters lie between "+" and "z".
SLOT, SLOTS = ord("+"), ord("z") - ord("+") + 1
#: Bits per character a window must exceed, by class.
THRESHOLDS = {"hex": 3.0, "base64": 3.9}
#: Identifiers that look random but open nothing: UUIDs, plain words and paths, integrity hashes.
ALLOW = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[^0-9]+$|^[0-9_=+/-]+$|^sha(256|384|512)-|(?i)example|abcdefghij|0123456789"


def _places(text: Column, pattern: str) -> Column:
    """Array of (start, end, match); Catalyst shares the two passes."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.arrays_zip(lengths.alias("before"), found.alias("hit"))
    step = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,hit:string>>)").alias("out")),
        lambda acc, x: F.when(x["hit"].isNull(), acc).otherwise(
            F.struct(
                (acc["at"] + x["before"] + F.length(x["hit"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["before"]).alias("s"), (acc["at"] + x["before"] + F.length(x["hit"])).alias("e"), x["hit"].alias("hit")))).alias("out"),
            )
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(pattern), step).otherwise(F.expr("cast(array() as array<struct<s:int,e:int,hit:string>>)"))


def _peak(hit: Column) -> Column:
    """Largest window entropy in bits; each step changes two counts, whatever the length.

    The counts, their sum of c * log2(c) and the best so far are bound by the fold,
    and the characters of a step come from arrays made once, so that a step's
    work depends on the number of classes only.
    """
    codes = F.transform(F.split(hit, ""), lambda c: F.ascii(c) - SLOT)
    n = F.size(codes)
    leaving = F.concat(F.array_repeat(F.lit(-1), WINDOW), F.slice(codes, F.lit(1), F.greatest(n - WINDOW, F.lit(0))))
    steps = F.arrays_zip(codes.alias("new"), leaving.alias("old"), F.sequence(F.lit(1), n).alias("at"))
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])

    def step(acc: Column, x: Column) -> Column:
        new, old, counts = x["new"], x["old"], acc["counts"]
        gain = F.get(weight, F.get(counts, new) + 1) - F.get(weight, F.get(counts, new))
        loss = F.when(old >= 0, F.get(weight, F.get(counts, old)) - F.get(weight, F.get(counts, old) - 1)).otherwise(F.lit(0.0))
        total = F.when(new == old, acc["sum"]).otherwise(acc["sum"] + gain - loss)
        moved = F.transform(counts, lambda c, k: F.when(k == new, c + 1).when(k == old, c - 1).otherwise(c))
        best = F.when(x["at"] >= WINDOW, F.greatest(acc["best"], F.lit(math.log2(WINDOW)) - total / WINDOW)).otherwise(acc["best"])
        return F.struct(F.when(new == old, counts).otherwise(moved).alias("counts"), total.alias("sum"), best.alias("best"))

    zero = F.struct(F.array_repeat(F.lit(0), SLOTS).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    return F.aggregate(steps, zero, step, lambda acc: acc["best"])


def scan(docs: DataFrame) -> DataFrame:
    """Counts by kind and all spans of every row, places in code points."""
    text = F.coalesce("text", F.lit(""))
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,stop:int>>)")

    def spans(places: Column, kind: str) -> Column:
        return F.transform(places, lambda p: F.struct(p["s"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), p["e"].alias("stop")))

    found = docs.select(
        "doc_id",
        F.filter(_places(text, ASSIGN), lambda p: F.length(F.regexp_extract(p["hit"], ASSIGN_VALUE, 1)) >= ASSIGN_LEAST).alias("assign"),
        _places(text, ACCESS).alias("access"),
        _places(text, HEX).alias("hex"),
        F.filter(_places(text, CANDIDATE), lambda p: ~p["hit"].rlike(ALLOW)).alias("candidates"),
    )
    scored = found.withColumn(
        "entropy",
        F.filter("candidates", lambda p: F.when(p["hit"].rlike("^[0-9a-fA-F]+$"), _peak(p["hit"]) > THRESHOLDS["hex"]).otherwise(_peak(p["hit"]) > THRESHOLDS["base64"])),
    )
    base = F.array_sort(F.concat(empty, *[spans(F.col(k), k) for k in KINDS[:3]]))
    every = F.array_sort(F.concat(empty, *[spans(F.col(k), k) for k in KINDS]))
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(places: Column) -> Column:
        return F.array_join(F.transform(places, lambda p: F.concat_ws(":", F.element_at(names, p["rank"] + 1), p["start"].cast("string"), p["stop"].cast("string"))), ",")

    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scored.select("doc_id", *sizes, F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
