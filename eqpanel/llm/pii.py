"""Personal data: patterns, and terms that disclose it.

Patterns give the protected entities. A term is a word that stands on a line
with an entity, near it. Over the lines of the whole corpus it is counted how
often a term stands with an entity, how often each stands at all, and so how
many bits the term tells about the entity (pointwise mutual information) and
which share of its lines show that entity. Terms above both thresholds are
removed or, where they hold digits, generalised to their shape.

Null and empty texts have no spans. Repeated rows count, and are answered, each.
The terms found are broadcast up to ``BROADCAST_TERMS``; beyond that a join
brings each document the terms it holds.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eqpanel.functions.checkpoints import checkpointed
from eqpanel.llm.common import SLICE_ROWS, alone, each_row, table, vacate

KINDS = ["email", "ip", "card", "phone", "term"]
NEAR = 40
#: Lines a term must share with one entity, the share of its own lines that is, and the bits it must tell.
SUPPORT, DISCLOSURE, BITS = 2, 0.8, 2.0
#: Stands for "any line" among the counts; no word can be it.
LINE = "\n"
BROADCAST_TERMS = 50_000
TASK_TERMS = 200_000
_RIGHT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can begin only where a run of digits begins, so the look-behind loses none.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")
_WORD = re.compile(r"[^\W_]{4,}")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) <= 3 and int(p or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every entity, by kind, then place."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _RIGHT.match(text, at) if s < at else None
        if m:
            out.append((0, s, m.end()))
        # what stands left of this @ cannot be part of a later address
        done = m.end() if m else at + 1
        at = text.find("@", done)
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_part, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def _near_terms(text: str, spans: list[tuple[int, int, int]]) -> set[tuple[int, str, int]]:
    """(line, term, entity): words within ``NEAR`` characters of an entity, on its line; and the entity itself as ``LINE``."""
    out = set()
    for kind, s, e in spans:
        who = int.from_bytes(hashlib.blake2b(f"{kind}:{text[s:e]}".encode(), digest_size=8).digest(), "big", signed=True)
        line = text.rfind("\n", 0, s) + 1
        out.add((line, LINE, who))
        a = max(s - NEAR, line)
        stop = text.find("\n", e)
        b = min(e + NEAR, stop if stop >= 0 else len(text))
        for m in _WORD.finditer(text, a, b):
            edge = m.start() == a and a > 0 and text[a - 1].isalnum() or m.end() == b and b < len(text) and text[b].isalnum()
            if not edge and not any(x < m.end() and m.start() < y for _, x, y in spans):
                out.add((line, m[0].lower(), who))
    return out


def disclosing(docs: DataFrame) -> DataFrame:
    """(term) that reveal an entity, from counts of lines over all documents.

    A term is named when, for one entity, it stands near it on ``SUPPORT`` lines,
    on at least ``DISCLOSURE`` of all its own lines, and that tells at least
    ``BITS`` bits: log2 of P(entity | term) over P(entity).
    """

    def pairs():
        def row(text):
            spans = base_spans(text) if text else ()
            return [(term, who) for _, term, who in _near_terms(text, spans)] if spans else ()

        return row

    together = checkpointed(each_row(docs, ["text"], pairs, "term string, who long").groupBy("term", "who").agg(F.count("*").alias("shown")))
    entities = together.filter(F.col("term") == LINE).select("who", F.col("shown").alias("lines_of"))
    near = together.filter((F.col("term") != LINE) & (F.col("shown") >= SUPPORT))
    candidates = checkpointed(near.select("term").distinct())
    if candidates.isEmpty():
        return candidates

    def counts(batches):
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
            seen.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for text in batch.column(0).slice(at, SLICE_ROWS).to_pylist():
                    for line in (text or "").lower().split("\n"):
                        seen[LINE] += 1
                        seen.update(set(_WORD.findall(line)))
                    if len(seen) > TASK_TERMS:
                        yield flush()
        yield flush()

    asked = candidates.unionByName(docs.sparkSession.range(1).select(F.lit(LINE).alias("term")))
    everywhere = checkpointed(docs.select("text").mapInArrow(alone(counts), "term string, n long").join(asked, "term", "leftsemi").groupBy("term").agg(F.sum("n").alias("n")))
    lines = everywhere.filter(F.col("term") == LINE).select(F.col("n").alias("lines"))  # one row
    judged = near.join(everywhere, "term").join(entities, "who").join(F.broadcast(lines))
    share = F.col("shown") / F.col("n")
    told = F.log2(share * F.col("lines") / F.col("lines_of"))
    return checkpointed(judged.filter((share >= DISCLOSURE) & (told >= BITS)).select("term").distinct())


def _with_terms(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, frozenset]:
    """``docs`` with a column ``__terms``, and the terms all rows share."""
    few = terms.limit(BROADCAST_TERMS + 1).collect()
    none = F.expr("cast(null as array<string>)")
    if len(few) <= BROADCAST_TERMS:
        return docs.withColumn("__terms", none), frozenset(r.term for r in few)
    keyed = docs.withColumn("__text_hash", F.xxhash64("text"))
    words = each_row(keyed, ["__text_hash", "text"], lambda: lambda h, t: [(h, w) for w in set(_WORD.findall((t or "").lower()))], "__text_hash long, term string")
    held = words.distinct().join(terms, "term", "leftsemi").groupBy("__text_hash").agg(F.collect_list("term").alias("__terms"))
    return keyed.join(held, "__text_hash", "left").drop("__text_hash"), frozenset()


def all_spans(text: str, terms: frozenset | set) -> tuple[list, list]:
    base = base_spans(text)
    if not terms:
        return base, base
    more = [(4, m.start(), m.end()) for m in _WORD.finditer(text) if m[0].lower() in terms]
    return base, base + [t for t in more if not any(x < t[2] and t[1] < y for _, x, y in base)]


def sanitised(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Text with entities named by kind; a term with digits keeps its shape, any other goes."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < at:
            if e > at:
                at = e
            continue
        shape = re.sub("[0-9]", "0", text[s:e]) if kind == 4 and re.search("[0-9]", text[s:e]) else f"[{KINDS[kind].upper()}]"
        out += [text[at:s], shape]
        at = e
    return "".join(out) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """Counts and spans of every row."""
    given, shared = _with_terms(docs.select("doc_id", "text"), disclosing(docs))

    def make():
        def row(doc_id, text, own):
            base, every = all_spans(text or "", set(own) if own else shared)
            shown = [",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in x) for x in (base, every)]
            return ((doc_id, *(sum(k == i for k, _, _ in base) for i in range(4)), hashlib.sha256(shown[0].encode()).hexdigest(), shown[1]),)

        return row

    return each_row(given, ["doc_id", "text", "__terms"], make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def clean_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with sanitised texts; null texts stay null."""
    from pyspark.sql.functions import pandas_udf

    given, shared = _with_terms(docs, disclosing(docs))

    @pandas_udf("string")
    def cleaned(text, own):
        import pandas as pd

        vacate()
        return pd.Series([None if t is None else sanitised(t, all_spans(t, set(o) if o is not None and len(o) else shared)[1]) for t, o in zip(text, own, strict=True)], dtype=object)

    return given.withColumn("text", cleaned("text", "__terms")).select(*docs.columns)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
