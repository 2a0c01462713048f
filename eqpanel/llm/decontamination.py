"""Benchmark decontamination by a distributed positional inverted index.

``postings`` stores one row per place of a word in a training text. A test text
is cut into windows of ``WINDOW`` words (a shorter one is a single window). The
words of a window are ordered from the rarest in the corpus; the list of the
rarest, shifted by the word's offset, gives the alignments (document, shift) of
the test text, the list of the next rarest thins them, and the remaining lists
are intersected at those alignments only. Windows of one test text that start
from the same place share their alignments, so a window is never repeated for
each of its words. ``phrases`` returns the matched stretches, ``proximity`` the
places where several words stand close together in any order.

Only DataFrame functions are used. Test words, anchors and alignments are
written before they are used; the planner broadcasts such a table when its size
on disk is below its threshold and otherwise shuffles (AQE splits a hot word).
Joins on (document, place) have no hot key, however frequent a word or however
long a text is.

Null and empty texts have no words, so they get zeros; test texts without words
occur nowhere. Repeated rows each get their row. Rows that share a doc_id but
not the text are told apart by a hash of the text. A null doc_id is a value of
its own; a null item_id counts as one item named by the empty string. Other
columns are never read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eqpanel.functions.checkpoints import checkpointed
from eqpanel.llm.common import table

WINDOW = 10
#: Fixed value: what separates words, capitals aside (they are lowered first).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_CHARS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
DOC = ["doc", "text_hash"]


def words_of(text: Column) -> Column:
    """Array of the words of a text, A-Z lowered and nothing else."""
    plain = F.coalesce(text, F.lit(""))
    lowered = F.when(F.length(plain) == F.octet_length(plain), F.lower(plain)).otherwise(
        F.translate(plain, string.ascii_uppercase, string.ascii_lowercase)
    )
    inner = F.btrim(lowered, F.lit(GAP_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, its key (a null id told from 0 by the hash) and text."""
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("doc"), F.xxhash64("text", F.col("doc_id").isNull()).alias("text_hash"), "text")


def postings(docs: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(word, doc, text_hash, place) of every word of ``docs``, or only of the distinct ``words(word)``."""
    rows = _documents(docs).select(*DOC, F.posexplode(words_of(F.col("text"))).alias("place", "word"))
    rows = rows if words is None else rows.join(words, "word")
    return rows.select("word", *DOC, "place")


def _planned(tests: DataFrame, index: DataFrame, size: int) -> DataFrame:
    """Test words (item, length, place, word) with ``order``: the places of the window that starts here, rarest first."""
    counts = index.groupBy("word").agg(F.count("*").alias("n"))
    w = Window.partitionBy("item").orderBy("place").rowsBetween(0, size - 1)
    order = F.transform(F.sort_array(F.collect_list(F.struct("n", "place")).over(w)), lambda x: x["place"])
    starts = F.col("place") <= F.greatest(F.col("length") - size, F.lit(0))
    return tests.join(counts, "word", "left").fillna(0, ["n"]).select("item", "length", "place", "word", F.when(starts, order).alias("order"))


def phrases(index: DataFrame, tests: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, doc, text_hash, first, last): stretches of a document that a run of windows of a test text covers.

    ``tests`` holds (item, length, place, word), ``index`` the postings of at
    least their words. Both are read several times, so pass written tables.
    """
    planned = checkpointed(_planned(tests, index, size))
    words = planned.select("item", "place", "word")
    firsts = planned.filter("order is not null").select("item", F.col("order")[0].alias("at"), F.try_element_at("order", F.lit(2)).alias("second"))
    # the rarest word of each window: where it stands, the test text may lie
    anchors = firsts.select("item", "at").distinct().join(words.withColumnRenamed("place", "at"), ["item", "at"])
    found = index.join(anchors, "word").select("item", "at", *DOC, (F.col("place") - F.col("at")).alias("shift"))
    found = checkpointed(found)
    # the next rarest: one of the windows from this anchor must have it
    nexts = checkpointed(
        firsts.filter("second is not null").distinct().join(words.withColumnRenamed("place", "second"), ["item", "second"]).select("item", "at", "second", "word")
    )
    thin = index.join(nexts.select("word").distinct(), "word", "left_semi")
    wanted = found.join(nexts, ["item", "at"]).select("item", "at", *DOC, "shift", "word", (F.col("shift") + F.col("second")).alias("place"))
    alone = firsts.filter("second is null").select("item", "at").distinct()
    lined = wanted.join(thin, ["word", *DOC, "place"], "left_semi").select("item", "at", *DOC, "shift").unionByName(found.join(alone, ["item", "at"], "left_semi"))
    lined = checkpointed(lined.distinct())
    # the others, at what is left; only in those documents
    near = F.explode(F.sequence(F.col("at") - (size - 1), F.col("at") + (size - 1)))
    spots = lined.select("item", *DOC, "shift", near.alias("p")).distinct()
    spots = spots.join(words.withColumnRenamed("place", "p"), ["item", "p"]).withColumn("place", F.col("shift") + F.col("p"))
    # written on its own, so that the planner sees how few documents are left
    left = checkpointed(lined.select(*DOC).distinct())
    rest = index.join(left, DOC, "left_semi").join(words.select("word").distinct(), "word", "left_semi")
    hits = spots.join(rest, ["word", *DOC, "place"], "left_semi").select("item", *DOC, "shift", "place")
    run = F.col("place") - F.row_number().over(Window.partitionBy("item", *DOC, "shift").orderBy("place"))
    runs = hits.withColumn("run", run).groupBy("item", *DOC, "shift", "run").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    lengths = tests.groupBy("item").agg(F.least(F.max("length"), F.lit(size)).alias("least"))
    return runs.join(lengths, "item").filter("last - first + 1 >= least").select("item", *DOC, "first", "last")


def proximity(index: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """(query, doc, text_hash, place): places of a query's rarest word from which all its words lie within ``span`` words.

    ``queries`` holds (query, word); a match is a stretch of ``span`` words that
    holds the place and every word of the query, in any order. Words meet
    through cells of ``span`` places, so only neighbours are compared.
    """
    counts = index.groupBy("word").agg(F.count("*").alias("n"))
    asked = queries.select("query", "word").distinct().join(counts, "word", "left").fillna(0, ["n"])
    first = asked.groupBy("query").agg(F.min(F.struct("n", "word"))["word"].alias("word"), F.count("*").alias("size"))
    anchors = index.join(first, "word").select("query", "size", *DOC, F.col("place").alias("at"))
    others = asked.join(first.select("query", F.col("word").alias("rarest")), "query").filter("word <> rarest").select("query", "word")
    cells = F.explode(F.array(*[F.floor(F.col("at") / span) + k for k in (-1, 0, 1)]))
    looked = anchors.select("query", *DOC, "at", cells.alias("cell")).join(others, "query")
    there = index.join(others.select("word").distinct(), "word", "left_semi").withColumn("cell", F.floor(F.col("place") / span))
    met = looked.join(there, ["word", *DOC, "cell"]).filter(F.abs(F.col("place") - F.col("at")) < span)
    # a stretch may start at any of the met places or at the anchor itself
    at_each = met.groupBy("query", *DOC, "at").agg(F.collect_set(F.struct("place", "word")).alias("met"))
    starts = F.array_union(F.transform("met", lambda m: m["place"]), F.array("at"))
    holds = lambda s, size: F.size(F.array_distinct(F.transform(F.filter("met", lambda m: (m["place"] >= s) & (m["place"] < s + span)), lambda m: m["word"]))) == size - 1
    several = at_each.join(first, "query").filter(F.exists(starts, lambda s: (s <= F.col("at")) & (F.col("at") < s + span) & holds(s, F.col("size"))))
    single = anchors.filter("size = 1")
    return several.select("query", *DOC, F.col("at").alias("place")).unionByName(single.select("query", *DOC, F.col("at").alias("place")))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    items = checkpointed(
        benchmark.select(F.monotonically_increasing_id().alias("item"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), words_of(F.col("text")).alias("words"))
    )
    tests = checkpointed(items.select("item", F.size("words").alias("length"), F.posexplode("words").alias("place", "word")))
    index = checkpointed(postings(docs, checkpointed(tests.select("word").distinct())))
    found = checkpointed(phrases(index, tests, size))
    # stretches of several test texts overlap; each place counts once
    before = F.coalesce(F.max("last").over(Window.partitionBy(*DOC).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, before))
    hit = found.select(*DOC, "first", "last").distinct().select(*DOC, fresh.alias("n")).groupBy(*DOC).agg(F.sum("n").cast("long").alias("n_hit"))
    named = found.select("item", *DOC).distinct().join(items.select("item", "name"), "item")
    named = named.groupBy(*DOC).agg(F.array_sort(F.collect_set("name")).alias("names"))
    judged = hit.join(named, DOC)
    rows = _documents(docs).select("doc_id", *DOC, F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(judged, DOC, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "names"), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), items AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size,
         array_to_string(list_slice(words, s + 1, s + least(len(words), 10)), ' ') AS phrase
  FROM items, LATERAL (SELECT unnest(range(0, greatest(len(words) - 9, 1))) AS s) WHERE len(words) > 0
), sizes AS (
  SELECT DISTINCT size FROM windows
), places AS (
  SELECT r, doc_id, size, s, array_to_string(list_slice(words, s + 1, s + size), ' ') AS phrase
  FROM docs, sizes, LATERAL (SELECT unnest(range(0, len(words) - size + 1)) AS s)
), found AS (
  SELECT p.r, p.size, p.s, w.item_id FROM places p JOIN windows w USING (size, phrase)
), hit AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS place FROM found) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
