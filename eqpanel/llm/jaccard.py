"""N-gram Jaccard join by T-occurrence search with DivideSkip, on Spark.

Two sets of sizes r and s reach the threshold exactly if they share at least
T = ceil(t / (1 + t) * (r + s)) shingles. DivideSkip merges the short inverted
lists and probes the long ones. Here every set orders its shingles from rare to
frequent by a count table of fixed size over all documents. With |r| - ceil(t
|r|) + ``OCCUR`` short lists kept per set, any pair that links meets in
``OCCUR`` of them (or in T, if that is less).
Spark's sort merges those lists; the long ones are never expanded: a candidate
is settled by binary search of one set's sorted shingles in the other's.

Sets that are equal are one class. Candidates come in two rounds. The first
compares each member of a list only with its neighbour, the list's first member
of fitting size and a few drawn ones, which joins groups of near copies; the
second compares all that is still in different components, so no link between
components is lost.

A bitmap filter passes before texts are fetched. A set's sketch holds, for each of
``BITS`` hash classes, whether its number of shingles is odd; two sets differ in at
least as many shingles as their sketches differ in bits. A pair whose sketches
differ by more than a link allows is no link, so the filter loses none.

Null texts and texts without words have the empty set and link with nothing;
fewer than five words are one shingle. Repeated rows fall in one class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eqpanel.functions.checkpoints import checkpointed
from eqpanel.llm.common import SLICE_ROWS, alone, table
from eqpanel.llm.components import components

WORDS = 5
#: Threshold as a fraction, compared in whole numbers.
NUM, DEN = 80, 100
#: Short lists in which a pair must occur before its long ones are probed.
OCCUR = 4
#: Partners drawn from a list for each of its rows in the first round.
DRAWS = 2
#: Bits of a set's sketch.
BITS = 1024
#: Pairs whose sketches are compared at once (128 bytes each, a few times).
SKETCHED = 1 << 16
#: Size of the count table that orders shingles.
BUCKETS = 1 << 17
#: 64-bit words of the bitmap that picks the texts to fetch (a broadcast table of as many rows at most).
PICKED = 1 << 17
#: Bytes of text hashed at once; a longer text is a block of its own.
BLOCK = 1 << 20
#: Pairs made at once inside a task.
PAIRS = 1 << 19
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _spread(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers (the SplitMix64 sequence of ``seed``)."""
    z = (np.arange(n, dtype=np.uint64) + np.uint64(seed)) * _MIX
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit hashes of texts' shingles.

    A word's hash is a sum over its bytes of a random number of the byte times
    one of its place, taken for all words of a block of texts at once.
    """

    def __init__(self):
        self.byte = _spread(256, 1)
        self.byte[_SPACE] = 0
        self.place = _spread(4096, 1000)

    def of(self, text: str | None) -> np.ndarray:
        return next(self.each(pa.array([text or ""], pa.large_string())))

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The set of every text, in order; texts are read in blocks of about ``BLOCK`` bytes."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, at, data = texts.buffers()
        at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
        row = 0
        while row < len(texts):
            stop = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, "right")) - 1)
            yield from self._block(data[at[row] : at[stop]], at[row : stop + 1] - at[row])
            row = stop

    def _block(self, data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        data = _LOWER[data]
        space = _SPACE[data]
        fresh = np.empty(len(data) + 1, bool)
        fresh[0] = True
        fresh[1:] = space
        fresh[at] = True
        begin = np.flatnonzero(fresh[:-1] & ~space)
        if not len(begin):
            yield from (np.empty(0, np.uint64) for _ in at[1:])
            return
        lengths = np.diff(np.append(begin, len(data)))
        if lengths.max() > len(self.place):
            self.place = _spread(int(lengths.max()), 1000)
        place = np.arange(begin[0], len(data)) - np.repeat(begin, lengths)
        words = _mixed(np.add.reduceat(self.byte[data[begin[0] :]] * self.place[place], begin - begin[0]))
        full = _windows(words, WORDS) if len(words) >= WORDS else words[:0]
        edges = np.searchsorted(begin, at)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a >= WORDS:
                h = np.sort(full[a : b - WORDS + 1])
                yield h[np.append(True, h[1:] != h[:-1])]
            else:
                yield _windows(words[a:b], int(b - a)) if b > a else words[:0]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _windows(words: np.ndarray, width: int) -> np.ndarray:
    h = np.full(len(words) - width + 1, np.uint64(width))
    for k in range(width):
        h = _mixed(h ^ words[k : len(words) - width + 1 + k])
    return h


def short(n: int) -> int:
    """Lists a set of n shingles keeps."""
    return min(n, n - -(-NUM * n // DEN) + OCCUR)


def counted(docs: DataFrame) -> np.ndarray:
    """Shingles of all documents by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, shingles = np.zeros(BUCKETS, np.int64), Shingles()
        for batch in batches:
            held, size = [], 0
            for s in shingles.each(batch.column(0)):
                held.append(s)
                size += len(s)
                if size > BUCKETS:
                    seen += np.bincount(_bucket(np.concatenate(held)), minlength=BUCKETS)
                    held, size = [], 0
            if held:
                seen += np.bincount(_bucket(np.concatenate(held)), minlength=BUCKETS)
        hit = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(seen[hit], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    rows = docs.select("text").mapInArrow(alone(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(BUCKETS - 1)).astype(np.int64)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of ``BITS`` classes, as 64-bit words."""
    odd = np.bincount((s >> np.uint64(65 - BITS.bit_length())).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def _sketches(column: pa.Array) -> np.ndarray:
    """Sketches of a column, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), BITS // 64)


def may_link(n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By pair: whether sets of ``n`` shingles together and these sketches can reach the threshold.

    Sets that differ in d shingles share (n - d) / 2 of (n + d) / 2.
    """
    out = np.empty(len(n), bool)
    for at in range(0, len(n), SKETCHED):
        part = slice(at, at + SKETCHED)
        differ = np.bitwise_count(x(part) ^ y(part)).sum(1, dtype=np.int64)
        out[part] = (DEN + NUM) * differ <= (DEN - NUM) * n[part]
    return out


def _lists(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, size, the set's digest, its sketch and its short lists, rarest first."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                sizes, digests, sketches, keys = [], [], [], []
                for s in shingles.each(part.column(1)):
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sketches.append(sketch(s).tobytes())
                    keys.append(s[np.lexsort((s, counts[_bucket(s)]))[: short(len(s))]].view(np.int64))
                ends = np.cumsum([0, *map(len, keys)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), lists], names=["doc_id", "n", "digest", "sketch", "keys"])

    return docs.select("doc_id", "text").mapInArrow(alone(make), "doc_id long, n long, digest binary, sketch binary, keys array<long>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, cut only between its values."""
    tail = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [_sketches(c) if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if tail is not None:
            cols = [np.concatenate(x) for x in zip(tail, cols, strict=True)]
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        tail = [c[last:] for c in cols]
        if last:
            yield [c[:last] for c in cols]
    if tail is not None:
        yield tail


def _sorted(lists: DataFrame, *columns: str) -> DataFrame:
    return lists.repartition("key").sortWithinPartitions("key", "n", "rep").select("key", "n", "rep", *columns)


def _shared(lists: DataFrame) -> DataFrame:
    """Rows of the lists that hold two sets or more."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _runs(batches):
            same = cols[0][1:] == cols[0][:-1]
            both = np.append(same, False) | np.append(False, same)
            yield pa.RecordBatch.from_arrays([pa.array(c[both], pa.int64()) for c in cols], names=["key", "n", "rep", "at"])

    return _sorted(lists, "at").mapInArrow(alone(keep), "key long, n long, rep long, at long")


def _fitting(group: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row: where the rows of its list begin and end whose size lets them link."""
    value = group << 32 | n
    low = np.searchsorted(value, group << 32 | -(-NUM * n // DEN))
    return low, np.searchsorted(value, group << 32 | DEN * n // NUM, "right")


def _near(key: np.ndarray, group: np.ndarray, n: np.ndarray, rep: np.ndarray):
    """(i, j): each row with its neighbour, the first row of fitting size and ``DRAWS`` rows between.

    The drawn rows depend on the list, so that a set which stands in the same
    order in many lists meets another partner in each.
    """
    i = np.arange(len(n))
    low, _ = _fitting(group, n)
    wide = np.maximum(i - low, 1).astype(np.uint64)
    draws = (_mixed(_mixed(key.astype(np.uint64) + np.uint64(k)) ^ rep.astype(np.uint64)) for k in range(DRAWS))
    for j in (low, i - 1, *(low + (d % wide).astype(np.int64) for d in draws)):
        use = (j >= low) & (j < i)
        yield i[use], j[use]


def _across(group: np.ndarray, n: np.ndarray, comp: np.ndarray):
    """(i, j): all rows of a list that are of fitting size and different components.

    Rows of a list's most common component are met by the others only.
    """
    by = np.lexsort((comp, group))
    new = np.append(True, (group[by][1:] != group[by][:-1]) | (comp[by][1:] != comp[by][:-1]))
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(by)))
    order = np.lexsort((counts, group[by][first]))
    largest = order[np.append(np.diff(group[by][first][order]) > 0, True)]
    common = np.zeros(group[-1] + 1, comp.dtype)
    common[group[by][first[largest]]] = comp[by][first[largest]]
    low, high = _fitting(group, n)
    other = np.flatnonzero(comp != common[group])
    ends = np.cumsum(high[other] - low[other])
    at = 0
    while at < len(other):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        rows = other[at:stop]
        span = high[rows] - low[rows]
        i = np.repeat(rows, span)
        j = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span) + np.repeat(low[rows], span)
        use = (comp[i] != comp[j]) & ((comp[j] == common[group[j]]) | (j < i))
        yield i[use], j[use]
        at = stop


def _mixed_lists(lists: DataFrame) -> DataFrame:
    """Rows of the lists ``(key, n, rep, at, comp)`` that hold sets of more than one component."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _runs(batches):
            first = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
            mixed = np.minimum.reduceat(cols[4], first) != np.maximum.reduceat(cols[4], first)
            rows = np.repeat(mixed, np.diff(np.append(first, len(cols[0]))))
            yield pa.RecordBatch.from_arrays([pa.array(c[rows], pa.int64()) for c in cols], names=["key", "n", "rep", "at", "comp"])

    return _sorted(lists, "at", "comp").mapInArrow(alone(keep), "key long, n long, rep long, at long, comp long")


def _merge(lists: DataFrame, every: bool) -> DataFrame:
    """Candidate pairs (a < b) of the merged lists ``(key, n, rep, at, comp)``.

    With ``every`` all pairs of different components that can still reach T and
    whose sketches, a further column, allow it; else a few for each row of a list.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def batch_of():
            both, seen = np.unique(np.concatenate(held), axis=0, return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(both[:, k], pa.int64()) for k in range(3)), pa.array(seen, pa.int64())], names=["a", "b", "least", "seen"])

        for key, n, rep, at, comp, *bits in _runs(batches):
            group = np.append(0, np.cumsum(key[1:] != key[:-1]))
            for i, j in _across(group, n, comp) if every else _near(key, group, n, rep):
                total = n[i] + n[j]
                need = -(-NUM * total // (NUM + DEN))
                # the first OCCUR common shingles of a linked pair all pass this bound
                can = np.minimum(n[i] - at[i], n[j] - at[j]) + OCCUR - 1 >= need
                i, j, need, total = i[can], j[can], need[can], total[can]
                if bits:
                    can = may_link(total, lambda part, i=i: bits[0][i[part]], lambda part, j=j: bits[0][j[part]])
                    i, j, need = i[can], j[can], need[can]
                held.append(np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j]), np.minimum(OCCUR, need)], 1))
                size += len(i)
                if size > PAIRS:
                    yield batch_of()
                    size = 0
        if size:
            yield batch_of()

    met = _sorted(lists, "at", "comp", *(["sketch"] if every else [])).mapInArrow(alone(merge), "a long, b long, least long, seen long").groupBy("a", "b", "least").agg(F.sum("seen").alias("seen"))
    return met.filter("seen >= least").select("a", "b") if every else met.select("a", "b", "seen")


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose sketches allow a link."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _sketches(batch.column(3)), _sketches(batch.column(4))
            can = may_link(batch.column(2).to_numpy(), lambda part, x=x: x[part], lambda part, y=y: y[part])
            yield batch.select([0, 1, 5]).filter(pa.array(can))

    a, b = (reps.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", F.col("na") + F.col("nb"), "sa", "sb", "seen").mapInArrow(alone(keep), "a long, b long, seen long")


def _fetched(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose doc_id is in the distinct ``ids``, one of each.

    A bitmap of hashed ids, of fixed size, keeps all but a few of the other texts
    out of the shuffle; the join behind it is exact, however full the bitmap is.
    """
    word, bit = f"shiftrightunsigned(xxhash64(doc_id), 6) % {PICKED}", "int(xxhash64(doc_id) & 63)"
    bitmap = ids.groupBy(F.expr(word).alias("__word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("__bits"))
    likely = texts.withColumn("__word", F.expr(word)).join(F.broadcast(bitmap), "__word").where(f"getbit(__bits, {bit}) = 1")
    # no semi join, which Spark would move below the bitmap's
    return likely.select(*texts.columns).join(ids, "doc_id").dropDuplicates(["doc_id"])


def _settled(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs that link, by binary search of the smaller set in the larger."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, held = Shingles(), None, None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                y = part.column(3).cast(pa.large_string())
                linked = []
                for k, (b, r) in enumerate(zip(part.column(1).to_pylist(), shingles.each(part.column(2)), strict=True)):
                    if b != last:
                        last, held = b, next(shingles.each(y.slice(k, 1)))
                    r, s = (r, held) if len(r) <= len(held) else (held, r)
                    both = int((s[np.minimum(np.searchsorted(s, r), len(s) - 1)] == r).sum())
                    linked.append(DEN * both >= NUM * (len(r) + len(s) - both))
                yield part.select([0, 1]).filter(pa.array(linked))

    used = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    # shuffled once by doc_id: both joins read the same exchange
    held = _fetched(texts, used)
    full = pairs.join(held.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(held.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
    # the last join leaves equal b together, whose set is made once
    return full.select("a", "b", "x", "y").mapInArrow(alone(settle), "a long, b long")


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component of ``joined``."""
    a, b = (joined.select(F.col("id").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.filter("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select("doc_id", "text")
    sets = checkpointed(_lists(docs, counted(docs)))
    # equal sets have equal lists, so any row's may stand for the class
    equal = sets.filter("n > 0 and doc_id is not null").groupBy("digest")
    rep, of_set = F.min("doc_id").alias("rep"), {c: F.first(c).alias(c) for c in ("n", "sketch", "keys")}
    reps = checkpointed(equal.agg(rep, of_set["n"], of_set["sketch"]))
    lists = equal.agg(rep, of_set["n"], of_set["keys"]).select("rep", "n", F.posexplode("keys").alias("at", "key"))
    shared = checkpointed(_shared(lists.withColumn("at", F.col("at").cast("long"))))
    texts = docs.filter("doc_id is not null and text is not null")
    near = checkpointed(_likely(_merge(shared.withColumn("comp", F.col("rep")), every=False), reps))
    # a document's best partner first; of the other pairs only those it leaves apart
    best = near.groupBy("b").agg(F.max_by("a", F.struct("seen", "a")).alias("a")).select("a", "b")
    linked = checkpointed(_settled(checkpointed(best), texts))
    linked = linked.unionByName(checkpointed(_settled(checkpointed(_apart(near.select("a", "b"), components(linked))), texts)))
    round1 = checkpointed(linked)
    joined = checkpointed(components(round1))
    known = shared.join(joined.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    mixed = checkpointed(_mixed_lists(known)).join(reps.select("rep", "sketch"), "rep")
    round2 = checkpointed(_settled(checkpointed(_merge(mixed, every=True)), texts))
    final = components(round1.unionByName(round2)).withColumnRenamed("id", "rep")
    answer = reps.select("digest", "rep").join(final, "rep", "left").select("digest", F.coalesce("component", "rep").alias("c"))
    narrow = sets.select("doc_id", F.col("n").alias("n_shingles"), "digest")
    return narrow.join(answer, "digest", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without rows that have a linked document of smaller id."""
    keep = classes(docs).filter("doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("__d")).filter("__d is not null").distinct()
    return docs.join(keep, docs["doc_id"] == F.col("__d"), "leftsemi").unionByName(docs.filter("doc_id is null"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
