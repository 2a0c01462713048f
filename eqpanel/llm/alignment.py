"""Cross-tokenizer alignment with an identity-map fast path.

Tokenizer A is a byte-level BPE file, B a sentencepiece model. Both cut the bytes
of a space and the text; the offsets where both end a token part them into
groups, and every A token of a group is linked with every B token in it. An
array made once holds for each A id the B id of the same bytes. Links along that
array are counted in one vector as long as A's vocabulary per task; only the
other, irregular pairs are shuffled, distinct per document and combined in the
task first.

No token of A and no piece of B runs over a place where a space follows a
visible character, so texts are aligned chunk by chunk between such places and a
worker remembers the chunks it has met. The rule is checked against the
vocabulary of B; where a piece breaks it, or a chunk does not give back its
bytes, the whole text is one chunk.

Null and empty texts, and texts whose bytes a tokenizer does not give back (they
hold U+2581, say), have no tokens: zeros and an empty digest. Very long texts
are handled whole. Repeated rows each get their row and count as documents of
their own; null ids stay null. Other columns are never read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eqpanel.functions.checkpoints import checkpointed
from eqpanel.llm.common import table

#: Chunks a worker remembers (up to twice as many, about 400 bytes each).
CACHE_CHUNKS = 300_000
#: Texts handled at once: at most so many rows, and no more once so many characters are reached.
SLICE_ROWS, SLICE_CHARS = 256, 2_000_000
#: Pair key: A id above, B id below this many bits.
BITS = 32


class Record(NamedTuple):
    """Alignment of a chunk: counts, its groups as text, and its links (A ids of identity links, keys of the others)."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: bytes
    same: bytes
    pairs: bytes


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            added = {t["content"] for t in json.load(f).get("added_tokens", [])}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = token.encode() if token in added else bytes(byte[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        by_bytes: dict[bytes, int] = {}
        for i, p in sorted(enumerate(self.bytes_b), key=lambda x: self.b.is_byte(x[0])):
            by_bytes.setdefault(p, i)
        self.same_as = [by_bytes.get(p, -1) for p in self.bytes_a]
        self.space = self.b.piece_to_id("▁")
        self.same_text = [f"{i}|{j}".encode() for i, j in enumerate(self.same_as)]
        self.size_a, self.size_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.chunks = re.compile(r"(?<=\S)(?= )").split if self.cuts else lambda text: [text]
        self.recent: dict[str, Record | None] = {}
        self.older: dict[str, Record | None] = {}

    def _record(self, a: list[int], b: list[int]) -> Record:
        """Alignment of one chunk from ids that give back the same bytes."""
        same_as, same_text = self.same_as, self.same_text
        if [same_as[x] for x in a] == b:
            return Record(len(a), len(b), len(a), len(a), b";".join([same_text[x] for x in a]), array("i", a).tobytes(), b"")
        size_a, size_b = self.size_a, self.size_b
        groups, same, pairs = [], [], []
        i = j = at_a = at_b = i0 = j0 = links = 0
        n = len(a)
        while i < n:
            if at_a <= at_b:
                at_a += size_a[a[i]]
                i += 1
            else:
                at_b += size_b[b[j]]
                j += 1
            while at_b < at_a:
                at_b += size_b[b[j]]
                j += 1
            if at_a == at_b:
                x, y = a[i0], b[j0]
                if i - i0 == 1 == j - j0 and same_as[x] == y:
                    links += 1
                    same.append(x)
                    groups.append(same_text[x])
                else:
                    part_a, part_b = a[i0:i], b[j0:j]
                    links += len(part_a) * len(part_b)
                    for x in part_a:
                        for y in part_b:
                            if same_as[x] == y:
                                same.append(x)
                            else:
                                pairs.append(x << BITS | y)
                    groups.append(f"{','.join(map(str, part_a))}|{','.join(map(str, part_b))}".encode())
                i0, j0 = i, j
        return Record(n, len(b), len(groups), links, b";".join(groups), array("i", same).tobytes(), array("q", pairs).tobytes())

    def _encoded(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of a text that starts with a space, from both; None where its bytes do not come back."""
        a = self.a.encode(text, add_special_tokens=False).ids
        # B puts its space before each text but an empty one
        b = self.b.encode(text[1:]) if text != " " else [self.space]
        data = text.encode()
        back = (b"".join(map(of.__getitem__, ids)) for of, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        return (a, b) if all(x == data for x in back) else None

    def _learn(self, chunks: list[str]) -> None:
        """Remember new chunks; in one text they are cut like each by itself."""
        ids = self._encoded("".join(chunks))
        if ids is None and len(chunks) > 1:
            half = len(chunks) // 2
            self._learn(chunks[:half])
            self._learn(chunks[half:])
            return
        if ids is None:
            self.recent[chunks[0]] = None
            return
        ends = np.cumsum([len(c.encode()) for c in chunks])
        to_a, to_b = ((np.searchsorted(np.cumsum([size[x] for x in side]), ends) + 1).tolist() for size, side in zip((self.size_a, self.size_b), ids, strict=True))
        i = j = 0
        for c, k, m in zip(chunks, to_a, to_b, strict=True):
            self.recent[c] = self._record(ids[0][i:k], ids[1][j:m])
            i, j = k, m

    def of(self, texts: list[str | None]) -> Iterator[list[Record]]:
        """Records of each text; none for a text without tokens."""
        cut = [self.chunks(" " + t) if t else [] for t in texts]
        if len(self.recent) > CACHE_CHUNKS:
            self.older, self.recent = self.recent, {}
        recent, older = self.recent, self.older
        new = []
        for c in set(itertools.chain.from_iterable(cut)).difference(recent):
            if c in older:
                recent[c] = older[c]
            else:
                new.append(c)
        # the last chunk of a text may end in white space, which changes with what follows
        joined = [c for c in new if self.cuts and not c[-1].isspace()]
        for group in [joined, *([c] for c in new if not self.cuts or c[-1].isspace())]:
            if group:
                self._learn(group)
        for chunks in cut:
            records = [recent[c] for c in chunks]
            if None in records:
                ids = self._encoded("".join(chunks))
                records = [self._record(*ids)] if ids else []
            yield records


@functools.cache
def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One per worker process, so that its tasks share what they have met."""
    return Aligner(path_a, path_b)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    texts = batch.column(1).to_pylist()
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if i + 1 - start == SLICE_ROWS or size >= SLICE_CHARS or i + 1 == len(texts):
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, size = i + 1, 0


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: doc_id, counts, digest and links.

    ``same`` holds the A ids of identity links and ``pairs`` the keys
    (A id << 32 | B id) of the others, each distinct, with their numbers of
    links in ``same_n`` and ``pairs_n``.
    """
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_n", "pairs", "pairs_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        for batch in batches:
            for part, texts in _slices(batch):
                counts, digests, links = [], [], []
                for records in aligner.of(texts):
                    columns = tuple(zip(*records, strict=True)) or ((), (), (), (), (), (), ())
                    counts.append([sum(c) for c in columns[:4]])
                    digests.append(hashlib.sha256(b";".join(columns[4])).hexdigest() if records else "")
                    same = np.unique(np.frombuffer(b"".join(columns[5]), np.int32), return_counts=True)
                    pairs = np.unique(np.frombuffer(b"".join(columns[6]), np.int64), return_counts=True)
                    links.append((*same, *pairs))
                lists = [_lists([np.asarray(row[k], t) for row in links], p) for k, t, p in zip(range(4), (np.int32, np.int32, np.int64, np.int32), (pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True)), pa.array(digests), *lists], names)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same array<int>, same_n array<int>, pairs array<long>, pairs_n array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def identity_counts(aligned: DataFrame) -> DataFrame:
    """(a, n): documents that hold each identity link, from one vector per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(0, np.int64)
        for batch in batches:
            seen = np.bincount(np.asarray(batch.column(0).flatten()), minlength=len(vector))
            seen[: len(vector)] += vector
            vector = seen
        ids = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(vector[ids])], ["a", "n"])

    return aligned.select("same").mapInArrow(run, "a int, n long").groupBy("a").agg(F.sum("n").alias("n"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): documents that hold each irregular pair."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def scored(aligned: DataFrame) -> DataFrame:
    """doc_id, counts, n_best, count_sum and digest of every row of ``aligned``, which is read several times.

    The identity counts (no more than A has ids) go to the driver and back to
    the tasks; the counts of irregular pairs are joined, and the planner
    broadcasts their table only while it is small on disk.
    """
    spark = aligned.sparkSession
    same = checkpointed(identity_counts(aligned))
    pairs = checkpointed(pair_counts(aligned).withColumn("a", F.shiftright("pair", BITS).cast("int")))
    best = checkpointed(same.unionByName(pairs.select("a", "n")).groupBy("a").agg(F.max("n").alias("best")))
    vector = best.join(same, "a", "left").fillna(0, ["n"]).toPandas()
    n = np.zeros(int(vector["a"].max()) + 1 if len(vector) else 0, np.int64)
    top = np.zeros(len(n), bool)
    n[vector["a"]], top[vector["a"]] = vector["n"], vector["n"] == vector["best"]
    shared = spark.sparkContext.broadcast((n, top))

    def regular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, tops = shared.value
        for batch in batches:
            same, times = batch.column("same"), np.asarray(batch.column("same_n").flatten()).astype(np.int64)
            ids, ends = np.asarray(same.flatten()), np.cumsum([0, *same.value_lengths().to_pylist()])
            sums = [np.concatenate([[0], np.cumsum(v)])[ends] for v in ((tops[ids] * times, counts[ids] * times) if len(ids) else (times, times))]
            made = [pa.array(np.diff(s)) for s in sums]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], [*batch.schema.names[:-2], "best_same", "sum_same"])

    plain = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    rows = aligned.select(*(c.split()[0] for c in plain.split(", ")), "same", "same_n").mapInArrow(regular, f"{plain}, best_same long, sum_same long")
    judged = checkpointed(pairs.join(best, "a").select("pair", "n", (F.col("n") == F.col("best")).cast("long").alias("top")))
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "pairs_n")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.pairs_n").alias("times"))
    others = links.join(judged, "pair").groupBy("row").agg(F.sum(F.col("top") * F.col("times")).alias("best_pairs"), F.sum(F.col("n") * F.col("times")).alias("sum_pairs"))
    zero = F.lit(0).cast("long")
    return rows.join(others, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("best_same") + F.coalesce("best_pairs", zero)).alias("n_best"),
        (F.col("sum_same") + F.coalesce("sum_pairs", zero)).alias("count_sum"), "groups_sha256",
    )


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The scored alignment of every document."""
    return scored(checkpointed(align(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id())))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
