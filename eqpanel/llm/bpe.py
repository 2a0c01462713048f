"""Byte-level BPE by a contiguous rank array.

Each pre-split word holds its parts and, beside them, the rank of every
adjacent pair. The smallest rank is found by a scan, its boundary deleted and
the two neighbouring ranks refreshed. Scans are quadratic, so words beyond
``SHORT_BYTES`` take a heap of (rank, place) instead, which merges alike.

Null and empty texts give no ids. Every row gives one row, repeated ones too.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from array import array

import regex
from pyspark.sql import DataFrame, SparkSession

from eqpanel.llm.common import Recent, each_row, table

SHORT_BYTES = 128
#: Fixed value: the public byte-level split pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 62


class Codec(Recent):
    """Ids (little-endian bytes) by word; a word that is missing is merged on first use."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
        byte = {c: b for b, c in char.items()}
        self.first = [vocab[char[b]] for b in range(256)]
        self.pairs = {}
        for rank, merge in enumerate(merges):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        self.bytes = {i: bytes(byte[c] for c in t) for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.words = regex.compile(SPLIT).findall

    def made(self, word: str) -> bytes:
        data = word.encode()
        return array("I", (self._merge_short if len(data) <= SHORT_BYTES else self._merge_long)(data)).tobytes()

    def _rank(self, a: int, b: int) -> int:
        return self.pairs.get(a << 20 | b, NONE)

    def _merge_short(self, data: bytes) -> list[int]:
        parts = [self.first[b] for b in data]
        ranks = [self._rank(a, b) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != NONE:
            i = ranks.index(low)
            parts[i] = low & 0xFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = self._rank(parts[i - 1], parts[i])
            if i < len(ranks):
                ranks[i] = self._rank(parts[i], parts[i + 1])
        return parts

    def _merge_long(self, data: bytes) -> list[int]:
        parts = [self.first[b] for b in data]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i) for i in range(len(parts) - 1) if (r := self._rank(parts[i], parts[i + 1])) != NONE]
        heapq.heapify(heap)
        while heap:
            low, i = heapq.heappop(heap)
            j = after[i] if parts[i] >= 0 else len(parts)
            if j >= len(parts) or self._rank(parts[i], parts[j]) != low:
                continue
            parts[i], parts[j] = low & 0xFFFFF, -1
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                if (r := self._rank(parts[i], parts[after[i]])) != NONE:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := self._rank(parts[before[i]], parts[i])) != NONE:
                heapq.heappush(heap, (r, before[i]))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> array:
        out = []
        for piece in self.at_added.split(text) if self.at_added else [text]:
            if piece in self.added:
                out.append(array("I", [self.added[piece]]).tobytes())
            elif piece:
                out += [self[w] if len(w) <= SHORT_BYTES else self.made(w) for w in self.words(piece)]
        return array("I", b"".join(out))

    def decode(self, ids: array) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.cache
def codec_of(path: str) -> Codec:
    """One per worker process, so that its tasks share what they have met."""
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row; ``path`` is the vocabulary file."""

    def make():
        codec = codec_of(path)

        def row(doc_id, text):
            ids = codec.encode(text or "")
            return ((doc_id, list(ids), codec.decode(ids)),)

        return row

    return each_row(docs, ["doc_id", "text"], make, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Token count and digests of ids and round trip of every row."""

    def make():
        codec = codec_of(path)

        def row(doc_id, text):
            ids = codec.encode(text or "")
            back = codec.decode(ids)
            return ((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()),)

        return row

    return each_row(docs, ["doc_id", "text"], make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
