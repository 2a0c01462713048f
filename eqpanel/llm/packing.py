"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two, longest
first and none above ``limit``. Every piece is a sequence of its own, so none
crosses documents and none is padded; ``bucket`` (the exponent) groups equal
lengths for batching. There is no shuffle: ids of sequences come from the
partition and the place in it, which a re-run of a task repeats.

Null and empty texts hold only the end id. Repeated rows are packed each.
"""

from __future__ import annotations

import zlib
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eqpanel.llm.common import Recent, each_row, held, table

LIMIT = 4096
END_ID = 2
MARKS = ".,;:!?"
#: A longer stretch is not remembered.
LONG_WORD = 64


class Words(Recent):
    """Ids (little-endian bytes) by stretch without blank or line end.

    The tokenizer drops white space and no token or normal form reaches across
    it, so a text's ids are those of its stretches, one after the other. Marks
    at the end of letters are a stretch of their own, and ASCII letters have the
    ids of their lower case.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def made(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        if core and core != word and core[-1].isalpha():
            return self[core] + self[word[len(core) :]]
        if word.isascii() and word.isalpha() and not word.islower():
            return self[word.lower()]
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join([self[w] if len(w) <= LONG_WORD else self.made(w) for w in text.replace("\n", " ").split(" ")])


def cuts(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    whole = n // limit
    out = [(i * limit, limit) for i in range(whole)]
    at = whole * limit
    for bit in range(limit.bit_length() - 2, -1, -1):
        if n % limit >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pieces(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """One row per piece, with its ids if ``keep_ids``."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if keep_ids else "")

    def make():
        words = held(Words, path)
        end = array("I", [END_ID]).tobytes()

        def row(doc_id, text):
            ids = words.encode(text or "") + end
            for start, n in cuts(len(ids) // 4):
                part = ids[4 * start : 4 * (start + n)]
                yield (doc_id, start, n, zlib.crc32(part), len(ids) // 4) + ((array("I", part).tolist(),) if keep_ids else ())

        return row

    out = each_row(docs, ["doc_id", "text"], make, schema, keep=(Words, path))
    return out.select("*", F.log2("length").cast("long").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per sequence length."""
    packed.write.partitionBy("bucket").parquet(path)


def pack(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pieces(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
