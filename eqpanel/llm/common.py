"""Helpers the text operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at once inside a task; texts can be long.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What this worker process remembers from task to task, by (maker, arguments).
_HELD: dict[tuple, object] = {}


def held(*key):
    """``key[0](*key[1:])``, made once per worker process, so that its tasks share what they have met."""
    if key not in _HELD:
        _HELD[key] = key[0](*key[1:])
    return _HELD[key]


def vacate(keep: tuple | None = None) -> None:
    """Forget all that is held but ``keep``, and give freed memory back to the system.

    Spark uses a worker again for the tasks of whatever comes next. What one
    operator left there, and what the allocators keep for themselves, would add up.
    """
    for key in [k for k in _HELD if k != keep]:
        del _HELD[key]
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def alone(run: Callable[[Iterator], Iterator], keep: tuple | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches in a worker that holds nothing but ``keep`` before and after."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate(keep)
        yield from run(batches)
        vacate(keep)

    return task


def each_row(df: DataFrame, columns: list[str], make: Callable[[], Callable[..., Iterable[tuple]]], schema: str, keep: tuple | None = None) -> DataFrame:
    """Rows that ``make()(*values)`` yields for each row of ``df``.

    ``make`` runs once per task, so that models and caches are built there.
    Only ``columns`` leave the JVM, in slices of ``SLICE_ROWS``. ``keep`` is the key of what
    ``make`` takes from ``held``.
    """
    names = [part.strip().split()[0] for part in schema.split(",")]
    target = pa.schema([(n, _arrow(part.strip().split()[1])) for n, part in zip(names, schema.split(","), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = [row for values in zip(*(c.to_pylist() for c in part.columns), strict=True) for row in fn(*values)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(alone(run, keep), schema)


def _arrow(kind: str) -> pa.DataType:
    return {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(),
        "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    }[kind]


class Recent(dict):
    """Values by word, made on first use by ``made``; holds the last ``CACHE_WORDS`` to twice as many (about 200 bytes each)."""

    CACHE_WORDS = 500_000

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def __missing__(self, word: str) -> bytes:
        value = self.older.get(word)
        if value is None:
            value = self.made(word)
        if len(self) >= self.CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value

    def made(self, word: str) -> bytes:
        raise NotImplementedError


def utf8(text: str | None) -> bytes:
    return (text or "").encode()
