"""What the training-data operators share: table access, cut points, text and hashing helpers."""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import cut, drop_cut, shared_dir

__all__ = ["WORD", "ascii_lower", "cut", "drop_cut", "held_out", "lean", "mix", "named", "pack", "partitions", "release", "shared_dir", "ship", "shingles", "table", "unpack"]

#: White space of the word contracts: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of an Arrow batch at most, in the sessions of the queries and the pipeline.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def ship(spark: SparkSession) -> None:
    """Prepares the session that a query or the pipeline runs in; operators never call this.

    Lets Python workers import this package from the driver's checkout, if they have no other copy, and bounds Arrow
    batches for the whole session: whole texts are long, and JVM and worker both hold a batch of them. Smaller bounds
    that the session has already are kept.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        held = int(re.sub(r"\D", "", spark.conf.get(f"spark.sql.execution.arrow.{name}")) or 0)
        if not 0 < held <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)
    root = str(Path(__file__).resolve().parents[2])
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, held) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(df: DataFrame, **own: Column | str) -> DataFrame:
    """(row, *own): all of df's columns but those that own reads by name as one struct, so that no name of theirs can
    clash with a name of ours. The first of own is in the struct as well."""
    taken = list(own.values())[1:]
    return df.select(F.struct(*[named(c) for c in df.columns if c not in taken]).alias("row"), *[(named(c) if isinstance(c, str) else c).alias(k) for k, c in own.items()])


def unpack(columns: list[str], **own: Column | str) -> list[Column]:
    """Columns that pack() put into row, in their order; those in own come from there, and further ones behind them."""
    get = lambda c: F.col(c) if isinstance(c, str) else c
    return [get(own[c]).alias(c) if c in own else F.col("row").getField(c).alias(c) for c in columns] + [get(v).alias(c) for c, v in own.items() if c not in columns]


def named(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text mod 5 is 0; a null id is held out, so that it never trains a model."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


# --- memory of workers, which Spark uses again for later stages ---


def release() -> None:
    """Gives back what a Python worker holds beyond its modules: cached words, Arrow's pool, freed memory."""
    _words.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An iterator function of a task that releases the worker's memory when the task ends, however it ends."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


# --- word shingles -----------------------------------------------------------------------------------------------

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hash by word, bounded: it starts anew when its words reach 4 MB; very long words are not kept."""

    size = 0

    def clear(self) -> None:
        self.size = 0
        super().clear()

    def __missing__(self, word: bytes) -> int:
        import xxhash

        got = xxhash.xxh3_64_intdigest(word, 7)
        if len(word) <= 64:
            self.size += len(word) + 16
            if self.size > 4 << 20:
                self.clear()
            self[word] = got
        return got


_words = _Words()


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words make one shingle, no words none.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    acc = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        acc = acc * np.uint64(_BASE) + h[k : k + len(acc)]
    return np.unique(mix(acc + np.uint64(width)))
