"""Document fingerprints: threshold-scaled sketches of word shingles, their likeness, and the edit test over them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, partitions, shingles
from .ranges import range_number

#: One hash in so many lies below the threshold and is kept, whatever a text's length. Hashes are kept to 48 bits, as 12
#: hexadecimal digits.
ONE_IN, DIGITS = 4, 12
LIMIT = (1 << 48) // ONE_IN


def sketch(text: str | None) -> np.ndarray:
    """Sorted 48-bit hashes below the threshold of a text's five-word shingles."""
    h = np.unique(shingles(text) >> np.uint64(16))
    return h[: np.searchsorted(h, np.uint64(LIMIT))]


def to_text(h: np.ndarray) -> str:
    return h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.array([int(fingerprint[k : k + DIGITS], 16) for k in range(0, len(fingerprint), DIGITS)], np.uint64)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    return np.union1d(a, b)


def size(a: np.ndarray) -> int:
    """Estimated number of a text's distinct shingles."""
    return ONE_IN * len(a)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the shingle sets; 1 for equal sketches, so also for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has, however much longer b is; 1 if a's sketch is empty."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def _bounds(rows: DataFrame, n: int) -> list[tuple]:
    """Up to n - 1 ascending (id, h) that split the rows into about even ranges; null ids are the smallest.

    They come from a sample by hash of about 40 rows a range, which is all that reaches the driver.
    """
    total = rows.count()
    place = F.shiftrightunsigned(F.xxhash64("id", "h", F.lit(17)), 11) / float(1 << 53)
    some = rows.select("id", "h").where(place < 40 * n / max(1, total)).collect()
    keys = sorted({(r.id, r.h) for r in some}, key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1]))
    return list(dict.fromkeys(keys[len(keys) * k // n] for k in range(1, n))) if keys else []


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, held_by_edited,
    held_by_next) of every row.

    A row's edited text is its text with the last floor(n_chars / 4) code points replaced by as many first ones of the
    next document by ascending id (the last's next is the first); near_edited and near_next are the likeness of its
    fingerprint to the edited text's and to the next document's, held_by_edited and held_by_next its containment in
    them. A text of n shingles has an empty fingerprint with probability (1 - 1 / ONE_IN) ** n: on texts of fewer than
    some twenty words these figures say little, and two empty fingerprints count as equal.

    The whole texts shuffle once, by ranges of (id, text's hash) that hold about as many rows each, so that an id that
    many rows have is split too; a range is sorted and walked in Arrow batches with one row held back. The first row of
    each range also goes to the range before it, for that range's last row. Ids may be of any type that can be ordered.
    Null text counts as empty; null ids come first; rows of one id follow each other by their texts' hashes. A table of
    one row is its own next, an empty one gives no rows. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    n_parts = 4 * partitions(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("h"), "text")
    kind = docs.schema[id_col].dataType.simpleString()
    key = F.struct("id", "h")
    rows = rows.withColumn("part", range_number(key, _bounds(rows, n_parts), f"struct<id:{kind},h:bigint>"))
    # One row a range: the first key, and the range that it must also be sent to.
    every = Window.partitionBy(F.lit(0)).orderBy("part")
    firsts = rows.groupBy("part").agg(F.min(key).alias("lo"))
    firsts = firsts.withColumn("to", F.coalesce(F.lag("part").over(every), F.max("part").over(Window.partitionBy(F.lit(0)))))
    first_of = [(r.part, tuple(r.lo), r.to) for r in firsts.collect()]  # at most n_parts rows
    table = F.broadcast(spark.createDataFrame(first_of, f"p int, lo struct<id:{kind},h:bigint>, to int"))
    sent = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("over")))
    also = F.array(F.struct(F.col("to").alias("part"), F.lit(1).alias("over")))
    rows = rows.join(table, F.col("part") == F.col("p"), "left")
    rows = rows.select("id", "h", "text", F.inline(F.when(key.eqNullSafe(F.col("lo")), F.concat(sent, also)).otherwise(sent)))
    rows = rows.repartition(n_parts, "part").sortWithinPartitions("part", "over", "id", "h", "text").select("part", "over", "id", "text")
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "held_by_edited", "held_by_next"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None  # part, id, text, sketch of the row that waits for its next

        def close(following: str, next_sketch: np.ndarray) -> None:
            _, i, text, own = held
            n = len(text) // 4
            edited = text[: len(text) - n] + following[:n] if n else text
            after = sketch(edited)
            out.append((i, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_text(own), to_text(after), likeness(own, after), likeness(own, next_sketch), containment(own, after), containment(own, next_sketch)))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 9
            kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(2).type
            for part, over, i, text in zip(*[batch.column(k).to_pylist() for k in (0, 1, 2)], batch.column(3), strict=True):
                if over and (held is None or held[0] != part):
                    continue  # a second row with the first id of the next range
                text = text.as_py()
                own = sketch(text)
                if held is not None:
                    close(text, own)
                held = None if over else (part, i, text, own)
                if len(out) >= 500:
                    yield flush()
        yield flush()

    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, held_by_edited double, held_by_next double"
    return rows.mapInArrow(lean(walk), schema)
