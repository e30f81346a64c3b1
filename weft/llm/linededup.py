"""Line dedup by a deletion-neighbourhood join: equal lines and lines within one edit, the earliest stays."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, mix, pack, unpack
from .urlfilter import listed

#: Default of min_near: lines of fewer characters match only if they are equal, as one edit makes another line of a
#: short one ("Chapter 1", "Chapter 2").
MIN_NEAR = 20
_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
#: White space as Java's \s has it, here and in first_lines.
BLANKS = " \t\n\x0b\f\r"
_BLANK = re.compile(f"[{BLANKS}]*")


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(0, n - 1), base, np.uint64), dtype=np.uint64)])[:n].astype(np.uint64)


def deletion_keys(line: str, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places of the variants of a line with the character at low <= place < high deleted.

    The key hashes the variant's characters, so it equals the key (line_key) of a line that reads like it. A run of
    equal characters gives the same variant at each of its places: a substitution is matched by its place.
    """
    p = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(p) * _powers(_B, len(p)), dtype=np.uint64)])
    at = np.arange(max(low, 0), min(high, len(p)))
    return mix(sums[at] + (sums[-1] - sums[at + 1]) * np.uint64(_BINV)).view(np.int64), at.astype(np.int32)


def line_key(line: str) -> int:
    p = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    return int(mix(np.array([(mix(p) * _powers(_B, len(p))).sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0])


def subsets_keys(line: str, most: int) -> Iterator[tuple[int, list[int]]]:
    """(key, gaps) of every variant with up to `most` characters deleted. gaps are the places in the variant where a
    character was deleted, ascending, the n-th at one place as place * (most + 1) + n, so that they are distinct."""
    for n in range(min(most, len(line)) + 1):
        for places in itertools.combinations(range(len(line)), n):
            at = [p - k for k, p in enumerate(places)]
            yield line_key("".join(c for k, c in enumerate(line) if k not in places)), [g * (most + 1) + at[:k].count(g) for k, g in enumerate(at)]


def with_blocks(rows: DataFrame, min_near: int) -> DataFrame:
    """Adds blocks: keys of the blocks that two lines within one edit must share one of, their first or last m characters.

    m is the largest power of two up to half the length; where a length begins a new m, the smaller one is given too,
    so that lines of lengths one apart always have an m in common. One edit leaves the first or the last m as it is.
    A key holds the line's length or one more, so that only lines whose lengths are one apart at most share it. The
    first, second, fifth and sixth key are of first characters. Plain columns, so that all of it is compiled.
    """
    n, m = F.col("n"), F.col("m")

    def ends(of: Column, size: Column) -> Column:
        first, last = F.xxhash64(F.lit(1), size, F.substring("line", F.lit(1), size)), F.xxhash64(F.lit(2), size, F.substring("line", n - size + 1, size))
        return F.when(of, F.struct(first.alias("first"), last.alias("last")))

    keys = lambda c: F.array(*[F.xxhash64(F.col(f"{c}.{end}"), n + more) for end in ("first", "last") for more in (0, 1)])
    power = F.char_length(F.bin(n)) - 2  # of two: m = 2 ** power
    sized = rows.withColumn("n", F.char_length("line")).withColumn("m", F.when(n >= max(2, min_near), F.call_function("shiftleft", F.lit(1), power)))
    own = sized.withColumns({"large": ends(m.isNotNull(), m), "small": ends(m.isNotNull() & (n.bitwiseAND(n - 1) == 0), F.call_function("shiftright", m, F.lit(1)))})
    none = F.array().cast("array<bigint>")
    blocks = F.when(F.col("small").isNotNull(), F.concat(keys("large"), keys("small"))).when(F.col("large").isNotNull(), keys("large")).otherwise(none)
    return own.withColumn("blocks", blocks).drop("n", "m", "large", "small")


def lines_of(docs: DataFrame) -> DataFrame:
    """(place, line, h1, h2) of every non-blank line of (doc_id, text); a place is (doc_id, text's hash, number)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("k"), F.posexplode(F.split("text", "\n", -1)).alias("at", "raw"))
    rows = rows.select(F.struct("doc_id", "k", "at").alias("place"), F.btrim("raw", F.lit(BLANKS)).alias("line")).where("line != ''")
    return rows.select("place", "line", F.xxhash64("line", F.lit(5)).alias("h1"), F.xxhash64(F.lit(6), "line").alias("h2"))


def able_lines(firsts: DataFrame) -> DataFrame:
    """(h1, h2, first, sides) of the distinct lines that another one shares a block with (counted, not paired).

    sides says on which side of the line an edit must be: 1 behind its first block, 2 before its last one, 3 either.
    """
    blocks = firsts.select("h1", "h2", F.posexplode("blocks").alias("n", "block"))
    shared = blocks.groupBy("block").agg(F.count("*").alias("c")).where("c > 1").select(F.col("block").alias("b"))
    able = blocks.join(shared, F.col("block") == F.col("b")).groupBy("h1", "h2").agg(F.bit_or(F.when(F.floor(F.col("n") / 2) % 2 == 0, 1).otherwise(2)).alias("sides"))
    return cut(able.join(firsts.select("h1", "h2", "first"), ["h1", "h2"]).select("h1", "h2", "first", "sides"))


def _texts(rows: DataFrame, able: DataFrame) -> DataFrame:
    """able with each line's text, which is fetched from its first place through a blocked Bloom filter of hashes."""
    own = able.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first", "sides")
    found = listed(rows, "h1", own, "g1", "able").where("able").select("h1", "h2", "line", "place")
    found = found.join(own, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & F.col("place").eqNullSafe(F.col("first")))
    return cut(found.select("h1", "h2", "first", "sides", "line").dropDuplicates(["h1", "h2"]))


def _best_within_one(texts: DataFrame) -> DataFrame:
    """(h1, h2, e1, e2): each line with the earliest other line within one edit, if that is earlier.

    Each line emits its variants with one character deleted, as hashed keys, and itself (place -1). Lines with the
    same variant at the same place differ by a substitution, a line that reads like a variant by an insertion. In
    either group the earliest line stands for all, so a group costs its size.
    """

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                of, keys, places = [], [], []
                for k, (line, sides) in enumerate(zip(part.column(4).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    half = 1 << ((len(line) // 2).bit_length() - 1)
                    small = half // 2 if len(line) & (len(line) - 1) == 0 else half
                    key, at = deletion_keys(line, small if sides == 1 else 0, len(line) - small if sides == 2 else len(line))
                    of.append(np.full(len(key) + 1, k))
                    keys.append(np.append(key, np.int64(line_key(line))))
                    places.append(np.append(at, np.int32(-1)))
                rows_of = pa.array(np.concatenate(of)) if of else pa.array([], pa.int64())
                cols = [part.column(0).take(rows_of), part.column(1).take(rows_of), part.column(2).take(rows_of)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(keys) if keys else [], pa.int64()), pa.array(np.concatenate(places) if places else [], pa.int32())], ["h1", "h2", "first", "key", "place"])

    kind = texts.schema["first"].dataType.simpleString()
    own = texts.mapInArrow(lean(variants), f"h1 long, h2 long, first {kind}, key long, place int")
    # One exchange by key serves both windows; a key's lines differ by one edit, so there are few of them.
    who = own.repartition("key").withColumn("w", F.struct("first", "h1", "h2"))
    all_, group = Window.partitionBy("key"), Window.partitionBy("key", "place")
    who = who.withColumns({"in_group": F.min("w").over(group)})
    who = who.withColumns({"whole": F.min(F.when(F.col("place") == -1, F.col("w"))).over(all_), "any": F.min("w").over(all_)})
    best = F.when(F.col("place") == -1, F.col("any")).otherwise(F.least(F.col("in_group"), F.col("whole")))
    return who.withColumn("best", best).where("best.first < first").select("h1", "h2", F.col("best.h1").alias("e1"), F.col("best.h2").alias("e2")).distinct()


def _best_within(texts: DataFrame, most: int) -> DataFrame:
    """As _best_within_one for any number of edits: every subset of up to `most` characters is deleted.

    Two variants that read alike come from lines whose distance is at most the number of gaps that either has, a gap
    of both counted once. Of the lines with the same variant and the same gaps the earliest stands for all; these few
    (their number depends on a line's length alone) are held against each other, the lines never.
    """

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h1, h2, first, line in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(4).to_pylist(), strict=True):
                found = subsets_keys(line, most)
                while some := list(itertools.islice(found, 5000)):
                    again = lambda x, n=len(some): pa.repeat(x, n)
                    yield pa.RecordBatch.from_arrays([again(h1), again(h2), again(first), pa.array([k for k, _ in some], pa.int64()), pa.array([g for _, g in some], pa.list_(pa.int32()))], ["h1", "h2", "first", "key", "gaps"])

    kind = texts.schema["first"].dataType.simpleString()
    own = cut(texts.mapInArrow(lean(variants), f"h1 long, h2 long, first {kind}, key long, gaps array<int>"))
    groups = cut(own.groupBy("key", "gaps").agg(F.min(F.struct("first", "h1", "h2")).alias("w")))
    others = groups.select("key", F.col("gaps").alias("theirs"), F.col("w").alias("other"))
    near = groups.join(others, "key").where(F.size("gaps") + F.size("theirs") - F.size(F.array_intersect("gaps", "theirs")) <= most)
    best = near.groupBy("key", "gaps").agg(F.min("other").alias("best"))
    pairs = own.join(best, ["key", "gaps"]).where("best.first < first")
    return pairs.select("h1", "h2", F.col("best.h1").alias("e1"), F.col("best.h2").alias("e2")).distinct()


def near_lines(rows: DataFrame, firsts: DataFrame, max_edits: int) -> DataFrame:
    """(h1, h2) of the distinct lines that have another distinct line within the bound at an earlier first place.

    Variants with characters deleted are emitted as hashed keys and equal ones joined; matches are verified by edit
    distance. For a bound of one edit only lines that share half of themselves with another line emit anything, and
    only on the side where the edit must be, which loses no match; for more edits every line does.
    """
    able = able_lines(firsts) if max_edits == 1 else firsts.where(F.size("blocks") > 0).select("h1", "h2", "first", F.lit(3).alias("sides"))
    texts = _texts(rows, able)
    pairs = _best_within_one(texts) if max_edits == 1 else _best_within(texts, max_edits)
    a = texts.select("h1", "h2", F.col("line").alias("a"))
    b = texts.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("b"))
    return pairs.join(a, ["h1", "h2"]).join(b, ["e1", "e2"]).where(F.levenshtein("a", "b", max_edits) >= 0).select("h1", "h2").distinct()


def _rewrite(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """text, n_lines, n_kept of texts and the numbers of the lines to keep."""
    for text, keep in parts:
        out = []
        for t, at in zip(text, keep, strict=True):
            if not isinstance(t, str):
                out.append((None, 0, 0))
                continue
            kept = set() if at is None else set(at.tolist())
            lines = t.split("\n")
            full = [not _BLANK.fullmatch(x) for x in lines]
            stay = [x for k, x in enumerate(lines) if not full[k] or k in kept]
            out.append((t if len(stay) == len(lines) else "\n".join(stay), sum(full), len(kept)))
        yield pd.DataFrame(out, columns=["text", "n_lines", "n_kept"])


def dedup_lines(docs: DataFrame, max_edits: int = 1, min_near: int = MIN_NEAR) -> DataFrame:
    """docs with text's repeated lines removed, plus n_lines and n_kept (non-blank lines before and after).

    A line (white space at its ends apart) is removed if an equal line, or one of min_near characters or more within
    max_edits edits of it (a character put in, left out or replaced; 0: equal lines only), stands at an earlier place;
    both lines must have min_near characters for that. Places are ordered by doc_id (null first), the text's hash and
    the line's number. Whether the earlier line itself stays does not matter. A line of n characters has n + 1
    variants at a bound of one edit and about n ** max_edits / max_edits! beyond.

    Blank lines stay. Null text stays null, empty text empty. Rows that repeat both id and text have the same places
    and so the same fate. Columns of docs named n_lines or n_kept are replaced, all others stay, whatever their names.
    An empty table gives an empty one.

    Lines are grouped by two 64-bit hashes with partial aggregation, so a line that a third of all rows share is one
    row a task. The lines that stay are gathered by document, never by line. Variants are known by 64-bit hashes; a
    collision could hide a match behind a false one (which the verification removes), never remove a line.
    """
    docs = docs.drop("n_lines", "n_kept")
    rows = lines_of(docs.select("doc_id", "text"))
    keyed = with_blocks(rows, min_near) if max_edits else rows.withColumn("blocks", F.array().cast("array<bigint>"))
    firsts = cut(keyed.select("h1", "h2", "place", "blocks").groupBy("h1", "h2").agg(F.min("place").alias("first"), F.first("blocks").alias("blocks")))
    stay = firsts.select("h1", "h2", "first")
    if max_edits:
        stay = stay.join(near_lines(rows, firsts, max_edits), ["h1", "h2"], "left_anti")
    stay = stay.select("first.*").groupBy("doc_id", "k").agg(F.collect_list("at").alias("keep")).select(F.col("doc_id").alias("sid"), F.col("k").alias("sk"), "keep")
    own = pack(docs, id="doc_id", text="text").withColumn("key", F.xxhash64("text"))
    joined = own.join(stay, F.col("id").eqNullSafe(F.col("sid")) & (F.col("key") == F.col("sk")), "left")
    # Not deterministic for the optimizer: a filter on n_kept must not evaluate it a second time.
    rewrite = F.pandas_udf(lean(_rewrite), "struct<text string, n_lines int, n_kept int>").asNondeterministic()
    done = joined.withColumn("r", rewrite("text", "keep"))
    return done.select(*unpack(docs.columns, text="r.text", n_lines="r.n_lines", n_kept="r.n_kept"))
