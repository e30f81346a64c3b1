"""N-gram Jaccard join under several global token orders, and the components of its links."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import cut, drop_cut, lean, mix, pack, partitions, release, shingles, unpack

#: Sets link if 100 * shared >= PERCENT * union.
PERCENT = 75
#: A chunk is so many documents or tokens of one input partition, whichever comes first.
CHUNK_DOCS, CHUNK_TOKENS = 512, 300_000
#: Hash buckets of tokens for each shuffle partition; a worker holds one bucket at a time.
BUCKETS_A_PART = 4
#: Ids that are broadcast at most: 64 MB as rows of 16 bytes.
BROADCAST_IDS = 4_000_000
#: Pairs that are broadcast at most: 48 MB as rows of 24 bytes.
BROADCAST_PAIRS = 2_000_000
#: A token of more than this share of a chunk's distinct sets (32 of them at least) is frequent everywhere.
FREQUENT_SHARE, FREQUENT = 16, np.uint32(0xFFFFFFFF)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, each behind its length and type."""
    out = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        out += [a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), a.tobytes()]
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 4
    for _ in range(int.from_bytes(blob[:4], "little")):
        kind, n = np.dtype(blob[at : at + 4].decode().strip()), int.from_bytes(blob[at + 4 : at + 12], "little")
        out.append(np.frombuffer(blob, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers (cumsum undoes it), in a byte each if they fit."""
    steps = np.diff(ascending, prepend=ascending.dtype.type(0))
    return steps.astype(np.uint8) if not len(steps) or steps.max() < 256 else steps


def prefix_length(n: int) -> int:
    """Of two linking sets' first so many tokens under any one order, one is shared."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


# --- 1. tokens of all documents meet by token: which are shared, and by how many ----------------------------------


def _chunk(number: int, ids: list[int], sets: list[np.ndarray], buckets: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Messages (bucket, chunk, kind, blob) of one chunk: its distinct sets' tokens by bucket, and what it has.

    Documents with equal sets are one leader (the smallest id) and its members. Frequent tokens go out once, with
    their count; all others leader by leader, each token with the step from the leader of the one before.
    """
    lead: dict[bytes, int] = {}
    order = sorted(range(len(ids)), key=ids.__getitem__)
    leaders, member_of = [], np.zeros(len(ids), np.int32)
    for k in order:
        key = sets[k].tobytes() if len(sets[k]) else b"empty %d" % ids[k]
        if key not in lead:
            lead[key] = len(leaders)
            leaders.append(k)
        member_of[k] = lead[key]
    own = [sets[k] for k in leaders]
    sizes = np.array([len(s) for s in own], np.int64)
    token = np.concatenate(own) if own else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(own), dtype=np.uint16), sizes)
    at = np.argsort(token, kind="stable")
    token, doc = token[at], doc[at]
    starts = np.nonzero(np.concatenate([[True], token[1:] != token[:-1]]))[0] if len(token) else np.empty(0, np.int64)
    counts = np.diff(np.append(starts, len(token)))
    hot = token[starts[counts > max(32, len(own) // FREQUENT_SHARE)]]
    is_hot = np.isin(token, hot)
    hot_token, hot_doc, token, doc = token[is_hot], doc[is_hot], token[~is_hot], doc[~is_hot]
    h1 = np.array([int(mix(s).sum(dtype=np.uint64)) for s in own], np.uint64)
    h2 = np.array([int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for s in own], np.uint64)
    meta = _pack(np.array([ids[k] for k in leaders], np.int64), sizes, h1, h2, hot_token, hot_doc, np.array(ids, np.int64), member_of)
    yield number % buckets, number, 0, meta
    bucket, hot_bucket = (token % np.uint64(buckets)).astype(np.int64), (hot % np.uint64(buckets)).astype(np.int64)
    at = np.lexsort((doc, bucket))
    token, doc, bucket = token[at], doc[at], bucket[at]
    used = np.unique(np.concatenate([bucket, hot_bucket]))  # so a chunk sends a message for each of its tokens at most
    lows, highs = np.searchsorted(bucket, used), np.searchsorted(bucket, used, "right")
    for b, low, high in zip(used.tolist(), lows.tolist(), highs.tolist(), strict=True):
        yield b, number, 1, _pack(token[low:high], _steps(doc[low:high]), hot[hot_bucket == b])


def _messages(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names)


_SHAPE, _NAMES = "bucket int, chunk long, kind int, blob binary", ["bucket", "chunk", "kind", "blob"]


def _send(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        ids: list[int] = []
        sets: list[np.ndarray] = []
        total = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                sets.append(shingles(text.as_py()))
                total += len(sets[-1])
                if len(ids) >= CHUNK_DOCS or total >= CHUNK_TOKENS:
                    yield _messages(list(_chunk(next(numbers), ids, sets, buckets)), _NAMES)
                    ids, sets, total = [], [], 0
        if ids:
            yield _messages(list(_chunk(next(numbers), ids, sets, buckets)), _NAMES)

    return docs.mapInArrow(lean(run), _SHAPE)


def _answer(bucket: pa.Table) -> pa.Table:
    """For each chunk, its documents' tokens of this bucket that more than one set has, with their counts."""
    kinds, chunks, blobs = (bucket.column(c).to_pylist() for c in ("kind", "chunk", "blob"))
    out = [(0, c, 0, b) for k, c, b in zip(kinds, chunks, blobs, strict=True) if k == 0]
    got = [(c, *_unpack(b)) for k, c, b in zip(kinds, chunks, blobs, strict=True) if k == 1]
    if got:
        token, doc = np.concatenate([g[1] for g in got]), np.concatenate([np.cumsum(g[2], dtype=np.uint16) for g in got])
        of = np.repeat(np.arange(len(got)), [len(g[1]) for g in got])
        at = np.argsort(token)
        sorted_ = token[at]
        starts = np.nonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))[0] if len(token) else np.empty(0, np.int64)
        counts = np.diff(np.append(starts, len(token)))
        df = np.empty(len(token), np.uint32)
        df[at] = np.repeat(counts, counts).astype(np.uint32)
        df[np.isin(token, np.unique(np.concatenate([g[3] for g in got])))] = FREQUENT
        keep = df > 1
        token, doc, of, df = token[keep], doc[keep], of[keep], df[keep]
        ends = np.searchsorted(of, np.arange(len(got) + 1))
        for k, g in enumerate(got):
            if ends[k] < ends[k + 1]:
                s = slice(ends[k], ends[k + 1])
                out.append((0, g[0], 1, _pack(token[s], doc[s], df[s])))
    release()
    return pa.Table.from_batches([_messages(out, _NAMES)])


# --- 2. documents again: those that enough shared tokens allow a link, with their prefixes --------------------------

#: The first order is that of rarity. The others are by independent hashes, so a frequent token may come early in them;
#: in every order tokens of one set alone come first, which never match and so shorten the prefix.
_SEEDS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25))

_DOC_SHAPE = "doc_id long, n long, leader long, alive boolean, h1 long, h2 long, tokens binary, first binary, second binary, third binary"


def _gather(chunk: pa.Table) -> pa.Table:
    """Rows of a chunk's documents. A leader is alive if it shares enough tokens for any link; only then it has
    tokens: all shared ones ascending, its prefix of the first order in that order, those of the others ascending."""
    blobs = [(k, _unpack(b)) for k, b in zip(chunk.column("kind").to_pylist(), chunk.column("blob").to_pylist(), strict=True)]
    lead, sizes, h1, h2, hot_token, hot_doc, ids, member_of = next(b for k, b in blobs if k == 0)
    rest = [b for k, b in blobs if k == 1]
    token, doc = np.concatenate([hot_token, *[b[0] for b in rest]]), np.concatenate([hot_doc, *[b[1] for b in rest]])
    df = np.concatenate([np.full(len(hot_token), FREQUENT), *[b[2] for b in rest]])
    at = np.lexsort((token, doc))
    token, doc, df = token[at], doc[at], df[at]
    ends = np.searchsorted(doc, np.arange(len(lead) + 1))
    cols: list[list] = [[] for _ in range(10)]
    packed = []
    for k, n in enumerate(sizes.tolist()):
        t, f = token[ends[k] : ends[k + 1]], df[ends[k] : ends[k + 1]]
        if not n or 100 * len(t) < PERCENT * n:
            packed.append((False, None, None, None, None))
            continue
        length = prefix_length(n) - (n - len(t))  # tokens of one set come first in every order and match nothing
        first = t[np.lexsort((t, f))[:length]]
        others = [np.sort(t[np.argpartition(mix(t ^ seed), length - 1)[:length]]) for seed in _SEEDS]
        packed.append((True, t.tobytes(), first.tobytes(), *[x.tobytes() for x in others]))
    done = set()
    for i, m in zip(ids.tolist(), member_of.tolist(), strict=True):
        own = int(lead[m]) == i and m not in done
        if own:
            done.add(m)
        values = (i, int(sizes[m]), int(lead[m]), own and packed[m][0], int(h1[m].view(np.int64)), int(h2[m].view(np.int64)), *(packed[m][1:] if own else (None,) * 4))
        for c, v in zip(cols, values, strict=True):
            c.append(v)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
    names = [x.split()[0] for x in _DOC_SHAPE.split(", ")]
    release()
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


# --- 3. candidates by prefix tokens, verified; components -----------------------------------------------------------


def _fits(na: Column, sa: Column, nb: Column, sb: Column) -> Column:
    """Whether sets of n tokens can link if a token that they share is their first: they share at most the smaller s,
    the shared tokens of a set from that one on."""
    return (100 + PERCENT) * F.least(sa, sb) >= PERCENT * (na + nb)


def _reach(n: Column, s: Column) -> Column:
    """The largest size that a partner may have (_fits)."""
    return F.floor((100 + PERCENT) * s / PERCENT - n)


def _band(n: Column, per_link: int) -> Column:
    """Number of a size on a log scale; sizes that allow a link are per_link bands apart at most, and one."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) * (per_link / math.log(100 / PERCENT))).cast("int")


def _prefix_rows(sets: DataFrame, column: str) -> DataFrame:
    """(token, id, n, s) for each prefix token of each set; s counts the set's shared tokens from this one on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(3)]
            of = pa.array(np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]), pa.int64())
            left = [s - np.arange(len(t)) for s, t in zip(batch.column(2).to_pylist(), tokens, strict=True)]
            flat = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (tokens, left)]
            yield pa.RecordBatch.from_arrays([flat[0], batch.column(0).take(of), batch.column(1).take(of), flat[1]], ["token", "id", "n", "s"])

    return sets.select("id", "n", "s", column).mapInArrow(lean(run), "token long, id long, n long, s long")


def _stars(rows: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: each prefix row with the pivots of its token, in its own band of sizes and the next.

    A pivot is the set with the smallest share of tokens before this one or in no other set: it can link with most.
    """
    banded = rows.withColumn("k", _band(F.col("n"), 2))
    purest = F.min(F.struct(((F.col("n") - F.col("s")) / F.col("n")).alias("own"), "id", "n", "s")).alias("p")
    pivots = banded.groupBy("token", "k").agg(purest).select(F.col("token").alias("t"), F.explode(F.array(F.col("k"), F.col("k") - 1)).alias("pk"), "p")
    met = banded.join(pivots, (F.col("token") == F.col("t")) & (F.col("k") == F.col("pk")))
    met = met.where((F.col("id") != F.col("p.id")) & _fits(F.col("n"), F.col("s"), F.col("p.n"), F.col("p.s")))
    return met.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()


def _pairs_where(pairs: DataFrame, sets: DataFrame, columns: tuple[str, ...], test) -> DataFrame:
    """The pairs (a, b) for which test(values of a, values of b) holds; only the named columns of sets travel."""
    ends = [sets.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]) for end in "ab"]
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(i) for i in range(2, 2 + 2 * k)], strict=True)
            values = ([x.as_py() for x in row] for row in rows)
            mask = pa.array([test(v[:k], v[k:]) for v in values], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    pairs = cut(pairs)
    if pairs.count() <= BROADCAST_PAIRS:  # then only the sets in pairs travel; else both sides shuffle
        pairs, ends[1] = F.broadcast(pairs), ends[1].join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
    joined = pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", *[f"{c}_a" for c in columns], *[f"{c}_b" for c in columns])
    return joined.mapInArrow(lean(run), "a long, b long")


def _tokens(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def _agree(a: list, b: list) -> bool:
    """Whether two sets share a token of their prefixes under each of the other orders."""
    return all(_shared(_tokens(x), _tokens(y)) for x, y in zip(a, b, strict=True))


def _linked(a: list, b: list) -> bool:
    both = _shared(_tokens(a[1]), _tokens(b[1]))
    return 100 * both >= PERCENT * (a[0] + b[0] - both)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. All orders must agree on a candidate before whole sets travel and are compared."""
    agreed = _pairs_where(pairs, sets, ("second", "third"), _agree)
    return _pairs_where(agreed, sets, ("n", "tokens"), _linked)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows (token, .., label) of tokens that sets of more than one component have."""
    ends = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return rows.join(ends.select(F.col("token").alias("t")), F.col("token") == F.col("t"), "left_semi")


def _cross_pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of prefix rows (token, id, n, s, label): same token, labels that differ, and _fits.
    Tokens whose sets are all of one component give nothing: _mixed takes them out before.

    Each token's sets outside of its largest component meet the token's sets; those inside never meet one another. A
    set outside meets only those bands of sizes that hold a set of another component within reach, so one that is too
    far from a group of near-copies to link costs nothing. The join is on token and band, in exchanges that adaptive
    execution can split. What is known of a token's bands is bounded by the log of sizes.
    """
    known = rows.withColumns({"k": _band(F.col("n"), 8), "reach": _reach(F.col("n"), F.col("s"))})
    parts = known.groupBy("token", "k", "label").agg(F.count("*").alias("c"), F.max("reach").alias("top"))
    largest = F.max(F.struct("c", "label")).alias("main")
    bands = parts.groupBy("token", "k").agg(largest, F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("top").alias("top"))
    tokens = bands.groupBy("token").agg(F.max("main").alias("main"), F.collect_list(F.struct("k", "lo", "hi", "top")).alias("bands"))
    tokens = tokens.select(F.col("token").alias("t"), F.col("main.label").alias("main"), "bands")
    low, high = _band(F.floor(PERCENT * F.col("n") / 100), 8), _band(F.col("reach"), 8)

    def within_reach(b: Column) -> Column:
        other = (b["lo"] != F.col("label")) | (b["hi"] != F.col("label"))
        return other & (b["top"] >= F.col("n")) & b["k"].between(low, high)

    outside = known.join(tokens, F.col("token") == F.col("t")).where(F.col("label") != F.col("main"))
    outside = outside.withColumn("at", F.explode(F.transform(F.filter("bands", within_reach), lambda b: b["k"])))
    a = outside.select("token", F.col("at").alias("k"), F.col("id").alias("ia"), F.col("n").alias("na"), F.col("s").alias("sa"), F.col("label").alias("la"))
    b = known.select("token", "k", F.col("id").alias("ib"), F.col("n").alias("nb"), F.col("s").alias("sb"), F.col("label").alias("lb"))
    met = a.join(b, ["token", "k"]).where((F.col("la") != F.col("lb")) & _fits(F.col("na"), F.col("sa"), F.col("nb"), F.col("sb")))
    return met.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct()


def _known(ids: DataFrame) -> DataFrame:
    """One column of ids, cut; broadcast up to BROADCAST_IDS of them, beyond that the rows they meet shuffle."""
    held = cut(ids)
    return F.broadcast(held) if held.count() <= BROADCAST_IDS else held


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row with an id: exact components of the links at PERCENT Jaccard.

    Sets are the distinct five-word shingles (A-Z lower-cased words between ASCII white space); fewer words make one
    shingle, no words (null, empty) an empty set that links with nothing. Rows that share an id share a component.
    Rows with a null id come back with a null component_id and take no part. Other columns of docs are ignored.

    Every token of every set meets its equals once, as packed arrays by hash bucket, and learns how many sets have it.
    Documents with equal sets are one set; a token that many sets of a chunk have travels once a chunk. Under any
    order linking sets share a token of their prefixes. Candidates come from the order of rarity and must also share
    one under two orders by independent hashes; only then their whole sets are compared. Stars come first: in each
    token's group every set meets only the purest sets of about its size. The links found merge most near-copies into
    components. After that, only sets outside of a token's largest component that have another component within reach
    meet the token's other sets.

    Shingles are known by 64-bit hashes, sets that are equal by two of them and their size: a text links wrongly only
    if hashes of different shingles collide.
    """
    spark = docs.sparkSession
    buckets = max(partitions(spark), docs.rdd.getNumPartitions())
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sent = _send(own.where("id is not null"), BUCKETS_A_PART * buckets)
    answered = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answer, _SHAPE)
    rows = cut(answered.repartition(buckets, "chunk").groupBy("chunk").applyInArrow(_gather, _DOC_SHAPE))
    alive = rows.where("alive")
    classes = alive.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"))
    mapped = cut(alive.select("doc_id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"]).select(F.col("doc_id").alias("m"), "rep"))
    reps = mapped.where("m = rep").select("rep").distinct()
    sets = cut(alive.join(_known(reps), F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("id"), "n", (F.octet_length("tokens") / 8).cast("long").alias("s"), "tokens", "first", "second", "third"))
    prefix = _prefix_rows(sets, "first")
    edges = cut(_verify(_stars(prefix), sets))
    labels = cut(components(sets.select("id"), edges))
    labelled = cut(prefix.join(labels, "id"))
    mixed = cut(_mixed(labelled))
    drop_cut(labelled)
    more = cut(_verify(_cross_pairs(mixed), sets))
    drop_cut(mixed)
    if more.limit(1).count():  # what links between components makes further ones of their labels
        ends = more.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        tops = components(labels.select(F.col("label").alias("id")).distinct(), ends)
        labels = labels.join(tops.toDF("label", "top"), "label").select("id", F.col("top").alias("label"))
    final = mapped.join(labels, F.col("rep") == F.col("id")).select("m", "label").groupBy("m").agg(F.min("label").alias("label"))
    out = rows.join(final, F.col("leader") == F.col("m"), "left").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("label", "leader").alias("component_id"))
    lost = own.where("id is null").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(lost)


def keep_one_of_each(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose component has a smaller id, and of rows that repeat an id the first by text.

    Documents without words and rows with a null id stay. Other columns stay, whatever their names. Rows that go are
    known by ids alone; only rows that repeat an id are sorted, by id.
    """
    found = cut(jaccard_components(docs.select("doc_id", "text")) if found is None else found).where("doc_id is not null")
    away = _known(found.where("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct())
    repeated = _known(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice")))
    stay = pack(docs, id="doc_id", text="text").join(away, F.col("id") == F.col("gone"), "left_anti")
    first = F.row_number().over(Window.partitionBy("id").orderBy("text"))
    once = stay.join(repeated, F.col("id") == F.col("twice"), "left_semi").withColumn("n", first).where("n = 1").drop("n")
    return stay.join(repeated, F.col("id") == F.col("twice"), "left_anti").unionByName(once).select(*unpack(docs.columns, text="text"))
