"""Exact top-k inner products: vectors in buckets of like length, pruned by length or coordinate, then verified."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release
from .ranges import quantile_bounds, range_number

#: Rows of a bucket of vectors and of a block of queries, buckets and blocks that meet in one task, the longest vectors
#: that give every query a first lower bound of its k-th score, and ranges of lengths at most (their bounds are literals
#: of the plan; a range has as many buckets as its rows need).
BUCKET, QUERY_BLOCK, BUCKETS_A_TASK, BLOCKS_A_TASK, SEEDS, RANGES = 4096, 512, 4, 16, 1024, 512
#: From this local cosine threshold on, a coordinate rules more vectors out than their length does.
COORDINATE_FROM = 0.8


def usable(c: Column) -> Column:
    """Neither null nor holding null, NaN or infinite components."""
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """One row a vector; shorter vectors end in zeros."""
    if len(vectors) and all(len(v) == dim for v in vectors):
        return np.stack(vectors.to_numpy()).astype(np.float64)
    out = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.nonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])[0]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search_bucket(q_ids: np.ndarray, q: np.ndarray, theta: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of each query's k best in one bucket that reach its bound theta.

    theta / (|query| * longest vector here) is the query's local cosine threshold. Above 1 nothing here can reach it.
    If it is high, the query's largest coordinate f bounds the same coordinate of any unit vector p that reaches it:
    q_f * p_f + sqrt(1 - q_f^2) * sqrt(1 - p_f^2) >= threshold; others only compare with vectors that are long enough.
    What is left is verified by its product.
    """
    if not len(c) or not len(q):
        return []
    length = np.sqrt((c * c).sum(1))
    order = np.argsort(-length, kind="stable")
    c, c_ids, length = c[order], c_ids[order], length[order]
    unit = c / np.maximum(length, 1e-300)[:, None]
    q_len = np.sqrt((q * q).sum(1))
    found: list[tuple[int, int, int]] = []

    def keep(i: int, at: np.ndarray, scores: np.ndarray) -> None:
        on = (scores >= theta[i]) & (c_ids[at] != q_ids[i])
        at, scores = at[on], scores[on]
        best = _top(scores, c_ids[at], k)
        found.extend(zip([int(q_ids[i])] * len(best), c_ids[at[best]].tolist(), scores[best].astype(np.int64).tolist(), strict=True))

    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(theta <= 0, -np.inf, np.where(q_len > 0, theta / q_len, np.inf)) * (1 - 1e-9)
    long_enough = np.searchsorted(-length, -need, "right")
    local = need / max(length[0], 1e-300)
    by_length = np.nonzero((long_enough > 0) & (local < COORDINATE_FROM))[0]
    if len(by_length):
        upto = int(long_enough[by_length].max())
        products = q[by_length] @ c[:upto].T
        for i, row in zip(by_length, products, strict=True):
            at = np.nonzero(row[: long_enough[i]] >= theta[i])[0]
            keep(i, at, row[at])
    for i in np.nonzero((long_enough > 0) & (local >= COORDINATE_FROM))[0]:
        f = int(np.abs(q[i]).argmax())
        qf = q[i, f] / q_len[i]
        pf = unit[: long_enough[i], f]
        at = np.nonzero(qf * pf + np.sqrt(max(0.0, 1 - qf * qf)) * np.sqrt(np.maximum(0, 1 - pf * pf)) >= local[i] - 1e-9)[0]
        keep(i, at, c[at] @ q[i])
    return found


def exact_top_k(vectors: DataFrame, k: int = 20, query_divisor: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to the smaller id.

    Components become floor(scale * x). Queries are the rows whose id is divisible by query_divisor; candidates are all
    rows of other ids. Vectors that are null or hold null or non-finite components and rows without id take no part; of
    rows that repeat an id the smallest vector counts; of two vectors of unlike dimension the shorter ends in zeros.
    An empty table gives no rows. Components beyond 2**53 / scale and lengths whose square reaches 2**53, where products
    would no longer be exact, are an error. Other columns of vectors are ignored.

    Vectors are cut into RANGES ranges of length, and each by a hash of the id into buckets of about BUCKET rows, and
    queries into blocks. BUCKETS_A_TASK buckets of a range meet BLOCKS_A_TASK blocks at a time, the longest first, and
    what they give raises the queries' bounds for the next; a group of buckets too short for every query of a group of
    blocks never meets it. Which groups meet is a join of two tables of one row a group. A bucket gives at most k rows a
    query, so no group is large.
    """
    spark = vectors.sparkSession
    x = F.col(vec_col)
    own = vectors.where(F.col(id_col).isNotNull() & usable(x)).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("v"))
    own = own.groupBy("id").agg(F.min("v").alias("v"))
    own = cut(own.withColumns({"n2": F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b), "dim": F.size("v")}))
    n, dim, longest = own.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0)), F.coalesce(F.max("n2"), F.lit(0.0))).first()
    if longest >= 2.0**53:
        raise ValueError("inner products could reach 2**53; use a smaller scale")
    steps = sorted(set(quantile_bounds(own, "n2", min(RANGES, max(1, -(-n // BUCKET))))))
    number = range_number(F.col("n2"), steps, "double").cast("long")
    held = {r.r: r["count"] for r in own.groupBy(number.alias("r")).count().collect()}  # RANGES rows at most
    splits = F.element_at(F.array(*[F.lit(max(1, -(-held.get(r, 0) // BUCKET))).cast("long") for r in range(len(steps) + 1)]), (number + 1).cast("int"))
    key = F.shiftleft(number, 40) + F.pmod(F.xxhash64("id"), splits)
    seeds = own.orderBy(F.desc("n2"), "id").limit(SEEDS).toPandas()
    seed_ids, seed = seeds["id"].to_numpy(np.int64), _matrix(seeds["v"], dim)

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(pdf["v"], dim)
        return pd.DataFrame({"b": [pdf["b"].iloc[0]], "longest": [float(np.sqrt(pdf["n2"].max()))], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "m": [m.tobytes()], "theta": [b""]})

    def query_block(pdf: pd.DataFrame) -> pd.DataFrame:
        m, ids = _matrix(pdf["v"], dim), pdf["id"].to_numpy(np.int64)
        scores = np.where(seed_ids[None, :] == ids[:, None], -np.inf, m @ seed.T)
        theta = np.partition(scores, scores.shape[1] - k, 1)[:, scores.shape[1] - k] if scores.shape[1] >= k else np.full(len(ids), -np.inf)
        norms = np.sqrt((m * m).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(theta <= 0, -np.inf, np.where(norms > 0, theta / norms, np.inf))
        return pd.DataFrame({"b": [pdf["b"].iloc[0]], "longest": [float(need.min()) if len(need) else 0.0], "ids": [ids.tobytes()], "m": [m.tobytes()], "theta": [theta.astype(np.float64).tobytes()]})

    shape = "b long, longest double, ids binary, m binary, theta binary"
    buckets = cut(own.select("id", "v", "n2", key.alias("b")).groupBy("b").applyInPandas(bucket, shape))
    asked = own.where(F.col("id") % query_divisor == 0)
    n_blocks = max(1, -(-(n // query_divisor) // QUERY_BLOCK))
    blocks = cut(asked.select("id", "v", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n_blocks)).alias("b")).groupBy("b").applyInPandas(query_block, shape))
    # Groups of buckets and of blocks that may need each other: a row a group, by the lengths alone.
    group = lambda c: F.floor(F.col(c) / BUCKETS_A_TASK)  # noqa: E731  the buckets of a range are numbered on
    spans = buckets.groupBy(group("b").alias("cb")).agg(F.max("longest").alias("longest"))
    needs = blocks.groupBy(F.floor(F.col("b") / BLOCKS_A_TASK).alias("g")).agg(F.min("longest").alias("need"))
    cells = cut(spans.join(needs, F.col("longest") >= F.col("need") * (1 - 1e-9)).select("cb", "g"))
    left = cells.join(buckets.withColumn("bb", group("b")), F.col("cb") == F.col("bb")).select("cb", "g", "longest", "ids", "m", "theta", F.lit(0).alias("asks"))
    right = cells.join(blocks.withColumn("bg", F.floor(F.col("b") / BLOCKS_A_TASK)), F.col("g") == F.col("bg")).select("cb", "g", "longest", "ids", "m", "theta", F.lit(1).alias("asks"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        read = lambda b, kind=np.float64: np.frombuffer(b, kind)
        here = pdf[pdf["asks"] == 0].sort_values("longest", ascending=False)
        best: dict[int, list[tuple[int, int]]] = {}
        asks = [[read(i, np.int64), read(q).reshape(len(i) // 8, dim), read(t).copy()] for i, q, t in pdf.loc[pdf["asks"] == 1, ["ids", "m", "theta"]].itertuples(index=False)]
        for c_ids, c in zip(here["ids"], here["m"], strict=True):
            c_ids = read(c_ids, np.int64)
            c = read(c).reshape(len(c_ids), dim)
            for q_ids, q, theta in asks:
                for i, j, x in search_bucket(q_ids, q, theta, c_ids, c, k):
                    best.setdefault(i, []).append((-x, j))
                for at, i in enumerate(q_ids.tolist()):  # the k-th score so far is a bound for the next bucket
                    if len(found := best.get(i, [])) >= k:
                        found.sort()
                        del found[k:]
                        theta[at] = max(theta[at], -found[-1][0])
        rows = [(i, j, -x) for i, found in best.items() for x, j in found]
        release()
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    local = left.unionByName(right).groupBy("cb", "g").applyInPandas(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
