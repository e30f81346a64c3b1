"""Linear text models on hashed n-grams: toxicity (naive Bayes scaled) and ordinal quality (cumulative link)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, held_out, lean, mix, pack, unpack

#: Rows that a model learns from: about so many of each class (or grade), those whose ids have the smallest hashes, and
#: so many in all. There may be so many distinct grades.
MAX_TRAIN_PER_CLASS, MAX_TRAIN, MAX_GRADES = 4000, 16_000, 1000


def sample_labels(labels: DataFrame, grade: str, n: int = MAX_TRAIN_PER_CLASS) -> DataFrame:
    """(doc_id, y, w): about n labelled rows of each grade, never held-out ones; w restores the grades' shares.

    Grades are any numbers. A document with several labels keeps its highest one; null, NaN and infinite labels and
    null ids do not count. More than MAX_GRADES distinct grades are an error: they should be binned first. With many
    grades n falls to MAX_TRAIN / grades, so the result has about MAX_TRAIN rows at most and may be broadcast.
    A grade of more than n rows gives those whose id's hash is below n / rows of the hash's range: nothing is sorted,
    and no grade ever meets in one task.
    """
    y = F.col(grade).cast("double")
    rows = labels.where(y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(y).alias("y"))
    counts = cut(rows.groupBy("y").agg(F.count("*").alias("total")))
    grades = counts.count()
    if grades > MAX_GRADES:
        raise ValueError(f"{grades} distinct grades, more than {MAX_GRADES}: bin them first")
    weight = F.greatest(F.lit(1.0), F.col("total") / max(1, min(n, MAX_TRAIN // max(1, grades))))
    place = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(11)), 11) / float(1 << 53)
    return rows.join(F.broadcast(counts), "y").withColumn("w", weight).where(place * F.col("w") < 1).select("doc_id", "y", "w")


# --- character n-grams ---------------------------------------------------------------------------------------------


def _points(text: str) -> np.ndarray:
    """Code points of the lower-cased text, white space folded, one space at either end."""
    return np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def ngram_hashes(text: str, n: int, bits: int) -> np.ndarray:
    """One hash below 2**bits for each position's n-gram."""
    p = _points(text)
    if len(p) < n:
        return np.empty(0, np.int64)
    acc = np.full(len(p) - n + 1, n, np.uint64)
    for k in range(n):
        acc = acc * np.uint64(0x100000001B3) + p[k : k + len(acc)]
    return (mix(acc) >> np.uint64(64 - bits)).astype(np.int64)


BITS, ORDERS = 20, (4, 6)


def present(text: str) -> np.ndarray:
    """Distinct features of a text: hashed n-grams of every order, as far as the text goes."""
    return np.unique(np.concatenate([ngram_hashes(text, n, BITS) for n in ORDERS]))


def fit_logistic(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sparse 0/1 rows scaled by values, by accelerated gradient steps."""
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b, mw, mb, vw, vb = np.zeros(len(values)), 0.0, np.zeros(len(values)), 0.0, np.zeros(len(values)), 0.0
    total = weight.sum()
    x = values[flat]
    for t in range(1, steps + 1):
        z = np.bincount(of, w[flat] * x, len(rows)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight / total
        gw, gb = np.bincount(flat, g[of] * x, len(values)) + l2 * w, g.sum()
        mw, mb, vw, vb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb, 0.999 * vw + 0.001 * gw**2, 0.999 * vb + 0.001 * gb**2
        lr = 0.1 * min(1.0, 2 * (1 - t / (steps + 1)))
        w -= lr * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.999**t)) + 1e-9)
        b -= lr * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    return w, b


def _labelled(docs: DataFrame, labels: DataFrame, grade: str, n: int) -> DataFrame:
    """(doc_id, y, w, text) of the sampled labels' documents, one text an id (of several that with the smallest hash).

    The sample is bounded and broadcast; documents do not shuffle, and repeated ids meet pre-aggregated.
    """
    sample = sample_labels(labels, grade, n).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("doc_id", "y", "w").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "y", "w", "text")


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_per_class: int = MAX_TRAIN_PER_CLASS, keep: int = 4096, steps: int = 300) -> dict:
    """A linear classifier on presence of character n-grams, each scaled by its naive Bayes log-count ratio.

    Ratios r = log(p / q) come from smoothed document counts of each class over the whole sample, by aggregation on
    the executors; the model's size is `keep` features, those of the largest |r| * sqrt(support). A logistic regression
    on the scaled features, fitted on the driver on about 2 * max_per_class rows of feature numbers, gives the
    weights. Labels above 0 count as 1. Without labels of both classes the score is the share of label 1, 0 without
    labels.
    """
    labels = labels.select("doc_id", (F.col(label) > 0).cast("int").alias("y"))
    rows = _labelled(docs, labels, "y", max_per_class)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feats = pa.array([present(x.as_py() or "").astype(np.int32) for x in batch.column(3)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), feats], ["doc_id", "y", "w", "f"])

    feats = cut(rows.mapInArrow(lean(featurize), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y double, w double, f array<int>"))
    totals = {r.y: (r.n, r.w) for r in feats.groupBy("y").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()}
    if not {0, 1} <= set(totals):
        ones = sum(w for y, (_, w) in totals.items() if y > 0)
        rate = ones / max(1.0, sum(w for _, w in totals.values()))
        return {"ids": np.empty(0, np.int64), "w": np.empty(0), "b": float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))}
    n0, n1 = totals[0][0], totals[1][0]
    counts = feats.select("y", F.explode("f").alias("i")).groupBy("i").agg(F.count_if(F.col("y") == 1).alias("c1"), F.count_if(F.col("y") == 0).alias("c0"))
    p, q = (F.col("c1") + 1) / F.lit(n1 + 2.0), (F.col("c0") + 1) / F.lit(n0 + 2.0)
    ratio = counts.select("i", F.log(p / q).alias("r"), (F.col("c0") + F.col("c1")).alias("n"))
    top = ratio.orderBy(F.desc(F.abs("r") * F.sqrt("n")), "i").limit(keep).collect()
    ids = np.array([t.i for t in top], np.int64)
    order = np.argsort(ids)
    ids, r = ids[order], np.array([t.r for t in top])[order]

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.nonzero(np.isin(ids, np.asarray(x.values)))[0].astype(np.int32) if x.values is not None else [] for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(own, pa.list_(pa.int32()))], ["doc_id", "y", "w", "f"])

    got = feats.mapInArrow(lean(select), feats.schema).orderBy("doc_id", "y").select("y", "w", "f").toArrow()
    drop_cut(feats)
    y, wt = got.column("y").to_numpy().astype(float), got.column("w").to_numpy()
    lists = [np.asarray(x.values, np.int64) for x in got.column("f")]
    w, b = fit_logistic(lists, r, y, wt, 1e-4, steps)
    return {"ids": ids, "w": w * r, "b": float(b)}


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """Adds score (0 to 1) to every row, from its whole text; null and empty texts have the bias' score."""
    ids, w, b = model["ids"], model["w"], model["b"]

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = np.zeros(1 << BITS)
        dense[ids] = w
        for texts in parts:
            out = np.empty(len(texts))
            for k, text in enumerate(texts):
                total = b
                if isinstance(text, str) and text:
                    h = np.concatenate([ngram_hashes(text, n, BITS) for n in ORDERS])
                    h = np.unique(h[dense[h] != 0])
                    total += dense[h].sum()
                out[k] = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
            yield pd.Series(out)

    return docs.withColumn("score", F.pandas_udf(lean(score), "double")(F.col("text")))


def classify_toxicity(docs: DataFrame, labels: DataFrame, text_docs: DataFrame | None = None, **params) -> DataFrame:
    """docs plus held_out, score, predicted of every row; learns from text_docs (docs if None).

    Repeated rows each get their score, null ids are held out, null text scores like an empty one; an empty labels
    table gives score 0 (to 1e-6). Columns of docs named held_out, score or predicted are replaced, others stay.
    """
    model = fit_toxicity(docs if text_docs is None else text_docs, labels, **params)
    own = docs.drop("held_out", "score", "predicted")
    scored = score_toxicity(pack(own, id="doc_id", text="text"), model)
    return scored.select(*unpack(own.columns, text="text", held_out=held_out(F.col("id")), score="score", predicted=(F.col("score") >= 0.5).cast("int")))


# --- ordinal quality ------------------------------------------------------------------------------------------------

Q_BITS = 15
#: Hashed words and shapes, and behind them the shares of repeated neighbours and of repeated words.
Q_SIZE = (1 << Q_BITS) + 2


def quality_vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text and their values.

    Words (lower-cased) and character trigrams of the text's shape (letters a or A, digits 0, white space one blank,
    the rest as is) are counted; log-damped word counts are scaled to length 1, shapes to the root of their shares. Two
    columns of their own have the share of words that repeat the one before and of words that stand elsewhere too.
    """
    import xxhash

    words = text.split()
    keys: dict[bytes, int] = {}
    prev, same = b"", 0
    low = [w.lower().encode("utf-8", "surrogatepass") for w in words]
    for w in low:
        keys[w] = keys.get(w, 0) + 1
        same += w == prev
        prev = w
    h = np.fromiter((xxhash.xxh3_64_intdigest(k, 3) >> (64 - Q_BITS) for k in keys), np.int64, len(keys))
    counts = np.bincount(h, np.fromiter(keys.values(), float, len(keys)), 1 << Q_BITS) if len(keys) else np.zeros(1 << Q_BITS)
    p = np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lower, upper = ((p >= 97) & (p <= 122)) | (p > 191), (p >= 65) & (p <= 90)
    shape = np.where(lower, 97, np.where(upper, 65, np.where((p >= 48) & (p <= 57), 48, p))).astype(np.uint64)
    if len(shape) >= 3:
        tri = mix((shape[:-2] * np.uint64(1315423911) + shape[1:-1]) * np.uint64(2654435761) + shape[2:]) >> np.uint64(64 - Q_BITS)
        shapes = np.bincount(tri.astype(np.int64), minlength=1 << Q_BITS)
    else:
        shapes = np.zeros(1 << Q_BITS)
    out = np.log1p(counts)
    norm = np.sqrt((out**2).sum()) or 1.0
    out /= norm
    total = shapes.sum()
    if total:
        out += 3 * np.sqrt(shapes / total)
    extra = [3 * same / len(words), 1 - len(keys) / len(words)] if words else [0.0, 0.0]
    out = np.concatenate([out, extra])
    at = np.nonzero(out)[0]
    return at, out[at]


def fit_ordinal(docs: DataFrame, labels: DataFrame, grade: str = "quality", max_per_grade: int = MAX_TRAIN_PER_CLASS, steps: int = 250, l2: float = 3e-5) -> dict:
    """Cumulative-link (proportional odds) regression: P(grade <= g) = sigmoid(threshold_g - w.x), one w for all grades.

    Learns from about max_per_grade rows of each grade (sample_labels), weighted back to their shares. Feature vectors
    are made on the executors; the driver gets the sample's sparse vectors.
    """
    rows = _labelled(docs, labels, grade, max_per_grade)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [quality_vector(x.as_py() or "") for x in batch.column(3)]
            cols = [batch.column(0), batch.column(1), batch.column(2), pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[1].astype(np.float32) for g in got], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "y", "w", "i", "v"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(lean(featurize), f"doc_id {kind}, y double, w double, i array<int>, v array<float>").orderBy("doc_id", "y").toArrow().combine_chunks()
    grades, y = np.unique(got.column("y").to_numpy(), return_inverse=True)
    if len(grades) < 2:
        return {"grades": grades, "w": np.zeros(Q_SIZE), "theta": np.empty(0)}
    flat = [np.asarray(c.chunk(0).flatten()) for c in (got.column("i"), got.column("v"))]
    sizes = np.diff(np.asarray(got.column("i").chunk(0).offsets))
    w, theta = solve_ordinal(sizes, flat[0].astype(np.int64), flat[1].astype(float), y, got.column("w").to_numpy(), Q_SIZE, steps, l2)
    return {"grades": grades, "w": w, "theta": theta}


def solve_ordinal(sizes: np.ndarray, flat: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int, steps: int, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of sparse rows (sizes, columns, values) and their grades' numbers 0, 1, .. .

    Accelerated gradient steps on the weighted mean negative log-likelihood plus l2 / 2 * |w|^2. Thresholds stay ordered
    because only the first and the logs of the gaps are free. Cost a step: the values, the rows and the grades.
    """
    weight = weight / weight.sum()
    of, n, k = np.repeat(np.arange(len(y)), sizes), len(y), int(y.max())
    share = np.cumsum(np.bincount(y, weight, k + 1))[:-1]
    theta = np.log(share / (1 - share))
    free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    w = np.zeros(width)
    state = [np.zeros(width + k) for _ in range(2)]
    for t in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        z = np.bincount(of, w[flat] * x, n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = _sigmoid(edges[y + 1] - z), _sigmoid(edges[y] - z)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        gtheta = np.bincount(y, -weight * dhi / p, k + 1)[:k] + np.bincount(y, weight * dlo / p, k + 1)[1:]
        after = np.cumsum(gtheta[::-1])[::-1]  # a gap moves every threshold behind it
        gfree = np.concatenate([after[:1], np.exp(free[1:]) * after[1:]])
        g = np.concatenate([np.bincount(flat, (weight * (dhi - dlo) / p)[of] * x, width) + l2 * w, gfree])
        state = [0.9 * state[0] + 0.1 * g, 0.999 * state[1] + 0.001 * g**2]
        step = 0.05 * min(1.0, 2 * (1 - t / (steps + 1))) * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-9)
        w, free = w - step[:width], free - step[width:]
    return w, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score_quality(docs: DataFrame, model: dict, tail_from: float | None = None) -> DataFrame:
    """Adds expected_grade and tail_probability to every row: that the grade is tail_from (None: the highest) or more.

    A model without grades gives null for both; one with a single grade expects that of all.
    """
    grades, w, theta = model["grades"], model["w"].astype(np.float32), model["theta"]
    if not len(grades):
        return docs.withColumns({"expected_grade": F.lit(None).cast("double"), "tail_probability": F.lit(None).cast("double")})
    below = int(np.searchsorted(grades, grades[-1] if tail_from is None else tail_from))  # grades under the tail

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            e, tail = np.empty(len(texts)), np.empty(len(texts))
            for k, text in enumerate(texts):
                at, x = quality_vector(text if isinstance(text, str) else "")
                cdf = np.concatenate([[0.0], _sigmoid(theta - w[at].astype(float) @ x), [1.0]])
                e[k], tail[k] = np.diff(cdf) @ grades, 1 - cdf[below]
            yield pd.DataFrame({"e": e, "t": tail})

    udf = F.pandas_udf(lean(score), "struct<e double, t double>")
    return docs.withColumn("_s", udf(F.col("text"))).withColumns({"expected_grade": F.col("_s.e"), "tail_probability": F.col("_s.t")}).drop("_s")


def grade_quality(docs: DataFrame, labels: DataFrame, select_at: float = 0.5, tail_from: float | None = None, **params) -> DataFrame:
    """docs plus held_out, expected_grade, tail_probability and selected (tail probability of select_at or more).

    The tail is the grades from tail_from on, the highest one alone if None. Repeated rows each get their grade; null
    text counts as empty, null ids are held out. With labels of one grade only that grade is expected of all, with
    tail probability 1 if it is in the tail, else 0. Without labels both are null and nothing is selected. Columns of
    docs of these names are replaced, others stay.
    """
    own = docs.drop("held_out", "expected_grade", "tail_probability", "selected")
    scored = score_quality(pack(own, id="doc_id", text="text"), fit_ordinal(docs, labels, **params), tail_from)
    selected = F.coalesce(F.col("tail_probability") >= select_at, F.lit(False))
    return scored.select(*unpack(own.columns, text="text", held_out=held_out(F.col("id")), expected_grade="expected_grade", tail_probability="tail_probability", selected=selected))
