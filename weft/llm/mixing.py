"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions. DataFrame only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, pack, unpack


def words_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Adds target to rows (source, source_size, weight), one row a source.

    All sources share `share` times the total size by weight; a source that would exceed max_epochs times its size is
    clamped there and the excess goes to the rest by weight, until none is above. That fixed point is found in one
    sweep: sources sorted by the water level at which they clamp (max_epochs * size / weight); the level is what is
    left after the clamped ones, over the weight of the others, and the first source that the level does not reach
    ends the clamping. Both windows run over the sources table alone (one row a source, not the documents).
    """
    every = Window.partitionBy(F.lit(0))
    cap = F.lit(max_epochs) * F.col("source_size")
    order = Window.partitionBy(F.lit(0)).orderBy(cap / F.col("weight"), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total, weights = F.sum("source_size").over(every), F.sum("weight").over(every)
    left = F.least(F.lit(share), F.lit(max_epochs)) * total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    level = left / (weights - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = sources.withColumns({"_cap": cap, "_level": level, "_k": F.row_number().over(order)})
    open_ = F.when(F.col("_level") <= F.col("_cap") / F.col("weight"), F.col("_level"))
    first = F.min_by(open_, F.when(open_.isNotNull(), F.col("_k"))).over(every)
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("_cap"), F.coalesce(first, F.col("_level")) * F.col("weight")))
    return levels.withColumn("target", target).drop("_cap", "_level", "_k")


def weigh_sources(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, source_size, weight): sources by code point, null last, take the weights in turn."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).cast("long"))


def seeded_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def repeat_documents(docs: DataFrame, seed: str = "mix-1", **params) -> DataFrame:
    """docs as the mix takes them: each row as often as the whole and fractional repetitions of its source say.

    mix_sources with whole documents; only each source's place in the seeded order comes back to the documents, so
    their texts do not shuffle. Rows that repeat id, source and size are taken alike. A document without words is
    taken by none. Other columns stay, whatever their names.
    """
    mixed = mix_sources(docs, seed=seed, boundary="documents", **params)
    place = F.struct(seeded_key(F.col("doc_id"), seed).alias("key"), F.col("doc_id").alias("id"), F.col("size").alias("size"))
    whole = F.expr("case when source_size > 0 then cast(floor(target + 0.5) as bigint) div source_size else 0 end")
    more = F.col("taken") > whole * F.col("size")
    plan = mixed.groupBy(F.col("source").alias("s")).agg(F.min(whole).cast("int").alias("whole"), F.max(F.when(more, place)).alias("last"))
    rows = pack(docs, id="doc_id", source="source", text="text").withColumn("size", words_of(F.col("text"))).where("size > 0")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    own = F.struct(seeded_key(F.col("id"), seed).alias("key"), F.col("id").alias("id"), F.col("size").alias("size"))
    copies = F.col("whole") + F.when(own <= F.col("last"), 1).otherwise(0)
    taken = rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies)))
    return taken.select(*unpack(docs.columns, source="source", text="text"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix-1", boundary: str = "words") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document row.

    A source's target, rounded to words, is so many whole repetitions plus a rest. The rest goes to documents in the
    order of a seeded md5 of their id (ties by id, then size) until it is used up: a document before the boundary is
    taken once more, the one on it for the words that are still missing (boundary="words") or wholly if that comes
    nearer (boundary="documents"). Sums by (source, first hash digits) find the bucket that holds the boundary, so
    only that bucket's documents, a 4096th of the source, are ever sorted; no task sees a whole source.

    Null text counts 0 words, null sources form one source, null ids sort first. Repeated rows count each. An empty
    table gives no rows. Other columns of docs are ignored.
    """
    key = seeded_key(F.col("doc_id"), seed)
    sizes = cut(docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), key.alias("_key")).withColumn("_b", F.substring("_key", 1, 3)))
    buckets = cut(sizes.groupBy("source", "_b").agg(F.sum("size").alias("size")))
    plan = water_fill(weigh_sources(buckets, weights), share, float(max_epochs))
    take = F.floor(F.col("target") + 0.5)
    plan = plan.withColumns({"_whole": F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")})
    plan = plan.withColumn("_rest", take - F.col("_whole") * F.col("source_size")).withColumnRenamed("source", "_s")
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("_start", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumnsRenamed({"size": "_bsize"})
    starts = starts.join(plan, F.col("source").eqNullSafe(F.col("_s"))).withColumns({"_left": F.col("_rest") - F.col("_start")})
    starts = starts.select(F.col("source").alias("_s"), F.col("_b").alias("_sb"), "source_size", "target", "_whole", "_left", "_bsize")
    rows = sizes.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb")))
    split = (F.col("_left") > 0) & (F.col("_left") < F.col("_bsize"))
    plain = rows.where(~split).withColumn("_more", F.when(F.col("_left") >= F.col("_bsize"), F.col("size")).otherwise(F.lit(0)))
    within = Window.partitionBy("source", "_b").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_left") - F.coalesce(F.sum("size").over(within), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_room")))
    if boundary == "documents":
        part = F.when(2 * part >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    edge = rows.where(split).withColumn("_room", room).withColumn("_more", part)
    out = plain.select(*rows.columns, "_more").unionByName(edge.select(*rows.columns, "_more"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("_whole") * F.col("size") + F.col("_more")).cast("long").alias("taken"))
