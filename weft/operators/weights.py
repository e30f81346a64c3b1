"""Edge classes, scores and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COOCCURS, PipelineConfig
from .graph import Graph

#: Predicates that count as strong: fixed values, matched exactly.
STRONG = ["is a type of", "is a subset of", "is a subtype of", "consists of", "is part of", "is used in", "enables", "introduced by", "was created by", "is defined as", "is an example of", "uses", "is based on", "is built on"]


def classify_edges(edges: DataFrame) -> DataFrame:
    """Adds is_llm_edge (no co-occurrence predicate at all) and predicate_strength."""
    strong = F.arrays_overlap("predicates", F.array(*map(F.lit, STRONG)))
    return edges.withColumns({"is_llm_edge": ~F.array_contains("predicates", COOCCURS), "predicate_strength": F.when(strong, "strong").otherwise("weak")})


def raw_weights(g: Graph, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Edges with raw_weight: the count by class and strength plus half the log of the ends' mean frequency."""
    f = g.nodes.select("node", "frequency")
    edges = classify_edges(g.edges).join(f.withColumnsRenamed({"node": "src", "frequency": "fu"}), "src", "left").join(f.withColumnsRenamed({"node": "dst", "frequency": "fv"}), "dst", "left")
    mean = (F.coalesce("fu", F.lit(1)) + F.coalesce("fv", F.lit(1))) / 2
    bonus = F.when(F.col("predicate_strength") == "strong", config.strong_bonus).otherwise(1.0)
    score = F.col("edge_count") * F.when(F.col("is_llm_edge"), config.llm_weight * bonus).otherwise(config.cooc_weight) + config.freq_weight * F.log(mean + 1)
    return edges.withColumn("raw_weight", score).drop("fu", "fv")


def weigh(g: Graph, config: PipelineConfig = PipelineConfig()) -> Graph:
    """Edges get raw_weight and weight (min-max, 4 places; all 0 if all scores are equal), nodes their edges' mean."""
    edges = raw_weights(g, config)
    span = F.broadcast(edges.agg(F.min("raw_weight").alias("lo"), F.max("raw_weight").alias("hi")))  # one row
    edges = edges.crossJoin(span).withColumn("weight", F.round((F.col("raw_weight") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0), 4)).drop("lo", "hi")
    return Graph(node_weights(g.nodes, edges), edges)


def node_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), F.col("weight").cast("decimal(20,6)").alias("w"))
    mean = ends.groupBy("node").agg((F.sum("w").cast("double") / F.count("*")).alias("w"))
    return nodes.drop("weight").join(mean, "node", "left").withColumn("weight", F.round(F.coalesce("w", F.lit(0.0)), 4)).drop("w")


def filter_weak(g: Graph, min_weight: float = 0.1, keep_llm_edges: bool = True) -> Graph:
    """Without edges below min_weight (extracted ones may stay) and the nodes that then have none."""
    keep = F.col("weight") >= min_weight
    edges = g.edges.where(keep | F.col("is_llm_edge") if keep_llm_edges else keep)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return Graph(g.nodes.join(ends, "node", "left_semi"), edges)


def weight_histogram(edges: DataFrame) -> DataFrame:
    """One row: five bins, min, max and mean (4 places); no row without edges."""
    w = F.col("weight")
    bins = [F.count_if((w >= k / 5 if k else F.lit(True)) & (w < (k + 1) / 5 if k < 4 else F.lit(True))).alias(f"bin_{k}") for k in range(5)]
    mean = (F.sum(w.cast("decimal(20,6)")).cast("double") / F.count("*")).alias("mean")
    out = edges.agg(F.count("*").alias("n"), *bins, F.round(F.min(w), 4).alias("min"), F.round(F.max(w), 4).alias("max"), mean)
    return out.where("n > 0").withColumn("mean", F.round("mean", 4)).drop("n")


def class_counts(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count_if("is_llm_edge").alias("llm_edges"), F.count_if(~F.col("is_llm_edge")).alias("cooccurrence_edges"), F.count_if(F.col("predicate_strength") == "strong").alias("strong_edges"))
