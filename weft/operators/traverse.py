"""Traversal: bounded neighbourhoods and shortest paths, a level at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import cut
from .graph import Graph
from .tidy import keep_nodes


def _arcs(g: Graph) -> DataFrame:
    e = g.edges.select("src", "dst")
    return e.union(e.select("dst", "src")).toDF("u", "v")


def reach(g: Graph, start: DataFrame, depth: int) -> DataFrame:
    """(node, hops): nodes within depth undirected hops of start (column node), with the least number of hops."""
    arcs = _arcs(g)
    seen = start.select("node").distinct().withColumn("hops", F.lit(0))
    front = seen
    for hop in range(1, depth + 1):
        near = front.select(F.col("node").alias("u")).join(arcs, "u").select(F.col("v").alias("node")).distinct()
        front = cut(near.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        if not front.limit(1).count():
            break
        seen = seen.union(front)
    return seen


def subgraph(g: Graph, node: str, depth: int = 2) -> Graph:
    """The directed subgraph that nodes within depth undirected hops of a node induce; empty if there is no such node."""
    return keep_nodes(g, reach(g, g.nodes.where(F.col("node") == node), depth))


def shortest_path(g: Graph, source: str, target: str) -> DataFrame:
    """(step, src, dst, label) along a shortest undirected path; of equal ones, back from the target, the one whose
    next node is the smallest.

    A row's label is that of src->dst if there is such an edge, else of dst->src. No rows if there is no path or the
    ends are one node. Levels grow until the target is met or one is empty, however long the path; the walk back reads one level a step.
    A level's neighbours lie in it, the one before or the next, so only those two are taken out.
    """
    schema = "step int, src string, dst string, label string"
    spark = g.nodes.sparkSession
    if source == target or g.nodes.where(F.col("node").isin(source, target)).count() < 2:
        return spark.createDataFrame([], schema)
    arcs = _arcs(g)
    start = g.nodes.where(F.col("node") == source).select("node")
    seen, front, levels = start, start, []
    while True:
        near = front.select(F.col("node").alias("u")).join(arcs, "u").join(seen.withColumnRenamed("node", "v"), "v", "left_anti")
        level = cut(near.groupBy("v").agg(F.min("u").alias("u")))
        if not level.limit(1).count():
            return spark.createDataFrame([], schema)
        levels.append(level)
        if level.where(F.col("v") == target).limit(1).count():
            break
        last, front = front, level.select(F.col("v").alias("node"))
        seen = last.union(front)
    steps, at = [], target
    for k in range(len(levels), 0, -1):
        before = levels[k - 1].where(F.col("v") == at).first().u
        steps.append((k, before, at))
        at = before
    path = spark.createDataFrame(steps[::-1], "step int, src string, dst string")
    e = g.edges.select(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("label").alias("l"))
    same = path.join(e, (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")), "left").select("step", "src", "dst", F.col("l").alias("l1"))
    back = same.join(e, (F.col("src") == F.col("d")) & (F.col("dst") == F.col("s")), "left")
    return back.select("step", "src", "dst", F.coalesce("l1", "l").alias("label"))
