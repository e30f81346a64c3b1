"""The property graph as two tables, built by aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..staging import cut
from .components import components as connected


@dataclass(frozen=True)
class Graph:
    """nodes by node, edges by (src, dst); node_ord and edge_ord are where each was met first."""

    nodes: DataFrame
    edges: DataFrame

    def settled(self) -> Graph:
        """The same graph from tables in the shared folder, for many queries on it."""
        return Graph(cut(self.nodes), cut(self.edges))


def normalise_triplets(triplets: DataFrame) -> DataFrame:
    """(src, predicate, dst, chunk_id, doc_name, row_ord): stripped, lower-cased, defaults filled, no empty ends or loops."""
    low = lambda c: F.lower(strip(F.col(c)))
    rows = triplets.select(
        low("subject").alias("src"),
        F.coalesce(low("predicate"), F.lit("")).alias("predicate"),
        low("object").alias("dst"),
        F.coalesce(F.col("chunk_id").cast("int"), F.lit(0)).alias("chunk_id"),
        F.coalesce("doc_name", F.lit("unknown")).alias("doc_name"),
        "row_ord",
    )
    return rows.where("src != '' AND dst != '' AND src != dst")


def edge_table(rows: DataFrame, min_count: int = 1) -> DataFrame:
    """One row a pair: count, most frequent predicate (the smallest of equal ones), distinct values, first document."""
    edges = rows.groupBy("src", "dst").agg(
        F.count("*").alias("edge_count"),
        F.mode("predicate", True).alias("label"),
        F.array_sort(F.collect_set("predicate")).alias("predicates"),
        F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"),
        F.array_sort(F.collect_set(F.struct("doc_name", "chunk_id"))).alias("chunks"),
        F.min_by("doc_name", "row_ord").alias("doc_name"),
        F.min("row_ord").alias("edge_ord"),
    )
    return edges.where(F.col("edge_count") >= min_count)


def node_table(rows: DataFrame) -> DataFrame:
    """One row a label: rows that name it, documents, first place (subject before object)."""
    ends = rows.select("doc_name", F.explode(F.array(F.struct(F.col("src").alias("node"), F.struct("row_ord", F.lit(0).alias("end")).alias("ord")), F.struct(F.col("dst").alias("node"), F.struct("row_ord", F.lit(1).alias("end")).alias("ord")))).alias("x"))
    ends = ends.select("x.node", "x.ord", "doc_name")
    return ends.groupBy("node").agg(F.count("*").alias("frequency"), F.array_sort(F.collect_set("doc_name")).alias("doc_sources"), F.min("ord").alias("node_ord"))


def degrees(g: Graph) -> DataFrame:
    """(node, in_degree, out_degree, degree) of every node, now."""
    ends = g.edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    sums = ends.groupBy("x.node").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = g.nodes.select("node").join(sums, "node", "left").select("node", zero("in_degree"), zero("out_degree"))
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def build_graph(triplets: DataFrame, min_count: int = 1) -> Graph:
    """Graph of a triplet table; nodes without an edge of min_count rows stay as isolated ones."""
    rows = normalise_triplets(triplets)
    return Graph(node_table(rows), edge_table(rows, min_count))


def top_nodes(g: Graph, n: int = 20) -> DataFrame:
    """(node, degree): the n nodes of highest degree, ties by first place."""
    return degrees(g).join(g.nodes.select("node", "node_ord"), "node").orderBy(F.desc("degree"), "node_ord").limit(n).select("node", "degree")


def density(n, m):
    """Share of the possible directed edges; 0 with fewer than two nodes."""
    return F.when(n > 1, m / (n * (n - 1))).otherwise(F.lit(0.0))


def counts(g: Graph) -> DataFrame:
    return g.nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(g.edges.agg(F.count("*").alias("edges"))))  # one row each


def components(g: Graph) -> DataFrame:
    """(node, component): the first node (by label) of its weak component."""
    found = connected(g.nodes.select(F.col("node").alias("id")), g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return found.select(F.col("id").alias("node"), F.col("label").alias("component"))


def summary(g: Graph, top: int = 5) -> DataFrame:
    """One row: nodes, edges, density (4 places), mean degree (2 places), names of the top nodes, weak components."""
    names = top_nodes(g, top).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("d"), "node"))), lambda x: x["node"]), ", ").alias("top_nodes"))
    parts = components(g).agg(F.countDistinct("component").alias("components"))
    out = counts(g).crossJoin(F.broadcast(names)).crossJoin(F.broadcast(parts))  # one row each
    return out.select("nodes", "edges", F.round(density(F.col("nodes"), F.col("edges")), 4).alias("density"), F.round(F.when(F.col("nodes") > 0, 2 * F.col("edges") / F.col("nodes")).otherwise(0.0), 2).alias("mean_degree"), "top_nodes", "components")
