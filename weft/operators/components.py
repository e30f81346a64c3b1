"""Connected components by contraction, for graphs of any shape: rounds grow with the logarithm of the nodes."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import cut, drop_cut

log = logging.getLogger(__name__)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that is reachable over undirected edges (a, b) from each node (column id).

    In a round every vertex moves onto the neighbour (or itself) of the smallest priority, a hash of the id that is
    another one in each round, and the edges between what is left make the next, smaller graph. A vertex that nobody
    chose is gone; by the random priorities that is a constant share of them, so a path of n vertices takes O(log n)
    rounds as a star does, and all rounds together cost a small multiple of the first. Hubs are safe: the smallest
    neighbour is an aggregate with map-side combining, and the joins on the edges' ends are ordinary equi-joins that
    adaptive execution splits. Null ends of edges are ignored, loops and repeated edges do no harm, ids may be of any
    type that can be ordered. Rows of nodes that repeat an id each get its label; a null id has a null label.
    """
    one_way = edges.where("a is not null and b is not null and a != b").select("a", "b")
    left = cut(one_way.union(one_way.select("b", "a")).distinct())
    moves: list[DataFrame] = []
    while left.limit(1).count():
        key = lambda c, n=len(moves): F.struct(F.xxhash64(F.lit(n), c).alias("h"), F.col(c).alias("id"))
        move = cut(left.groupBy("a").agg(F.min(key("b")).alias("m")).select(F.col("a").alias("v"), F.least(key("a"), F.col("m"))["id"].alias("to")))
        to = lambda end, move=move: move.select(F.col("v").alias(end), F.col("to").alias(f"{end}_to"))
        moved = left.join(to("a"), "a").join(to("b"), "b").where("a_to != b_to")
        rest = cut(moved.select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct())
        drop_cut(left)
        left = rest
        moves.append(move)
    log.info("components: %d rounds", len(moves))
    if not moves:
        return nodes.select("id", F.col("id").alias("label"))
    root = moves[-1]
    for move in reversed(moves[:-1]):  # each round's vertices are a part of those of the round before
        further = root.select(F.col("v").alias("to"), F.col("to").alias("end"))
        root = move.join(further, "to", "left").select("v", F.coalesce("end", "to").alias("to"))
    root = cut(root)
    least = root.groupBy("to").agg(F.min("v").alias("label"))
    labels = root.join(least, "to").select(F.col("v").alias("id"), "label")
    return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
