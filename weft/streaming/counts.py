"""Edge and node counts that follow a stream of triplets (update mode)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import normalise_triplets


def running_edges(triplets: DataFrame) -> DataFrame:
    """(src, dst, edge_count, first_doc): state is one row a pair."""
    return normalise_triplets(triplets).groupBy("src", "dst").agg(F.count("*").alias("edge_count"), F.min_by("doc_name", "row_ord").alias("first_doc"))


def running_nodes(triplets: DataFrame) -> DataFrame:
    return normalise_triplets(triplets).select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("frequency"))
