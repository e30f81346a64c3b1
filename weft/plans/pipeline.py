"""From documents to a weighted graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..functions.text import parse_concepts, parse_triplet_lines
from ..operators import chunking, extract, tidy, weights
from ..operators.graph import Graph, build_graph


def triplets_of(docs: DataFrame, config: PipelineConfig = PipelineConfig(), connect: Callable | None = None) -> DataFrame:
    """Triplets of documents (doc_name, text): by rules, or by a language model that connect gives a client for."""
    chunks = chunking.chunk_documents(docs, size=config.chunk_size, overlap=config.overlap_sentences)
    if connect is None:
        concepts, parts = extract.rule_concepts(chunks), []
    else:
        extract.check_model(connect)
        concepts = extract.model_answers(chunks, None, connect).select("doc_name", "chunk_id", parse_concepts(F.col("raw")).alias("concepts"))
        raw = extract.model_answers(chunks, concepts, connect)
        rows = raw.select("doc_name", "chunk_id", F.posexplode(parse_triplet_lines(F.col("raw"))).alias("seq", "t"))
        parts = [rows.select("t.subject", "t.predicate", "t.object", "chunk_id", "doc_name", F.lit(0).alias("kind"), "seq")]
    if config.include_cooccurrence or not parts:
        parts.append(extract.cooccurrence(concepts))
    return extract.triplet_table(*parts)


def weighted_graph(triplets: DataFrame, config: PipelineConfig = PipelineConfig(), clean: bool = False) -> Graph:
    """The graph that queries run on: built, cleaned if asked, weighted, without weak edges; in the shared folder."""
    g = build_graph(triplets, config.min_edge_count)
    if clean:
        g = tidy.tidy(g, config.trigram_threshold, min_degree=config.min_node_degree)
    return weights.filter_weak(weights.weigh(g, config), config.min_weight, config.keep_llm_edges).settled()
