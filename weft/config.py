"""Settings of the pipeline, and the shapes of its tables."""

from __future__ import annotations

from dataclasses import dataclass

COOCCURS = "co-occurs with"
TRIPLETS = "subject string, predicate string, object string, chunk_id int, doc_name string"


@dataclass(frozen=True)
class PipelineConfig:
    """Defaults of every stage. chunk_size counts words, overlap sentences."""

    chunk_size: int = 300
    overlap_sentences: int = 2
    min_edge_count: int = 1
    llm_weight: float = 3.0
    cooc_weight: float = 1.0
    freq_weight: float = 0.5
    strong_bonus: float = 1.2
    min_weight: float = 0.1
    keep_llm_edges: bool = True
    include_cooccurrence: bool = True
    trigram_threshold: float = 0.85
    min_node_degree: int = 1
    top_k_nodes: int = 50
    model: str = "mistral"
    temperature: float = 0.0
