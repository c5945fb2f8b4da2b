"""One configuration for all operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from lexigrid.operators.embed import DIMENSIONS


@dataclass(frozen=True)
class EngineConfig:
    """Parameters of ingestion and retrieval. Models are factories: each worker loads one once."""

    chunk_size: int = 1200
    chunk_overlap: int = 100
    ner_threshold: float = 0.5
    coref_ratio: float = 0.85
    coref_tokens: float = 0.9
    similarity_threshold: float = 0.95
    min_edge_weight: float = 0.01
    min_component: int = 3
    resolution: float = 1.0
    dimensions: int = DIMENSIONS
    embed_batch: int = 32
    prompt_chars: int = 12_000
    chunk_k: int = 5
    entity_k: int = 10
    excerpt_chars: int = 300
    models: dict = field(default_factory=dict)
