"""Settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Fixed values of search, packing and answering."""

    max_upload_mb: int = 200
    embedding_dimensions: int = 256
    top_k: int = 20
    answer_top_k: int = 8
    candidates: int = 40
    rrf_k: int = 60
    alpha: float = 0.5
    mmr_lambda: float = 0.72
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    max_variants: int = 8
    top_sections: int = 0
    context_chars: int = 6000
    embedder: str = "hash"
    llm_model: str = ""
    reflection: bool = True


DEFAULT = EngineConfig()
