"""Parameters of retrieval, chunking and policies."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    top_k_dense: int = 8
    top_k_bm25: int = 8
    top_k_final: int = 5
    dense_weight: float = 0.6
    bm25_weight: float = 0.4
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    #: Documents without any query term fill a list up to k, in corpus order.
    bm25_fill: bool = False
    stale_factor: float = 0.98
    ambiguity_margin: float = 0.85
    off_topic_threshold: float = 0.8
    max_images: int = 12
    significant_area: float = 3000.0
    least_area: float = 100.0
    fuzzy_threshold: float = 88.0
    chunk_size: int = 900
    chunk_overlap: int = 150
    toc_line_ratio: float = 0.35
    least_chunk_chars: int = 30
    title_tolerance: float = 3.0
    boilerplate_share: float = 0.5
    boilerplate_chars: int = 120
    retrieval_budget_ms: int = 2000
    answer_budget_ms: int = 8000
    rerank_enabled: bool = True

    @classmethod
    def from_env(cls, prefix: str = "LECTERN_") -> Settings:
        """Defaults overridden by environment variables such as LECTERN_TOP_K_FINAL."""
        found = {}
        for f in fields(cls):
            if (value := os.environ.get(prefix + f.name.upper())) is not None:
                found[f.name] = value.lower() in ("1", "true", "yes") if isinstance(f.default, bool) else type(f.default)(value)
        return cls(**found)


SETTINGS = Settings()
