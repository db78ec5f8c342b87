"""Settings of the engine, checked where they are made; the first broken rule is the one that is told."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

STRATEGIES = ("dense", "sparse", "hybrid")
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def _whole(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


@dataclass(frozen=True)
class ChunkConfiguration:
    """Words of a chunk, words that neighbours share, and whether passages may run over pages (flow) or not (page)."""

    word_size: int = 200
    overlap_words: int = 50
    assembly: str = "flow"

    def __post_init__(self):
        if not _whole(self.word_size) or self.word_size <= 0:
            raise ValueError("wordSize must be a positive integer.")
        if not _whole(self.overlap_words) or self.overlap_words < 0:
            raise ValueError("overlapWords must be a non-negative integer")
        if self.overlap_words >= self.word_size:
            raise ValueError("overlapWords must be strictly smaller than wordSize")
        if self.assembly not in ("page", "flow"):
            raise ValueError('assembly must be "page" or "flow"')

    @property
    def minimum_words(self) -> int:
        """Runs and tails of fewer words are joined with their neighbours."""
        return min(40, self.word_size // 5)


@dataclass(frozen=True)
class RetrievalConfiguration:
    strategy: str = "hybrid"
    top_k: int = 5
    dense_candidates: int = 100
    sparse_candidates: int = 100
    rrf_k: int = 60
    rank_base: int = 1


@dataclass(frozen=True)
class RerankingConfiguration:
    enabled: bool = False
    strategy: str = "cross_encoder"
    candidates: int = 20


@dataclass(frozen=True)
class HierarchyConfiguration:
    top_k: int = 12
    max_context_words: int = 4000
    minimum_score: float = 0.05

    def __post_init__(self):
        if not all(isinstance(x, (int, float)) and math.isfinite(x) for x in (self.top_k, self.max_context_words, self.minimum_score)):
            raise ValueError("Hierarchy configuration values must be finite numbers.")
        for name, x in (("topK", self.top_k), ("maxContextWords", self.max_context_words)):
            if not _whole(x) or x <= 0:
                raise ValueError(f"{name} must be a positive integer.")
        if not 0 <= self.minimum_score <= 1:
            raise ValueError("minimumRetrievalScore must be between 0 and 1.")


@dataclass(frozen=True)
class CalibrationConfiguration:
    chunk: ChunkConfiguration = field(default_factory=ChunkConfiguration)
    retrieval: RetrievalConfiguration = field(default_factory=lambda: RetrievalConfiguration(top_k=20))
    reranking: RerankingConfiguration = field(default_factory=RerankingConfiguration)

    @staticmethod
    def parse(given: Any) -> CalibrationConfiguration:
        """From a JSON object with the optional parts ``chunk``, ``retrieval`` and ``reranking``."""
        if not isinstance(given, dict):
            raise ValueError("configuration must be an object.")
        chunk, retrieval, reranking = (given.get(k, {}) for k in ("chunk", "retrieval", "reranking"))
        for name, part in (("chunk", chunk), ("retrieval", retrieval), ("reranking", reranking)):
            if not isinstance(part, dict):
                raise ValueError(f"configuration.{name} must be an object.")
        sizes = ChunkConfiguration(chunk.get("wordSize", 200), chunk.get("overlapWords", 50), chunk.get("assembly", "flow"))
        top_k = retrieval.get("topK", 20)
        if not _whole(top_k) or not 1 <= top_k <= 100:
            raise ValueError("retrieval.topK must be an integer between 1 and 100.")
        strategy = retrieval.get("strategy", "hybrid")
        if strategy not in STRATEGIES:
            raise ValueError("retrieval.strategy must be dense, sparse or hybrid.")
        enabled = reranking.get("enabled", False)
        if not isinstance(enabled, bool):
            raise ValueError("reranking.enabled must be a boolean.")
        if reranking.get("strategy", "cross_encoder") != "cross_encoder":
            raise ValueError("reranking.strategy must be cross_encoder.")
        candidates = reranking.get("candidates", max(20, top_k))
        if not _whole(candidates) or not top_k <= candidates <= 100:
            raise ValueError("reranking.candidates must be an integer between topK and 100.")
        return CalibrationConfiguration(sizes, RetrievalConfiguration(strategy, top_k), RerankingConfiguration(enabled, candidates=candidates))


@dataclass(frozen=True)
class ServiceConfiguration:
    """Models and store, from an environment-like mapping: values are trimmed, blanks take the default."""

    embedding_model: str
    generation_model: str
    store_url: str
    collection: str
    api_key: str | None
    vector_size: int
    query_prefix: str

    @staticmethod
    def from_mapping(env: dict[str, str]) -> ServiceConfiguration:
        get = lambda name, default="": (env.get(name) or "").strip() or default
        size = get("VECTOR_SIZE", "384")
        if not size.isdigit() or int(size) <= 0:
            raise ValueError("VECTOR_SIZE must be a positive integer.")
        url = get("STORE_URL", "spark-warehouse")
        if url.startswith("https://") and not get("STORE_API_KEY"):
            raise ValueError("STORE_API_KEY is required for a remote store.")
        return ServiceConfiguration(get("EMBEDDING_MODEL", "hashing-stub"), get("GENERATION_MODEL", "extractive-stub"), url, get("COLLECTION", "passages"), get("STORE_API_KEY") or None, int(size), env.get("QUERY_PREFIX", QUERY_PREFIX))
