"""Retrieval variants and corpus locations: driver-side settings, not data."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class RetrievalConfig:
    """One retrieval variant. ``top_k`` passages are used, ``candidate_k`` is the pool depth."""

    name: str
    top_k: int = 5
    candidate_k: int = 20
    lexical: bool = False
    rrf_k: int = 60
    reranker: bool = False
    reranker_model: str = "token-overlap"


CONFIGS = {
    c.name: c
    for c in (
        RetrievalConfig("mvp_baseline"),
        RetrievalConfig("rerank", reranker=True),
        RetrievalConfig("hybrid", lexical=True),
        RetrievalConfig("hybrid_rerank", lexical=True, reranker=True),
    )
}

CORPORA = ("full", "dev")


def get_config(name: str) -> RetrievalConfig:
    """The variant of a name; an unknown one is an error that lists those there are."""
    if name not in CONFIGS:
        raise ValueError(f"unknown config {name!r}; there are: {', '.join(sorted(CONFIGS))}")
    return CONFIGS[name]


def corpus_paths(base: str | Path, corpus: str = "full") -> tuple[str, str]:
    """(documents, store) of a corpus below ``base``; ``dev`` is the small one for trials."""
    if corpus not in CORPORA:
        raise ValueError(f"unknown corpus {corpus!r}; there are: {', '.join(CORPORA)}")
    tail = "" if corpus == "full" else "_dev"
    return f"{base}/data{tail}", f"{base}/store{tail}"
