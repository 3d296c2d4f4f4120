"""Settings of indexing and search, with the defaults the engine is compared under."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    k1: float = 1.2
    b: float = 0.75
    candidates: int = 50
    rrf_k: int = 10
    rerank_top: int = 30
    nms_gap: float = 10.0
    nms_overlap: float = 0.5
    default_k: int = 10
    max_k: int = 50
    max_query_chars: int = 512
    chunk_target: int = 50
    chunk_stride: int = 25
    chunk_context: str = "none"
    context_words: int = 40
    context_lookback: float = 240.0
    expansion_weight: float = 0.9
    tolerance: float = 5.0


@dataclass(frozen=True)
class SearchOptions:
    """Per-request switches. mode: hybrid, lexical or semantic; fusion: rrf or cc."""

    mode: str = "hybrid"
    adaptive: bool = False
    coverage: bool = True
    phonetic: bool = True
    rerank: bool = False
    fusion: str = "rrf"
    nms: bool = True
    snap: bool = True
    k: int | None = None

    def limit(self, settings: Settings) -> int:
        return max(1, min(self.k or settings.default_k, settings.max_k))


#: The query-time systems that evaluation compares.
SYSTEMS: dict[str, SearchOptions] = {
    "bm25": SearchOptions(mode="lexical", phonetic=False),
    "bm25+soundslike": SearchOptions(mode="lexical"),
    "dense": SearchOptions(mode="semantic"),
    "hybrid-cc": SearchOptions(coverage=False, phonetic=False, fusion="cc"),
    "hybrid-rrf": SearchOptions(coverage=False, phonetic=False),
    "hybrid-rrf+intent": SearchOptions(adaptive=True, coverage=False, phonetic=False),
    "hybrid-rrf+coverage": SearchOptions(phonetic=False),
    "full": SearchOptions(),
    "full+rerank": SearchOptions(rerank=True),
    "full-no-snap": SearchOptions(snap=False),
    "full-no-nms": SearchOptions(nms=False),
}


@dataclass(frozen=True)
class IndexVariant:
    """One build of the index: passage size, overlap, context and embedding profile."""

    name: str
    settings: Settings = field(default_factory=Settings)
    profile: str = "hash"


VARIANTS: tuple[IndexVariant, ...] = (
    IndexVariant("default"),
    IndexVariant("chunk-25w", Settings(chunk_target=25, chunk_stride=12)),
    IndexVariant("chunk-100w", Settings(chunk_target=100, chunk_stride=50)),
    IndexVariant("context-question", Settings(chunk_context="question")),
    IndexVariant("context-question+title", Settings(chunk_context="question+title")),
    IndexVariant("profile-bge", profile="bge"),
    IndexVariant("profile-e5", profile="e5"),
    IndexVariant("profile-nomic", profile="nomic"),
)

# What embedding models want before queries and documents.
PREFIXES = {
    "hash": ("", ""),
    "bge": ("Represent this sentence for searching relevant passages: ", ""),
    "e5": ("query: ", "passage: "),
    "nomic": ("search_query: ", "search_document: "),
}
