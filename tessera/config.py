"""Defaults and plan-time validation. Fixed values are those that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Limits and weights of a search, chunk sizes, versions.
TOP_K, MIN_TOP_K, MAX_TOP_K = 8, 1, 50
SCORE_THRESHOLD, VECTOR_WEIGHT, LEXICAL_WEIGHT, RRF_K, OVERFETCH = 0.2, 0.7, 0.3, 60, 3
CHUNK_SIZE, CHUNK_OVERLAP = 1200, 150
MAX_INPUT_CHARS = 6000
PAYLOAD_SCHEMA_VERSION = 1
SCOPES = ("workspace", "source", "related", "global")
DISABLED_SCOPES = ("global",)
BUCKETS = ("knowledge", "code", "lis")
#: The vocabulary of governance documents.
LIS_DOC_TYPES = ("policy", "riktlinje", "anvisning", "instruktion", "mall", "vagledning", "vägledning", "checklista")
LIS_PROCESS_AREAS = ("ledning", "behov", "planera", "utveckla", "leverera", "stod", "stöd")
LIS_STATUSES = ("approved", "draft")


@dataclass(frozen=True)
class AppRule:
    prefix: str
    name: str


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = TOP_K
    score_threshold: float = SCORE_THRESHOLD
    vector_weight: float = VECTOR_WEIGHT
    lexical_weight: float = LEXICAL_WEIGHT
    rrf_k: int = RRF_K


@dataclass(frozen=True)
class Config:
    search: SearchConfig = field(default_factory=SearchConfig)
    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    documentation_prefixes: tuple[str, ...] = ("docs/",)
    apps: tuple[AppRule, ...] = (AppRule("apps/web/", "web"), AppRule("apps/", "apps"))
    sources: str = "all"
    capabilities: tuple[str, ...] = BUCKETS


def enabled_buckets(config: Config) -> set[str]:
    """Buckets asked for by ``sources`` ("all", "both" or names with commas) that are also capabilities."""
    mode = config.sources.strip().lower()
    wanted = set(BUCKETS) if mode == "all" else {"knowledge", "code"} if mode == "both" else {x.strip() for x in mode.split(",") if x.strip()}
    if unknown := wanted - set(BUCKETS):
        raise ValueError(f"unknown buckets: {sorted(unknown)}")
    return wanted & set(config.capabilities)


def check_limit(value: object) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not MIN_TOP_K <= value <= MAX_TOP_K:
        raise ValueError(f"the limit must be an integer from {MIN_TOP_K} to {MAX_TOP_K}, not {value!r}")
    return value


def check_app(app: str | None, config: Config) -> str | None:
    if app is None or not app.strip():
        return None
    name = app.strip().lower()
    known = {r.name.lower() for r in config.apps} | {"global"}
    if name not in known:
        raise ValueError(f"unknown app {app!r}; known: {sorted(known)}")
    return name


def check_lis(doc_type: str | None = None, process_area: str | None = None, status: str | None = None) -> None:
    for name, value, known in (("doc_type", doc_type, LIS_DOC_TYPES), ("process_area", process_area, LIS_PROCESS_AREAS), ("status", status, LIS_STATUSES)):
        if value is not None and value.strip() and value.strip().lower() not in known:
            raise ValueError(f"{name} must be one of {sorted(known)}, not {value!r}")
