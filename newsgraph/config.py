"""Plain, immutable settings passed to operators (no globals, no env lookups)."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values that must equal the reference behaviour.
DEFAULT_MODEL = "gpt-4-turbo-preview"
CONFIDENCE_THRESHOLD = 0.7
MAX_GRAPH_DEPTH = 3
DUPLICATE_TTL_DAYS = 7
FEED_TTL_HOURS = 24
POLL_INTERVAL_MINUTES = 15
SEVERITY_LEVELS = ("low", "medium", "high", "critical")
WIKI_TYPES = ("person", "location", "event")
COMPANY_TYPE = "company"
CANDIDATE_LIMIT = 5


@dataclass(frozen=True)
class Config:
    model: str = DEFAULT_MODEL
    threshold: float = CONFIDENCE_THRESHOLD
    max_depth: int = MAX_GRAPH_DEPTH
    dedup_ttl_days: int = DUPLICATE_TTL_DAYS
    feed_ttl_hours: int = FEED_TTL_HOURS
    poll_minutes: int = POLL_INTERVAL_MINUTES
    candidate_limit: int = CANDIDATE_LIMIT
    kb_language: str = "en"
    id_len: int = 64  # hex digits of SHA-256: the whole digest
    # copies that arrive later than this are judged without the state that was evicted
    dedup_late_days: int = 30
    # buckets of keyed state on shared storage; fixed for the life of a state
    state_buckets: int = 64
    drop_unverified_edges: bool = False
    temperatures: dict = field(
        default_factory=lambda: {"entity": 0.1, "mapping": 0.2, "impact": 0.3}
    )
