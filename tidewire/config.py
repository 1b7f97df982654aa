"""Settings of all operators, with their bounds."""

from __future__ import annotations

from dataclasses import dataclass

# Closed vocabularies, in their order.
MODE_LADDER = ["metadata_only", "feed_excerpt", "api_content", "licensed_full_text"]
FIXTURE_MODE = "manual_fixture"
CLUSTERABLE_MODES = ["feed_excerpt", "api_content", "licensed_full_text"]
CATEGORIES = ["politics", "business", "technology", "science", "health", "world", "sports", "entertainment"]
CORE_CLAIMS = ["consensus", "source_specific", "contradiction"]
PROMOTABLE_KINDS = ["person", "organization", "location"]
LENSES = {"student": "student_context", "investor": "investor_implication"}
ROLES = ["student", "investor", "admin"]
ACCEPTED, PENDING = "auto_accepted", "pending_review"


@dataclass(frozen=True)
class Config:
    """Defaults of the engine; a value out of bounds raises."""

    similarity: float = 0.85
    review_gap: float = 0.1
    recency_hours: int = 72
    embed_batch: int = 32
    promotion_floor: int = 5
    edges_per_entity: int = 25
    view_nodes: int = 60
    view_edges: int = 6
    theme_facets: int = 12
    edge_citations: int = 20
    proposal_sample: int = 3
    auto_merge: float = 0.9
    review_merge: float = 0.6
    rrf_k: int = 60
    pool: int = 500
    max_distance: float = 0.6
    evidence_max: int = 10
    evidence_per_publisher: int = 2
    near_duplicate: float = 0.97
    min_publishers: int = 2
    min_claims: int = 2
    excerpt_chars: int = 1500
    timeline_buckets: int = 60
    timeline_matches: int = 200
    page_default: int = 10
    page_max: int = 50
    retention_days: int = 7
    catch_up_windows: int = 8
    blindspot_share: float = 0.8
    rsi_period: int = 14
    trading_days: int = 252
    session_limit: int = 20
    brief_capacity: int = 20

    def __post_init__(self) -> None:
        bounds = {
            "similarity": (0, 1), "recency_hours": (1, 8760), "embed_batch": (1, 256), "promotion_floor": (1, 1000), "edges_per_entity": (1, 500),
            "view_nodes": (1, 200), "view_edges": (1, 100), "auto_merge": (0, 1), "review_merge": (0, 1), "brief_capacity": (1, 1_000_000),
        }
        for name, (low, high) in bounds.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie in {low}..{high}")
        if self.review_merge >= self.auto_merge:
            raise ValueError("review_merge must be below auto_merge")

    @property
    def review(self) -> float:
        return max(0.0, self.similarity - self.review_gap)


DEFAULT = Config()
