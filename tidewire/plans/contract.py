"""All queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from tidewire.plans import claims_queries, graph_queries, ingest_queries, market_queries, read_queries, search_queries, story_queries  # noqa: F401
from tidewire.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
