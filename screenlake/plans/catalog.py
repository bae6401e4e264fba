"""All registered queries of the screening engine, with equivalent SQL."""

from __future__ import annotations

from . import action_queries, evaluation_queries, fusion_queries, integrity_queries, lineage_queries, prose_queries, reply_queries, request_queries, score_queries, store_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "requests_simulated_sessions"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
