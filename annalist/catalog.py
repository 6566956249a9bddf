"""Every query of the engine by name, with the SQL that must agree with it."""

from __future__ import annotations

from .plans import queue_queries, store_queries, text_queries, vector_queries, worker_queries  # noqa: F401  (register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
