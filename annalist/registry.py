"""Where the engine's queries are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *, views: bool = True) -> Callable[[Query], Query]:
    """Register a query and, if SQL can say it, the SQL that must agree. With
    ``views`` the SQL may use raw_v, obs_v, progress_v and assert_v."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            from .plans.bindings import with_views

            ORACLES[name] = with_views(sql) if views else sql
        return f

    return register
