"""Queries of the engine by name, each with the SQL that an independent engine runs for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    """Add a query; `sql` is left out where SQL cannot express it."""
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def _load() -> None:
    from parley.plans import agreement, catalog, features, grown, models, phrases, proxies, reports, shaping, tasks, wider  # noqa: F401  register on import


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
