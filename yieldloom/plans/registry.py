"""Registry that pairs every query with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .market import Market
from .oracle import expand

_QUERIES: dict[str, Callable[[Market], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Callable[[Market], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return deco


def _load() -> None:
    from . import (  # noqa: F401
        q_ingest, q_filters, q_joins, q_aggregates, q_windows, q_dividends,
        q_fundamentals, q_ratings, q_events, q_strategy, q_portfolio, q_ops,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, sf_dir: fn(Market(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: expand(sql) for name, sql in _SQL.items()}
