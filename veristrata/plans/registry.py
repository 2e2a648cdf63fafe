"""All queries of the engine's own operators with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plan(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def load() -> None:
    """Import every module of plans, so that all are registered."""
    from . import candidates, claims, corpus, evaluation, graph, knowledge, more, reports, search, sinks, sources, streams, verify, wikitext  # noqa: F401
