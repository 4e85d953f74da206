"""Every query of the engine by its survey id, with its SQL restatement."""
from __future__ import annotations

from collections.abc import Callable

from .adapter import Tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables under name; sql is what DuckDB runs for the same rows."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def load() -> None:
    from . import analysis_queries, fact_queries, format_queries, graph_queries, snapshot_queries  # noqa: F401


load()
