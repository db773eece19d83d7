"""Fixture-backed queries of the library's own operators and their SQL twins."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame callable under name, with its DuckDB twin if there is one."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def load() -> tuple[dict, dict]:
    """All registered queries and their SQL."""
    from . import catalog, queries  # noqa: F401

    return QUERIES, SQL
