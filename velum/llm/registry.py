"""Queries of this subpackage, and the SQL they are checked against."""

from __future__ import annotations

from velum.plans.registry import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

__all__ = ["QUERIES", "ORACLES", "query", "table"]


def query(name: str, sql: str | None = None):
    """Register a query, with SQL that gives the same rows where SQL can express it."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
