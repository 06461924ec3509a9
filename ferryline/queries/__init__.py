"""Every operator as a query over the given tables, with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name` with its reference SQL."""
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def load_all() -> None:
    from ferryline.queries import checks, graphs, jobs, merges, reconciliation, scalars, selections  # noqa: F401
