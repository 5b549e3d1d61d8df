"""Registration of queries over the given tables with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tareline.registry.views import SQL_VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def sql(views: str, body: str, ctes: str = "") -> str:
    """``WITH`` clause from named views (and extra CTEs) before the body."""
    parts = [f"{v} AS ({SQL_VIEWS[v]})" for v in views.split()]
    if ctes:
        parts.append(ctes.strip())
    return (f"WITH {', '.join(parts)} " if parts else "") + body.strip()


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if oracle is not None:
            SQL[name] = oracle
        return f

    return register
