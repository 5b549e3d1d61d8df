"""Queries over the given tables and their SQL counterparts."""

from tareline.registry import job_queries, operator_queries  # noqa: F401
from tareline.registry.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
