"""Unions of sources and comparison of tables as sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tareline.operators.joins import semi_keys


def union_sources(*frames: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Stack sources by column name; absent columns may be filled with missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def common_categories(a: DataFrame, b: DataFrame, keys: Sequence[str], category: str) -> tuple[DataFrame, DataFrame]:
    """Restrict both sides to categories occurring on both, per key.

    Covers all keys in one job; a key without a common category vanishes.
    """
    columns = [*keys, category]
    shared = a.select(*columns).intersect(b.select(*columns))
    return semi_keys(a, shared, columns, null_safe=True), semi_keys(b, shared, columns, null_safe=True)


def reconcile_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows occur only in one table, repetitions counted.

    Each distinct row gets its surplus from one grouped sum over both tables.
    """
    columns = a.columns
    stacked = a.select(*columns, F.lit(1).alias("__side")).unionByName(
        b.select(*columns, F.lit(-1).alias("__side")))
    surplus = stacked.groupBy(*columns).agg(F.sum("__side").alias("__s"), F.count_if(F.col("__side") == 1).alias("__a"))
    return surplus.agg(
        F.coalesce(F.sum(F.greatest("__s", F.lit(0))), F.lit(0)).alias("only_in_a"),
        F.coalesce(F.sum(F.greatest(-F.col("__s"), F.lit(0))), F.lit(0)).alias("only_in_b"),
        F.coalesce(F.sum(F.least(F.col("__a"), F.col("__a") - F.col("__s"))), F.lit(0)).alias("in_both"),
    )
