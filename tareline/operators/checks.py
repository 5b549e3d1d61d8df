"""Data checks that return the offending rows or counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys occurring more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_nonempty(df: DataFrame, keys: Sequence[str], measure: str, out: str = "total") -> DataFrame:
    """Keys whose measure sums to less than one; all-missing counts as zero."""
    total = F.coalesce(F.sum(measure), F.lit(0).cast(dict(df.dtypes)[measure]))
    return df.groupBy(*keys).agg(total.alias(out)).where(F.col(out) < 1)


def check_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of missing values of each key column, in one pass."""
    return df.agg(*[F.count_if(F.col(k).isNull()).alias(f"null_{k}") for k in keys])
