"""Row filters with explicit treatment of missing values."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tareline.functions.nulls import is_blank, is_in, not_in


def clean_filter(
    df: DataFrame,
    filled: Sequence[str] = (),
    nonzero: Sequence[str] = (),
    equals: dict[str, object] | None = None,
    exclude: dict[str, Iterable] | None = None,
    years: tuple[int | None, int | None] | None = None,
    year: str = "year",
) -> DataFrame:
    """The usual cleaning chain as one predicate, so it reaches the scan.

    ``filled`` columns are neither missing nor blank, ``nonzero`` columns are
    known and not zero, ``equals`` fixes values, ``exclude`` drops listed
    values but keeps missing ones, ``years`` is an inclusive range.
    """
    tests: list[Column] = [~is_blank(c) if t == "string" else F.col(c).isNotNull()
                           for c, t in df.dtypes if c in set(filled)]
    tests += [F.col(c).isNotNull() & (F.col(c) != 0) for c in nonzero]
    tests += [F.col(c) == v for c, v in (equals or {}).items()]
    tests += [not_in(c, values) for c, values in (exclude or {}).items()]
    if years:
        first, last = years
        tests += [F.col(year) >= first] if first is not None else []
        tests += [F.col(year) <= last] if last is not None else []
    return df.where(reduce(Column.__and__, tests)) if tests else df


def drop_exception(df: DataFrame, condition: Column) -> DataFrame:
    """Drop rows meeting ``condition``; rows where it is unknown go too."""
    return df.where(~condition)


def member_filter(df: DataFrame, column: str, members: Iterable | DataFrame, member: bool = True) -> DataFrame:
    """Keep members of a list or of a one-column table, or keep all others.

    Missing values are never members, so they stay with ``member=False``.
    """
    if isinstance(members, DataFrame):
        key = members.columns[0]
        table = members.select(F.col(key).alias("__member"))
        how = "left_semi" if member else "left_anti"
        return df.join(table, F.col(column) == F.col("__member"), how)
    return df.where(is_in(column, members) if member else not_in(column, members))
