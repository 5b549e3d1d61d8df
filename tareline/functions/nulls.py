"""Column helpers with the missing-value rules of the source statistics.

A missing value is never a member of a list, is written as ``NA`` inside a
composed label, and makes a strict aggregate missing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_in(c: Column | str, values: Iterable) -> Column:
    """Two-valued membership: missing is not a member.

    Written with null tests, which reach the file scan as pushed filters.
    """
    return col(c).isNotNull() & col(c).isin([v for v in values if v is not None])


def not_in(c: Column | str, values: Iterable) -> Column:
    """Complement of :func:`is_in`; keeps rows whose value is missing."""
    return col(c).isNull() | ~col(c).isin([v for v in values if v is not None])


def quoted(name: str) -> str:
    """A column name as it is, dots included."""
    return "`" + name.replace("`", "``") + "`"


def paste(*parts: Column | str, sep: str = " ") -> Column:
    """Join text parts; a missing part is written as ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(col(p).cast("string"), F.lit("NA")) for p in parts])


def if_known(condition: Column, yes, no) -> Column:
    """Three-valued choice: a missing condition gives a missing result."""
    return F.when(condition, yes).when(~condition, no)


def is_blank(c: Column | str) -> Column:
    return col(c).isNull() | (F.trim(col(c)) == "")


def _strict(c: Column, aggregate: Column, na: str) -> Column:
    if na == "skip":
        return aggregate
    if na != "propagate":
        raise ValueError("na must be 'skip' or 'propagate'")
    return F.when(F.count_if(c.isNull()) == 0, aggregate)


def max_of(c: Column | str, na: str = "skip") -> Column:
    return _strict(col(c), F.max(col(c)), na)


def min_of(c: Column | str, na: str = "skip") -> Column:
    return _strict(col(c), F.min(col(c)), na)


def sum_of(c: Column | str, na: str = "skip") -> Column:
    return _strict(col(c), F.sum(col(c)), na)


def mean_of(c: Column | str, na: str = "skip") -> Column:
    return _strict(col(c), F.avg(col(c)), na)
