"""Wide to long, long to wide, splitting, and completing of key grids."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tareline.functions.flags import flag_letters, flagged_value
from tareline.functions.nulls import quoted
from tareline.operators.joins import join_on, semi_keys
from tareline.session import materialise

YEAR_COLUMN = r"^[12]\d{3}$"
#: Cells of a grid that one task makes, about.
TASK_CELLS = 1_000_000
#: Column of packed year cells.
CELLS = "__cells"


def split_key(df: DataFrame, header: str, key: str, sep: str = ",") -> DataFrame:
    """Split a composite key column into the columns its header names.

    A trailing axis label after a backslash (``geo\\time``) is not a name.
    Missing trailing parts become missing, surplus parts are dropped.
    """
    names = [n.split("\\")[0].strip() for n in header.split(sep)]
    parts = F.split(F.col(key), re.escape(sep))
    return df.select(*[F.trim(F.get(parts, i)).alias(n) for i, n in enumerate(names)],
                     *[c for c in df.columns if c != key])


def split_pair(df: DataFrame, column: str, into: tuple[str, str], sep: str = " - ") -> DataFrame:
    """Split text into two columns; the second is missing without separator."""
    parts = F.split(F.col(column), re.escape(sep))
    first, second = into
    return df.withColumns({first: F.get(parts, 0), second: F.get(parts, 1)}).select(
        *[n for c in df.columns for n in (into if c == column else (c,))])


def pack_years(df: DataFrame, pattern: str = YEAR_COLUMN, into: str = CELLS) -> DataFrame:
    """The year columns of each row as one map from year to cell text.

    Tables with different year columns have one schema afterwards, so they can
    be stacked and decoded once.
    """
    years = [c for c in df.columns if re.match(pattern, c)]
    keys = [quoted(c) for c in df.columns if c not in years]
    cells = F.map_from_arrays(
        F.array(*[F.lit(y) for y in years]).cast("array<string>"),
        F.array(*[F.col(quoted(y)).cast("string") for y in years]).cast("array<string>"),
    )
    return df.select(*keys, cells.alias(into))


def unpack_years(df: DataFrame, value: str = "value", flag: str | None = "flag", cells: str = CELLS) -> DataFrame:
    """One row per key and year of packed cells, keeping missing cells."""
    keys = [quoted(c) for c in df.columns if c != cells]
    long = df.select(*keys, F.explode(cells).alias("year", "__cell"))
    parsed = {value: flagged_value("__cell")}
    if flag:
        parsed[flag] = flag_letters("__cell")
    return long.withColumns(parsed | {"year": F.col("year").cast("int")}).drop("__cell")


def unpivot_years(
    df: DataFrame,
    pattern: str = YEAR_COLUMN,
    value: str = "value",
    flag: str | None = "flag",
) -> DataFrame:
    """One row per key and year column, keeping missing cells.

    Cells are read as text and parsed here, so files whose year columns would
    be typed differently behave alike.
    """
    return unpack_years(pack_years(df, pattern), value, flag)


def unpivot_measures(
    df: DataFrame,
    measures: Sequence[str] | str,
    name: str = "calculation",
    value: str = "value",
) -> DataFrame:
    """One row per measure; ``measures`` are names or a pattern on names."""
    if isinstance(measures, str):
        measures = [c for c in df.columns if re.search(measures, c)]
    keys = [c for c in df.columns if c not in measures]
    return df.unpivot([quoted(k) for k in keys], [quoted(m) for m in measures], name, value)


def lift_category(
    df: DataFrame,
    keys: Sequence[str],
    category: Column,
    value: str,
    into: str,
    **more: Column,
) -> DataFrame:
    """Turn the value of one category into a column of its key.

    One conditional aggregate; the category must be unique per key (see
    ``consolidate_factors``), the largest value is taken otherwise.  ``more``
    names further aggregates over the category's rows, such as their sources.
    """
    return df.where(category).groupBy(*keys).agg(F.max(value).alias(into), *[c.alias(n) for n, c in more.items()])


def explode_list(df: DataFrame, column: str, sep: str = ", ") -> DataFrame:
    """One row per element of a delimited list; a missing list stays one row."""
    items = F.explode_outer(F.split(F.col(column), re.escape(sep)))
    return df.select(*[items.alias(c) if c == column else F.col(c) for c in df.columns])


def complete_grid(
    df: DataFrame,
    a: str,
    b: str,
    fill: Mapping[str, object] | None = None,
    only: DataFrame | None = None,
    salts: int | None = None,
) -> DataFrame:
    """Every combination of the occurring ``a`` and ``b`` values, joined to ``df``.

    Absent cells are missing, or ``fill``.  The result is by definition the
    product of two key lists; facts never take part in it.  ``only``, a table
    with column ``a``, restricts the first list before the grid is built.  The
    ``b`` list is copied once per salt and meets the ``a`` values of that salt,
    so the work is spread over the salts: as many as give about ``TASK_CELLS``
    cells each, by approximate counts of both lists, and one ``a`` value each at
    most.  ``df`` is read several times and therefore stored first.
    """
    df = materialise(df, "grid")
    if only is not None:
        left = semi_keys(df, only.select(a).distinct(), [a]).select(a).distinct()
    else:
        left = df.select(a).distinct()
    if salts is None:
        long, wide = df.agg(F.approx_count_distinct(a), F.approx_count_distinct(b)).first()
        salts = max(1, min(long, math.ceil(long * wide / TASK_CELLS)))
    spread = left.withColumn("__salt", F.pmod(F.hash(a), F.lit(salts)))
    copied = df.select(b).distinct().withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    grid = spread.join(copied, "__salt").drop("__salt")
    full = join_on(grid, df, [a, b], "left", null_safe=True)
    return full.na.fill(dict(fill)) if fill else full


def densify_years(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    year: str = "year",
    span: tuple[int, int] | None = None,
    step: Column | None = None,
) -> DataFrame:
    """Complete the years of each key, zero-filled, and sum the measures.

    The span is the key's own first to last year unless given; rows outside a
    given span are left out of the series, as its definition asks.  Zero rows are
    appended and summed with the data: one map-side combined shuffle, no join.
    ``step`` is the distance of a sequence of dates.
    """
    kinds = dict(df.dtypes)
    if span is None:
        bounds = df.groupBy(*keys).agg(F.min(year).alias("__first"), F.max(year).alias("__last"))
        first, last = F.col("__first"), F.col("__last")
    else:
        bounds = df.select(*keys).distinct()
        first, last = (F.lit(y).cast(kinds[year]) for y in span)
        df = df.where(F.col(year).between(*span))
    every = F.sequence(first, last, step) if step is not None else F.sequence(first, last)
    zeros = bounds.select(*keys, F.explode(every).alias(year),
                          *[F.lit(0).cast(kinds[m]).alias(m) for m in measures])
    rows = df.select(*keys, year, *measures).unionByName(zeros)
    return rows.groupBy(*keys, year).agg(*[F.sum(m).alias(m) for m in measures])
