"""Maxima with ties, running totals, row numbers and rankings.

Windows are used only inside chunks of a range-partitioned table, never over a
whole group: a group may hold a large share of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tareline.functions.measure import ratio
from tareline.functions.nulls import is_in, quoted
from tareline.operators.joins import join_on, semi_keys
from tareline.session import materialise


#: Rows of a chunk of a running total, about.
CHUNK_ROWS = 2_000_000


def max_rows_per_group(df: DataFrame, keys: Sequence[str], value: str, null_safe: bool = True) -> DataFrame:
    """Rows holding the largest value of their group, ties kept.

    Reads ``df`` twice; store it first if it is costly to compute.  Without
    missing keys ``null_safe=False`` saves a shuffle.
    """
    best = df.groupBy(*keys).agg(F.max(value).alias(value))
    return semi_keys(df, best.where(F.col(value).isNotNull()), [*keys, value], null_safe)


def rows_at_maximum(df: DataFrame, value: str) -> DataFrame:
    """Rows holding the largest value of the table, ties kept."""
    return semi_keys(df, df.agg(F.max(value).alias(value)), [value])


def top_k(df: DataFrame, value: str, k: int, tie_break: Sequence[str]) -> DataFrame:
    """First ``k`` rows by descending value; missing values last, ties by key."""
    return df.orderBy(F.col(value).desc_nulls_last(), *tie_break).limit(k)


def sort_columns(order: Sequence[str]) -> list[Column]:
    """Columns to sort by, those written with a leading ``-`` descending; missing values last."""
    return [F.col(quoted(c[1:])).desc_nulls_last() if c.startswith("-") else F.col(quoted(c)).asc_nulls_last() for c in order]


def running_total(
    df: DataFrame,
    order: Sequence[str],
    value: str,
    keys: Sequence[str] = (),
    out: str = "running_total",
    total: str = "total",
    chunks: int | None = None,
) -> DataFrame:
    """Running and full total of ``value`` per group, in a unique row order (as of ``sort_columns``).

    1. Range-partition keys, order and value by (group, order) and number the
       partitions, so a hot group spans several.  This slim table is stored, no
       other column is: later passes must see the same chunks, whatever adaptive
       execution or a lost executor does.
    2. Add up each chunk; there are ``chunks`` of them, by default one per
       ``CHUNK_ROWS`` rows and one per shuffle partition at least, so a chunk is
       small whatever the input and the window over chunk totals is too.
    3. Join the total of earlier chunks back and run the window inside chunks.
    4. The rows with all their columns, if there are others, meet their totals by
       keys and order.  ``df`` is read again for that; rows that tie in a group
       then end the query with an error.

    Missing values count as zero.
    """
    keys, place = list(keys), [c.removeprefix("-") for c in order]
    by = sort_columns(order)
    if chunks is None:
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chunks = max(least, -(-df.count() // CHUNK_ROWS))
    shape = list(dict.fromkeys([*keys, *place, value]))
    whole = set(df.columns) <= set(shape)
    ranged = df.select(*map(quoted, shape)).repartitionByRange(chunks, *[F.col(quoted(k)).asc() for k in keys], *by)
    stored = materialise(ranged.withColumn("__chunk", F.spark_partition_id()), "running")

    sums = stored.groupBy(*keys, "__chunk").agg(F.sum(value).alias("__sum"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        "__chunk",
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"),
        F.coalesce(F.sum("__sum").over(group), F.lit(0)).alias(total),
    )
    chunk = Window.partitionBy(*keys, "__chunk").orderBy(*by)
    within = chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = (
        join_on(stored, offsets, [*keys, "__chunk"], "inner", null_safe=True)
        .withColumn(out, F.col("__before") + F.coalesce(F.sum(value).over(within), F.lit(0)))
    )
    if whole:
        return summed.select(*map(quoted, df.columns), total, out)
    # Rows that tie stand side by side in one chunk.
    spot = F.struct(*map(quoted, place))
    tie = F.raise_error(F.concat(F.lit("rows tie in the order "), F.lit(", ".join(order)))).cast("boolean")
    alone = F.when(F.lag(spot).over(chunk).eqNullSafe(spot), tie).otherwise(F.lit(True))
    summed = summed.withColumn("__alone", alone).where("__alone")
    at = list(dict.fromkeys([*keys, *place]))
    return join_on(df, summed.select(*map(quoted, at), total, out), at, "inner", null_safe=True)


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "row_index") -> DataFrame:
    """Row number inside each group, in a unique row order."""
    ones = df.withColumn("__one", F.lit(1).cast("long"))
    return running_total(ones, order, "__one", keys, out, "__total").drop("__one", "__total")


def cumulative_share(df: DataFrame, key: str, value: str) -> DataFrame:
    """Total per key, running total in descending order and its share of all (missing if all is zero)."""
    totals = df.groupBy(key).agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))
    running = running_total(totals, ["-total", key], "total", out="cumulative_sum", total="__all")
    return running.withColumn("proportion", ratio("cumulative_sum", "__all")).drop("__all")


def order_by_ranking(df: DataFrame, ranking: DataFrame, keys: Sequence[str], rank: str = "rank") -> DataFrame:
    """Sort rows by the position of their key in a ranked list, unlisted last."""
    ranked = join_on(df, ranking.select(*keys, rank), keys)
    others = [c for c in df.columns if c not in keys]
    return ranked.orderBy(F.col(rank).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in [*keys, *others]])


def group_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per group without gathering a group in one task.

    Equal values are counted first; running counts then locate the middle.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    placed = running_total(counted, [value], "__n", keys, "__upto", "__all")

    def at(position: Column) -> Column:
        hit = (F.col("__upto") >= position) & (F.col("__upto") - F.col("__n") < position)
        return F.max(F.when(hit, F.col(value)))

    low, high = F.floor((F.col("__all") + 1) / 2), F.floor(F.col("__all") / 2) + 1
    return placed.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(out))


def rank_categories(df: DataFrame, category: str, statistic: str, out: str = "rank") -> DataFrame:
    """Categories ranked by the median of a statistic; equal medians share a rank."""
    medians = group_median(df, [category], statistic)
    levels = row_index(medians.select("median").distinct(), [], ["median"], out)
    return join_on(medians, levels, ["median"])


def prefer_source(df: DataFrame, keys: Sequence[str], source: Column | str, preferred: Sequence[str]) -> DataFrame:
    """Resolve several rows per key by authority.

    A row stays if it is the only one of its key or its source is preferred.  A
    key with several rows and no preferred source disappears.  ``df`` is computed
    once and stored: rows are counted on the key columns alone, and the whole
    rows meet the keys that occur once.
    """
    stored = materialise(df, "sources")
    authoritative = is_in(source, preferred)
    return stored.where(authoritative).unionByName(only_unambiguous(stored, keys).where(~authoritative))


def only_unambiguous(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once.

    Only keys and counts go through the aggregate; rows meet the keys afterwards.
    Reads ``df`` twice; store it first if it is costly to compute.
    """
    named = {quoted(k): f"__key{i}" for i, k in enumerate(keys)}
    once = df.groupBy(*[F.col(k).alias(n) for k, n in named.items()]).agg(F.count("*").alias("__n")).where("__n = 1")
    met = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()])
    return df.join(once.drop("__n"), met, "left_semi")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a given order, missing last; of equal rows the first one stored.

    Rows are numbered and stored.  The aggregate finds the number of the first
    row on keys and order alone; the whole rows meet these numbers.
    """
    stored = materialise(df.withColumn("__number", F.monotonically_increasing_id()), "numbered")
    rank = F.struct(*[part for c in order for part in (F.col(quoted(c)).isNull(), F.col(quoted(c)))], F.col("__number"))
    first = (stored.groupBy(*[F.col(quoted(k)).alias(f"__key{i}") for i, k in enumerate(keys)])
             .agg(F.min(rank).alias("__rank")).select(F.col("__rank.__number").alias("__first")))
    return stored.join(first, F.col("__number") == F.col("__first"), "left_semi").drop("__number")


def groups_with(df: DataFrame, keys: Sequence[str], flag: Column, null_safe: bool = True) -> DataFrame:
    """All rows of the groups in which ``flag`` holds at least once."""
    hits = df.where(flag).select(*keys).distinct()
    return semi_keys(df, hits, keys, null_safe)
