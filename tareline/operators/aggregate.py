"""Group summaries.  All combine on the map side before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tareline.functions.measure import exact_mean, ratio, rounded
from tareline.functions.nulls import max_of, min_of, paste
from tareline.operators.joins import attach_group_stats, semi_keys


def range_summary(
    df: DataFrame,
    keys: Sequence[str],
    factor: str,
    counts: Mapping[str, Column] | None = None,
    na: str = "skip",
) -> DataFrame:
    """Rows, conditional counts, largest, smallest and range of a factor per group."""
    top, low = max_of(factor, na), min_of(factor, na)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_CF"),
        *[F.count_if(c).alias(n) for n, c in (counts or {}).items()],
        top.alias("max_CF"),
        low.alias("min_CF"),
        (top - low).alias("range"),
    )


def relative_to_minimum(df: DataFrame, keys: Sequence[str], factor: str, null_safe: bool = True) -> DataFrame:
    """Each factor against the smallest of its group, with the group's range."""
    spread = attach_group_stats(
        df, keys, null_safe,
        min_in_group=F.min(factor), max_in_group=F.max(factor),
        range_in_group=F.max(factor) - F.min(factor),
    )
    return spread.withColumns({
        "cf_relative": ratio(factor, "min_in_group"),
        "max_cf_relative": ratio("max_in_group", "min_in_group"),
    })


def list_members(df: DataFrame, keys: Sequence[str], member: str, out: str, count: str | None = None,
                 sep: str = ", ") -> DataFrame:
    """Sorted text list of the distinct members of each group.

    The cell is as long as the member vocabulary (country codes), not as the
    group.  For open vocabularies keep the distinct rows instead.
    """
    distinct = df.select(*keys, member).where(F.col(member).isNotNull()).distinct()
    listed = F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), sep)
    number = [F.count("*").alias(count)] if count else []
    return distinct.groupBy(*keys).agg(listed.alias(out), *number)


def min_max_with_holders(df: DataFrame, keys: Sequence[str], factor: str, holder: str, prefix: str = "cf",
                         sep: str = ", ", na: str = "skip") -> DataFrame:
    """Smallest and largest factor per group and the list of holders of each.

    Distinct (group, factor, holder) rows are listed per factor value first;
    the extreme lists are then picked by ``min_by`` / ``max_by``.  A missing
    holder is listed as ``NA``.  With ``na="propagate"`` a group holding a
    missing factor has no extremes.
    """
    rows = df.select(*keys, factor, paste(holder).alias(holder))
    if na == "skip":
        rows = rows.where(F.col(factor).isNotNull())
    named = list_members(rows, [*keys, factor], holder, "__holders", sep=sep)
    known = F.count_if(F.col(factor).isNull()) == 0
    return named.groupBy(*keys).agg(
        min_of(factor, na).alias(f"min_{prefix}"),
        max_of(factor, na).alias(f"max_{prefix}"),
        F.when(known, F.min_by("__holders", factor)).alias(f"min_{holder}"),
        F.when(known, F.max_by("__holders", factor)).alias(f"max_{holder}"),
    )


def group_by_all_but(df: DataFrame, measures: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Sum the measures over every other column, ``drop`` columns left out."""
    keys = [c for c in df.columns if c not in {*measures, *drop}]
    return df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def bucket_uncovered(df: DataFrame, factor: str, label: str, bucket: str, measures: Sequence[str],
                     drop: Sequence[str] = (), tag: str = "catch_vs_unaccounted") -> DataFrame:
    """Collapse rows without a factor into one label, sum, and tag them.

    A row with a factor and a row of the bucket never share a group, because
    the factor column stays a key.  Sums of missing measures are zero.
    """
    relabelled = df.withColumn(label, F.when(F.col(factor).isNull(), F.lit(bucket)).otherwise(F.col(label)))
    summed = group_by_all_but(relabelled, measures, drop).na.fill(0, list(measures))
    tagged = F.when(F.col(factor).isNull(), "unaccounted").otherwise("catch")
    return summed.withColumn(tag, tagged)


def covered_totals(df: DataFrame, keys: Sequence[str], factor: str, value: str) -> DataFrame:
    """Covered and uncovered quantity per group in one pass."""
    known = F.col(factor).isNotNull()
    return df.groupBy(*keys).agg(
        F.sum(F.when(known, F.col(value))).alias("covered"),
        F.sum(F.when(~known, F.col(value))).alias("uncovered"),
    )


def merged_sources(column: str, sep: str = ", ") -> Column:
    """The different sources of a group as sorted text, missing ones left out; missing if there is none.

    A cell is as long as the vocabulary of sources at most, whatever the group.
    """
    return F.nullif(F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), sep), F.lit(""))


def consolidate_factors(df: DataFrame, keys: Sequence[str], factor: str = "conversion_factor",
                        policy: str = "mean", digits: int | None = None, sources: Sequence[str] = ()) -> DataFrame:
    """One factor per key: ``mean``, ``min`` or ``max``; the mean may be rounded.

    ``sources`` names columns of provenance, which are merged per key so that
    the factor keeps the list of what it was made of.
    """
    mean = exact_mean(factor)
    choice = {"mean": mean if digits is None else rounded(mean, digits),
              "min": F.min(factor), "max": F.max(factor)}[policy]
    return df.groupBy(*keys).agg(choice.alias(factor), *[merged_sources(c).alias(c) for c in sources])


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Number of different values of several columns."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(c).alias(f"n_{c}") for c in columns])


def share_by_pattern(df: DataFrame, text: str, value: str, patterns: Sequence[str]) -> DataFrame:
    """Share of the total held by rows matching each pattern, in one scan.

    Quantities are summed per text first, so patterns are tried once per
    different text and not once per row.  Shares of a zero total are missing.
    """
    df = df.groupBy(text).agg(F.sum(value).alias(value))
    total = F.sum(value).alias("total")
    parts = [F.sum(F.when(F.col(text).rlike(p), F.col(value)).otherwise(F.lit(0))).alias(f"p{i}")
             for i, p in enumerate(patterns)]
    sums = df.agg(total, *parts)
    shares = [F.struct(F.lit(p).alias("pattern"), ratio(f"p{i}", "total").alias("share")) for i, p in enumerate(patterns)]
    return sums.select(F.inline(F.array(*shares)))


def coverage_ratio(landed: DataFrame, held: DataFrame, keys: Sequence[str], member: str,
                   lists: tuple[str, str] | None = None) -> DataFrame:
    """Share of the members landing a product that also hold a factor for it.

    Both sides are stacked with a tag and counted per (key, member), so there
    is neither a join nor a member list, and any repetition is combined before
    the shuffle.  Keys only held are left out.  ``lists`` names two columns for
    the sorted lists of members landing, and of members holding a factor; a
    cell is as long as the member vocabulary at most.
    """
    def tagged(df: DataFrame, landed: int, held: int) -> DataFrame:
        return df.select(*keys, member, F.lit(landed).alias("landed"), F.lit(held).alias("held"))

    stacked = tagged(landed, 1, 0).unionByName(tagged(held, 0, 1)).where(F.col(member).isNotNull())
    members = stacked.groupBy(*keys, member).agg(F.max("landed").alias("landed"), F.max("held").alias("held"))
    counts = members.groupBy(*keys).agg(
        F.sum("landed").alias("n_countries_landing"),
        F.sum("held").alias("n_CF"),
        F.sum(F.col("landed") * F.col("held")).alias("n_CF_with_landings"),
        *[F.array_join(F.array_sort(F.collect_set(F.when(F.col(side) == 1, F.col(member).cast("string")))), ", ").alias(name)
          for side, name in zip(("landed", "held"), lists or ())],
    ).where("n_countries_landing > 0")
    return counts.withColumn("proportion_have_CF", ratio("n_CF_with_landings", "n_countries_landing"))


def series_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str,
                      names: tuple[str, str], keep: str = "left") -> DataFrame:
    """Two series side by side with their difference, without a join.

    ``keep='left'`` keeps the keys of the first series, ``'all'`` those of both.
    """
    first, second = names
    stacked = a.select(*keys, F.lit(True).alias("__a"), value).unionByName(
        b.select(*keys, F.lit(False).alias("__a"), value))
    both = stacked.groupBy(*keys).agg(
        F.sum(F.when(F.col("__a"), F.col(value))).alias(first),
        F.sum(F.when(~F.col("__a"), F.col(value))).alias(second),
        F.count_if("__a").alias("__n"),
    )
    kept = both.where("__n > 0") if keep == "left" else both
    return kept.drop("__n").withColumn("difference", F.col(first) - F.col(second))


def restrict_to_top(df: DataFrame, ranked: DataFrame, key: str) -> DataFrame:
    """Rows of the keys listed in a top-k table."""
    return semi_keys(df, ranked.select(key), [key])
