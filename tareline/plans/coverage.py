"""Jobs on which landed products have a factor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tareline import vocab
from tareline.functions.nulls import is_in
from tareline.operators.aggregate import coverage_ratio, restrict_to_top, share_by_pattern
from tareline.operators.filters import member_filter
from tareline.operators.joins import join_on, missing_keys
from tareline.operators.ranking import cumulative_share, top_k
from tareline.operators.reshape import complete_grid
from tareline.operators.sets import union_sources
from tareline.plans.factors import wide_member

PRODUCT = ["scientific_name", "presentation"]


def _as_products(factors: DataFrame) -> DataFrame:
    return factors.select("scientific_name", F.col("landings_code").alias("presentation"), "iso3c")


def _of_members(df: DataFrame, members: DataFrame | None, wide: bool = False) -> DataFrame:
    """Rows of member countries, with ``wide`` also those of the bloc itself."""
    if members is None:
        return df
    return member_filter(df, "iso3c", union_sources(members, wide_member(members)) if wide else members)


def _of_sources(factors: DataFrame, sources: Sequence[str] | None) -> DataFrame:
    """Factors of the named authorities only."""
    return factors if sources is None else factors.where(is_in("reference", sources))


def coverage_grid(landings: DataFrame, factors: DataFrame, members: DataFrame | None = None,
                  sources: Sequence[str] | None = None) -> DataFrame:
    """Share of landing countries with an own factor, for every taxon x presentation, and both lists of countries.

    Cells never landed are kept with missing counts and lists.
    """
    landings, factors = _of_members(landings, members), _of_members(_of_sources(factors, sources), members)
    ratios = coverage_ratio(landings, _as_products(factors), PRODUCT, "iso3c",
                            lists=("countries_landing", "countries_with_CF"))
    return complete_grid(ratios, *PRODUCT)


def _landed_status(landings: DataFrame, factors: DataFrame, members: DataFrame | None,
                   sources: Sequence[str] | None) -> DataFrame:
    landings = _of_members(landings, members)
    factors = _of_members(_of_sources(factors, sources), members, wide=True)
    held = _as_products(factors).groupBy(*PRODUCT).agg(
        (F.count_if(F.col("iso3c") == vocab.WIDE_CODE) > 0).alias("__wide"), F.lit(True).alias("__any"))
    landed = join_on(landings.select(*PRODUCT).distinct(), held, PRODUCT)
    return landed.select(
        *PRODUCT,
        F.when(F.col("__wide"), vocab.WIDE_AVAILABLE).otherwise(vocab.NOT_AVAILABLE).alias("EU_CF"),
        F.when(F.col("__any"), "yes").otherwise("no").alias("any_CF"),
    )


def availability_grid(landings: DataFrame, factors: DataFrame, members: DataFrame | None = None,
                      sources: Sequence[str] | None = None, taxa: DataFrame | None = None) -> DataFrame:
    """Status of every taxon x presentation: bloc-wide factor, any factor, not landed.

    ``taxa``, a table of taxa, restricts the grid before it is built.
    """
    grid = complete_grid(_landed_status(landings, factors, members, sources), *PRODUCT, only=taxa)
    return grid.na.fill({"EU_CF": vocab.NOT_LANDED, "any_CF": vocab.NOT_LANDED})


def availability_totals(landings: DataFrame, factors: DataFrame, members: DataFrame | None = None,
                        sources: Sequence[str] | None = None) -> DataFrame:
    """`availability_counts` of the whole grid without building it.

    The grid has as many cells as taxa times presentations; those that are not
    among the landed products were never landed.
    """
    status = _landed_status(landings, factors, members, sources)

    def different(c: str) -> Column:
        return F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))

    counts = status.agg(
        F.count_if(F.col("any_CF") == "no").alias("landed_no_factor"),
        F.count_if(F.col("any_CF") == "yes").alias("landed_with_factor"),
        F.count("*").alias("__landed"),
        *[different(c).alias(f"__{c}") for c in PRODUCT],
    )
    cells = F.coalesce(F.col(f"__{PRODUCT[0]}") * F.col(f"__{PRODUCT[1]}"), F.lit(0))
    return counts.select((cells - F.col("__landed")).alias("not_landed"), "landed_no_factor", "landed_with_factor",
                         cells.alias("cells"))


def availability_counts(grid: DataFrame) -> DataFrame:
    """Cells not landed, landed without and landed with any factor."""
    return grid.agg(
        F.count_if(F.col("any_CF") == vocab.NOT_LANDED).alias("not_landed"),
        F.count_if(F.col("any_CF") == "no").alias("landed_no_factor"),
        F.count_if(F.col("any_CF") == "yes").alias("landed_with_factor"),
        F.count("*").alias("cells"),
    )


def top_taxa(landings: DataFrame, k: int = 50, members: DataFrame | None = None) -> DataFrame:
    """The most landed taxa with their running share of all landings."""
    landings = _of_members(landings, members)
    return top_k(cumulative_share(landings, "scientific_name", "value"), "total", k, ["scientific_name"])


def grid_of_top_taxa(grid: DataFrame, landings: DataFrame, k: int = 50, members: DataFrame | None = None) -> DataFrame:
    return restrict_to_top(grid, top_taxa(landings, k, members), "scientific_name")


def missing_factors(landings: DataFrame, factors: DataFrame, members: DataFrame | None = None,
                    sources: Sequence[str] | None = None) -> DataFrame:
    """Landed products for which neither a national nor a bloc-wide factor exists."""
    landings = _of_members(landings, members)
    factors = _of_members(_of_sources(factors, sources), members, wide=True)
    return missing_keys(landings.select(*PRODUCT).distinct(), _as_products(factors), PRODUCT)


def vague_shares(landings: DataFrame, patterns: Sequence[str] = tuple(vocab.VAGUE_PATTERNS)) -> DataFrame:
    """Share of landings under presentations that say little about the product, by pattern."""
    return share_by_pattern(landings, "presentation", "value", patterns)
