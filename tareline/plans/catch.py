"""Jobs that multiply landings by factors and compare the estimates.

Landings have ``scientific_name, presentation, iso3c`` (vessel), ``port_iso3c``,
``year, value``; factors are compiled factors.  A product's ``presentation``
meets the factors' ``landings_code``.

Landings are summed to the annual grain *before* factors are joined.  A factor
is constant inside that grain, so the result is the same, the facts combine on
the map side, and the joins see only the small annual panel.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tareline import vocab
from tareline.functions.nulls import if_known, is_in
from tareline.operators.aggregate import (
    bucket_uncovered,
    consolidate_factors,
    merged_sources,
    min_max_with_holders,
    series_difference,
)
from tareline.operators.filters import member_filter
from tareline.operators.joins import apply_factor, join_on, match_factor, semi_keys
from tareline.operators.lookup import mark_non_members
from tareline.operators.ranking import groups_with, max_rows_per_group, row_index
from tareline.operators.reshape import densify_years, lift_category, unpivot_measures
from tareline.session import materialise

PRODUCT = ["scientific_name", "presentation"]
ON_PRODUCT = {"scientific_name": "scientific_name", "presentation": "landings_code"}


def annual_panel(landings: DataFrame, keys: Iterable[str], value: str = "value", year: str = "year",
                 out: str = "landings") -> DataFrame:
    """Landings summed per key and year."""
    return landings.groupBy(*keys, year).agg(F.sum(value).alias(out))


def restricted(landings: DataFrame, factors: DataFrame, members: DataFrame | None, sources: Sequence[str] | None,
               taxa: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Landings of member countries and listed taxa; factors of the named authorities."""
    if members is not None:
        landings = member_filter(landings, "iso3c", members)
    if taxa is not None:
        landings = semi_keys(landings, taxa.select("scientific_name").distinct(), ["scientific_name"])
    if sources is not None:
        factors = factors.where(is_in("reference", sources))
    return landings, factors


def min_max_by_product(landings: DataFrame, factors: DataFrame, members: DataFrame | None = None,
                       first_year: int | None = None, na: str = "skip", sources: Sequence[str] | None = None,
                       taxa: DataFrame | None = None) -> DataFrame:
    """Catch under the smallest and largest factor, per product and year.

    ``na="propagate"`` treats a product with any missing factor as uncovered.
    ``sources`` restricts the factors to those authorities, ``taxa`` the
    landings to a list of taxa.
    """
    landings, factors = restricted(landings, factors, members, sources, taxa)
    if first_year is not None:
        landings = landings.where(F.col("year") >= first_year)
    panel = annual_panel(landings, PRODUCT, out="year_landings")
    extremes = min_max_with_holders(factors, ["scientific_name", "landings_code"], "conversion_factor", "iso3c", na=na)
    joined = join_on(panel, extremes, ON_PRODUCT)
    return apply_factor(joined, "year_landings", {"year_catch_min": "min_cf", "year_catch_max": "max_cf"})


def catch_min_max_series(by_product: DataFrame) -> DataFrame:
    """Per taxon and year: catch range of covered products, landings of the others."""
    covered = F.col("min_cf").isNotNull()
    return by_product.groupBy("scientific_name", "year").agg(
        F.sum("year_catch_min").alias("year_total_catch_min"),
        F.sum("year_catch_max").alias("year_total_catch_max"),
        F.sum(F.when(~covered, F.col("year_landings"))).alias("year_landings_no_cf"),
    ).withColumn("difference", F.col("year_total_catch_max") - F.col("year_total_catch_min"))


def referenced(factors: DataFrame) -> DataFrame:
    """Factors with a column of their source, missing where the table has none."""
    return factors if "reference" in factors.columns else factors.withColumn("reference", F.lit(None).cast("string"))


def national_and_wide(factors: DataFrame, digits: int | None) -> tuple[DataFrame, DataFrame]:
    """Factors averaged per product and country, with their merged sources; and the bloc-wide ones among them.

    Columns ``national_CF, national_ref`` and ``EU_wide_CF, EU_ref``.
    """
    key = ["scientific_name", "landings_code", "iso3c"]
    own = consolidate_factors(referenced(factors), key, digits=digits, sources=["reference"])
    own = materialise(own, "factors").withColumnsRenamed({"conversion_factor": "national_CF", "reference": "national_ref"})
    wide = own.where(F.col("iso3c") == vocab.WIDE_CODE).select(
        "scientific_name", "landings_code", F.col("national_CF").alias("EU_wide_CF"), F.col("national_ref").alias("EU_ref"))
    return own, wide


def catch_per_presentation(landings: DataFrame, factors: DataFrame, labels: Sequence[str] = (), digits: int | None = None,
                           members: DataFrame | None = None, sources: Sequence[str] | None = None,
                           taxa: DataFrame | None = None) -> DataFrame:
    """Yearly landings and both catches per vessel country, taxon and presentation, covered or not.

    Each factor comes with the sources it was averaged from (``national_ref``,
    ``EU_ref``).  ``labels`` names columns of the landings, such as the common
    name, that are kept as part of the key.
    """
    landings, factors = restricted(landings, factors, members, sources, taxa)
    own, wide = national_and_wide(factors, digits)
    panel = annual_panel(landings, [*labels, *PRODUCT, "iso3c"])
    matched = match_factor(panel, own, {**ON_PRODUCT, "iso3c": "iso3c"}, "national_CF", "national_CF", {"national_ref": "national_ref"})
    matched = match_factor(matched, wide, ON_PRODUCT, "EU_wide_CF", "EU_wide_CF", {"EU_ref": "EU_ref"})
    return apply_factor(matched, "landings", {"catch_by_national_CF": "national_CF", "catch_by_EU_wide_CF": "EU_wide_CF"})


def catch_national_vs_wide(landings: DataFrame, factors: DataFrame, span: tuple[int, int] | None = None,
                           digits: int | None = None, members: DataFrame | None = None,
                           sources: Sequence[str] | None = None, taxa: DataFrame | None = None) -> DataFrame:
    """Catch by national and by bloc-wide factor per vessel country, taxon, year.

    Only presentations with both factors are compared, so a plain inner join
    restricts to the common ones; a (country, taxon) pair without any has no
    rows.  Missing years of a pair are zero; rows outside a given ``span`` are
    left out.  Members, sources and taxa restrict as in ``min_max_by_product``.
    """
    landings, factors = restricted(landings, factors, members, sources, taxa)
    own, wide = national_and_wide(factors, digits)
    both = join_on(own, wide, ["scientific_name", "landings_code"], "inner")
    panel = annual_panel(landings, [*PRODUCT, "iso3c"])
    matched = join_on(panel, both, {**ON_PRODUCT, "iso3c": "iso3c"}, "inner")
    caught = apply_factor(matched, "landings", {"national_catch": "national_CF", "EU_catch": "EU_wide_CF"})
    pair = ["iso3c", "scientific_name"]
    totals = caught.groupBy(*pair, "year").agg(F.sum("national_catch").alias("national_catch"),
                                               F.sum("EU_catch").alias("EU_catch"))
    yearly = densify_years(materialise(totals, "totals"), pair, ["national_catch", "EU_catch"], span=span)
    return yearly.withColumn("difference", F.col("national_catch") - F.col("EU_catch"))


def landings_by_coverage(landings: DataFrame, factors: DataFrame, wide: bool = False,
                         digits: int | None = None) -> DataFrame:
    """Landings and catch per presentation; those without a factor share one label.

    ``wide`` applies the bloc-wide instead of the vessel country's own factor.
    """
    own = consolidate_factors(factors, ["scientific_name", "landings_code", "iso3c"], digits=digits)
    panel = annual_panel(landings, [*PRODUCT, "iso3c"])
    if wide:
        own = own.where(F.col("iso3c") == vocab.WIDE_CODE)
    keys = ON_PRODUCT if wide else {**ON_PRODUCT, "iso3c": "iso3c"}
    matched = match_factor(panel, own, keys)
    caught = apply_factor(matched, "landings", {"catch": "factor"})
    bucket = vocab.NO_WIDE_CF if wide else vocab.NO_NATIONAL_CF
    return bucket_uncovered(caught, "factor", "presentation", bucket, ["landings", "catch"])


def largest_gaps(series: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Rows with the largest absolute difference of their key, ties kept."""
    sized = series.withColumn("gap", F.abs("difference"))
    return max_rows_per_group(sized, list(keys), "gap")


def case_study_catch(landings: DataFrame, factors: DataFrame, cases: DataFrame, years: Iterable[int],
                     grain: str = "row", labels: Sequence[str] = ()) -> DataFrame:
    """Peak landings of the case products under vessel, port and bloc-wide factors.

    ``grain='row'`` looks for the largest reported row per product and vessel,
    ``'year'`` for the largest yearly total over ports.  Only products and years
    in which some vessel factor and the bloc-wide one disagree are kept.  The
    result is distinct, so repeated rows are dropped at the start.

    Each factor comes with its source (``vessel_ref``, ``port_ref``; ``EU_ref``
    lists those of the bloc-wide factors).  ``labels`` names columns of the
    landings that stay beside the product, such as the common name and the
    reporting entity; yearly totals are kept apart by them.
    """
    wanted = landings.where(is_in("year", years) & (F.col("value") != 0) & F.col("iso3c").isNotNull())
    # Stored, the case list has a known size: a short one filters the facts without a shuffle.
    cases = materialise(cases.select("scientific_name", "landings_code").distinct(), "cases")
    wanted = semi_keys(wanted, cases, ON_PRODUCT)
    ports = ["port_iso3c"] if grain == "row" else []
    columns = [*PRODUCT, *labels, "iso3c", *ports, "year"]
    rows = (wanted.select(*columns, "value").distinct() if grain == "row"
            else annual_panel(wanted, columns[:-1], out="value"))
    peak = max_rows_per_group(materialise(rows, "rows"), [*PRODUCT, "iso3c"], "value", null_safe=False)

    factors = referenced(factors)
    national = factors.where(F.col("iso3c") != vocab.WIDE_CODE)
    by_country = {**ON_PRODUCT, "iso3c": "iso3c"}
    matched = match_factor(peak, national, by_country, into="vessel_CF", extra={"reference": "vessel_ref"})
    if ports:
        matched = match_factor(matched, national, {**ON_PRODUCT, "port_iso3c": "iso3c"}, into="port_CF",
                               extra={"reference": "port_ref"})
    wide = lift_category(factors, ["scientific_name", "landings_code"], F.col("iso3c") == vocab.WIDE_CODE,
                         "conversion_factor", "EU_CF", EU_ref=merged_sources("reference"))
    matched = join_on(matched, wide, ON_PRODUCT)
    products = {"catch_by_vessel_CF": "vessel_CF", "catch_by_EU_CF": "EU_CF"}
    if ports:
        products["catch_by_port_CF"] = "port_CF"
    caught = apply_factor(matched, "value", products)
    differs = if_known(F.col("catch_by_vessel_CF") != F.col("catch_by_EU_CF"), True, False)
    caught = materialise(caught.distinct(), "caught")
    return groups_with(caught, [*PRODUCT, "year"], differs, null_safe=False)


def case_study_long(case_study: DataFrame, members: DataFrame) -> DataFrame:
    """Landings and both catches as rows, numbered per product and vessel.

    Vessels of non-members are marked with an asterisk.
    """
    shape = case_study.select(
        *PRODUCT, "iso3c", "port_iso3c", "year", F.col("value").alias("landings"),
        "catch_by_vessel_CF", "catch_by_EU_CF", F.col("iso3c").cast("string").alias("vessel"))
    long = unpivot_measures(shape, ["landings", "catch_by_vessel_CF", "catch_by_EU_CF"])
    marked = mark_non_members(long, "vessel", "iso3c", members).distinct()
    order = ["calculation", "year", "port_iso3c", "value"]
    return row_index(marked, [*PRODUCT, "vessel"], order, "index_to_plot_all_values")


def value_catch(catch: DataFrame, prices: DataFrame, value: str = "value", price: str = "Euro_per_tonne") -> DataFrame:
    """Money value from the latest unit price of the product and vessel country."""
    latest = max_rows_per_group(prices, [*PRODUCT, "iso3c"], "year").select(*PRODUCT, "iso3c", price)
    return apply_factor(join_on(catch, latest, [*PRODUCT, "iso3c"]), value, {"Euros": price})


def landings_against_catch(landings: DataFrame, catch: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Yearly landings next to yearly catch of the same key."""
    keys = list(keys)
    return series_difference(annual_panel(landings, keys, out="total"), annual_panel(catch, keys, out="total"),
                             [*keys, "year"], "total", ("landings", "catch"), keep="all")
