"""Jobs that turn wide, flagged statistics files into tidy tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tareline import vocab
from tareline.functions.recode import recode
from tareline.operators.filters import clean_filter
from tareline.operators.lookup import decode_codes, resolve_country, resolve_synonyms
from tareline.operators.reshape import YEAR_COLUMN, split_pair, unpack_years
from tareline.sources.wide import read_wide_flagged

LANDINGS_NAMES = {
    "pres": "presentation",
    "dest_use": "use",
    "natvessr": "nationality_of_vessel",
    "geo": "reporting_entity",
}
CATCH_NAMES = {"fishreg": "fishing_region", "geo": "reporting_entity"}


def tidy_wide(wide: DataFrame, dictionaries: Mapping[str, DataFrame], names: Mapping[str, str],
              synonyms: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Decode rows with packed year cells, split names, then one row per year.

    The cells stay packed until the end, so a lookup is made per key and not per
    cell, and files of any headers are decoded by one set of joins.
    """
    known = {c: d for c, d in dictionaries.items() if c in wide.columns}
    coded = decode_codes(wide, known, code_suffix="_code", strict=strict)
    named = split_pair(coded, "species", ("common_name", "scientific_name"))
    named = named.withColumnsRenamed({**names, **{f"{k}_code": f"{v}_code" for k, v in names.items()}})
    if synonyms is not None:
        named = resolve_synonyms(named, "scientific_name", synonyms, strict=strict)
    return unpack_years(named)


def clean_landings(spark: SparkSession, paths: list[str] | str, dictionaries: Mapping[str, DataFrame],
                   synonyms: DataFrame | None = None, years: str = YEAR_COLUMN, strict: bool = True) -> DataFrame:
    """Tidy landings of any number of files whose year columns may differ.

    With ``strict=False`` ambiguous dictionary and synonym entries are left out
    instead of ending the run.
    """
    return tidy_wide(read_wide_flagged(spark, paths, years=years), dictionaries, LANDINGS_NAMES, synonyms, strict)


def clean_catch(spark: SparkSession, paths: list[str] | str, dictionaries: Mapping[str, DataFrame],
                synonyms: DataFrame | None = None, years: str = YEAR_COLUMN, strict: bool = True) -> DataFrame:
    """Tidy catch by fishing region, from files of the same layout."""
    return tidy_wide(read_wide_flagged(spark, paths, years=years), dictionaries, CATCH_NAMES, synonyms, strict)


def with_countries(landings: DataFrame, countries: DataFrame) -> DataFrame:
    """Country codes of the vessel and of the port; unions of countries stay missing.

    The two-letter codes follow the labels of the landings files.
    """
    vessel = {"iso3c": "iso3c", "iso2c": "iso2c"}
    port = {"iso3c": "port_iso3c", "iso2c": "port_iso2c"}
    coded = resolve_country(landings, "nationality_of_vessel", countries, vessel)
    coded = resolve_country(coded, "reporting_entity", countries, port)
    return coded.withColumns({c: recode(c, vocab.RELABELLED_ISO2) for c in ("iso2c", "port_iso2c")})


def usable_catch(catch: DataFrame, unit: str = vocab.LIVE_WEIGHT) -> DataFrame:
    """Known catch of one unit for named taxa."""
    return clean_filter(catch, filled=["scientific_name", "value"], equals={"unit": unit})


def unit_prices(landings: DataFrame, unit: str = vocab.UNIT_PRICE, use: str = vocab.TOTAL_USE) -> DataFrame:
    """Prices reported among the landings, for ``value_catch``."""
    priced = clean_filter(landings, filled=["value"], equals={"unit": unit, "use": use})
    return priced.withColumnRenamed("value", "Euro_per_tonne")


def usable_landings(landings: DataFrame, unit: str = vocab.PRODUCT_WEIGHT, use: str = vocab.TOTAL_USE,
                    years: tuple[int | None, int | None] | None = None) -> DataFrame:
    """Known, non-zero landings of one unit and use, without presentation totals."""
    kept = clean_filter(
        landings, nonzero=["value"], filled=["scientific_name"], equals={"unit": unit, "use": use},
        exclude={"presentation": vocab.PRESENTATION_TOTALS}, years=years)
    return kept.withColumn(
        "nationality_of_vessel", recode("nationality_of_vessel", vocab.RELABELLED_COUNTRIES))
