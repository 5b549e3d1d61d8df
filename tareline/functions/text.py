"""Text clean-up used on names, codes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tareline.functions.nulls import col


def sentence_case(c: Column | str) -> Column:
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))


def without(c: Column | str, pattern: str) -> Column:
    return F.regexp_replace(col(c), pattern, "")


def without_commas(c: Column | str) -> Column:
    return F.replace(col(c), F.lit(","))


def first_dot_removed(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^([^.]*)\.", "$1")


def plain_spaces(c: Column | str) -> Column:
    """Non-breaking spaces become ordinary ones."""
    return F.replace(col(c), F.lit("\u00a0"), F.lit(" "))


def name_key(c: Column | str) -> Column:
    """Lower-case key for matching names whatever their capitals or spacing."""
    return F.lower(F.trim(F.regexp_replace(plain_spaces(c), r"\s+", " ")))


def clean_taxon(c: Column | str) -> Column:
    """Lower-case taxon name without rank suffix or bracketed remark.

    Only the first kind of noise found is removed: " spp" plus one following
    character, else " spp" at the very end, else everything in brackets.
    """
    c = F.lower(plain_spaces(c))
    # Fixed patterns: the any-character dot and the greedy bracket are intended.
    dotted, bare, bracket = " spp.", " spp", r"\(.*\)"

    def drop_first(pattern: str) -> Column:
        return F.regexp_replace(c, f"^(.*?){pattern}", "$1")

    cleaned = (
        F.when(c.rlike(dotted), drop_first(dotted))
        .when(c.rlike(bare), drop_first(bare))
        .when(c.rlike(bracket), drop_first(bracket))
        .otherwise(c)
    )
    return F.trim(cleaned)


def product_code(c: Column | str, width: int = 8) -> Column:
    """Digits of a tariff code, without spaces, zero-padded on the left."""
    digits = F.replace(col(c).cast("string"), F.lit(" "))
    missing_zeros = F.greatest(F.lit(width) - F.length(digits), F.lit(0))
    return F.concat(F.repeat(F.lit("0"), missing_zeros), digits)
