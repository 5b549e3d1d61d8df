"""Ratios, displays and sums that do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tareline.functions.nulls import col


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient, missing when the denominator is zero."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def exact_mean(c: Column | str, scale: int = 6) -> Column:
    """Mean of decimal quantities, the same for every partitioning.

    Factors are quoted with a few decimal places.  Adding them as decimals
    makes the sum exact, so repeated runs agree to the last bit.
    """
    c = col(c)
    return F.sum(c.cast(f"decimal(18,{scale})")).cast("double") / F.count(c)


def rounded(c: Column | str, digits: int) -> Column:
    """Round positive measures to ``digits`` places, halves upwards."""
    unit = float(10**digits)
    return F.floor(col(c) * unit + 0.5) / unit


def display(c: Column | str, digits: int = 2) -> Column:
    """Fixed-decimal text, for sinks only; halves go to the even digit."""
    return F.format_string(f"%.{digits}f", F.bround(col(c), digits))
