"""Cells that hold a number, observation flags and a marker for missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tareline.functions.nulls import col

# Fixed format: flags are " letters" after the number, ":" marks a missing cell.
FLAG_RUN = r" ([A-Za-z]+)"
MISSING_MARK = ":"
NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
NUMBER_THEN_FLAGS = rf"^\s*({NUMBER})(?: [A-Za-z]+)*\s*$"


def number_or_null(c: Column | str) -> Column:
    """Plain decimal text to double; anything else is missing.

    The pattern keeps Java-only spellings such as ``1d`` from passing as numbers.
    """
    text = F.trim(col(c).cast("string"))
    return F.when(text.rlike(f"^{NUMBER}$"), text.try_cast("double"))


def flagged_value(c: Column | str) -> Column:
    """Number of the cell after every flag run is removed.

    A missing mark blanks the cell.  One pattern settles the usual "number,
    then flags" cell; only other cells take the replace-and-check way.
    """
    c = col(c)
    usual = F.regexp_extract(c, NUMBER_THEN_FLAGS, 1).try_cast("double")
    unusual = number_or_null(F.regexp_replace(c, FLAG_RUN, ""))
    return F.when(~F.contains(c, F.lit(MISSING_MARK)), F.coalesce(usual, unusual))


def flag_letters(c: Column | str) -> Column:
    """Flags of the cell in order of appearance, missing when there are none."""
    c = col(c)
    letters = F.array_join(F.regexp_extract_all(c, F.lit(FLAG_RUN), F.lit(1)), "")
    return F.when(F.contains(c, F.lit(" ")), F.nullif(letters, F.lit("")))
