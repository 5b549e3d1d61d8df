"""Value maps and ordered text rules as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tareline.functions.nulls import col


def recode(c: Column | str, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Replace listed values; others become ``default`` or stay as they are."""
    c = col(c)
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), c)
    return F.coalesce(found, c if default is None else F.lit(default))


def _first_true(branches: Sequence[tuple[Column, Column]]) -> Column:
    """``CASE WHEN`` over the branches, without ``ELSE``."""
    (condition, value), *rest = branches
    out = F.when(condition, value)
    for condition, value in rest:
        out = out.when(condition, value)
    return out


def first_match(c: Column | str, rules: Sequence[tuple[str, str]], default: Column | str | None = None) -> Column:
    """Label of the first pattern found in the text; missing text never matches."""
    c = col(c)
    out = _first_true([(c.rlike(pattern), F.lit(label)) for pattern, label in rules])
    if default is None:
        return out
    return out.otherwise(F.lit(default) if isinstance(default, str) else default)


def last_match(rules: Sequence[tuple[Column, str | None]]) -> Column:
    """Label of the last rule that holds; a later rule may reset to missing."""
    return _first_true([(condition, F.lit(label).cast("string")) for condition, label in reversed(rules)])
