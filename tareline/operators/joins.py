"""Equality joins with named key pairs on each side.

Nothing here forces a broadcast; see ``session.recommended_conf`` for how Spark
chooses and what happens to large or hot sides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = Sequence[str] | Mapping[str, str]


def join_on(left: DataFrame, right: DataFrame, keys: Keys, how: str = "left", null_safe: bool = False) -> DataFrame:
    """Join on ``keys`` (names, or left name -> right name); the right keys are dropped.

    ``null_safe`` lets a missing key meet a missing key.
    """
    pairs = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}
    renamed = right.withColumnsRenamed({r: f"__key_{r}" for r in pairs.values()})

    def meets(l: str, r: str) -> Column:
        a, b = F.col(l), F.col(f"__key_{r}")
        return a.eqNullSafe(b) if null_safe else a == b

    condition = reduce(Column.__and__, [meets(l, r) for l, r in pairs.items()])
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"__key_{r}" for r in pairs.values()])


def semi_keys(df: DataFrame, keep: DataFrame, keys: Keys, null_safe: bool = False) -> DataFrame:
    """Rows whose key occurs in ``keep``, compared part by part."""
    return join_on(df, keep, keys, "left_semi", null_safe)


def missing_keys(df: DataFrame, have: DataFrame, keys: Keys, null_safe: bool = False) -> DataFrame:
    """Rows whose key does not occur in ``have``."""
    return join_on(df, have, keys, "left_anti", null_safe)


def attach_group_stats(df: DataFrame, keys: Sequence[str], null_safe: bool = True, **stats: Column) -> DataFrame:
    """Repeat group statistics on every row of the group.

    Aggregates first and joins back instead of using a window: the aggregate
    combines on the map side and a hot group is split by the skew join, so no
    single task ever holds a whole group.
    """
    per_group = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return join_on(df, per_group, keys, "left", null_safe)


def match_factor(
    facts: DataFrame,
    factors: DataFrame,
    keys: Keys,
    factor: str = "conversion_factor",
    into: str = "factor",
    extra: Mapping[str, str] | None = None,
) -> DataFrame:
    """Left-join one factor column (and ``extra`` columns, renamed) to facts.

    Apply a duplicate policy to ``factors`` first: several rows per key multiply
    the facts.  Facts without a factor keep a missing one.
    """
    extra = dict(extra or {})
    right_keys = list(keys.values()) if isinstance(keys, Mapping) else list(keys)
    slim = factors.select(*right_keys, F.col(factor).alias(into), *[F.col(c).alias(n) for c, n in extra.items()])
    return join_on(facts, slim, keys)


def apply_factor(df: DataFrame, value: str, products: Mapping[str, str]) -> DataFrame:
    """Add ``value * factor`` columns: new column name -> factor column."""
    return df.withColumns({name: F.col(value) * F.col(f) for name, f in products.items()})
