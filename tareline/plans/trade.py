"""Job that applies factors to traded quantities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tareline.functions.measure import exact_mean, rounded
from tareline.functions.nulls import not_in
from tareline.operators.aggregate import consolidate_factors
from tareline.operators.filters import member_filter
from tareline.operators.joins import apply_factor, join_on
from tareline.operators.reshape import unpivot_measures
from tareline.session import materialise



def plain_code(code: str) -> Column:
    """A product code without its spaces."""
    return F.replace(F.col(code), F.lit(" "), F.lit(""))


def prefixes(code: Column, shortest: int) -> Column:
    """The beginnings of a code from ``shortest`` characters to the whole of it; of a shorter code the code itself."""
    least = F.least(F.lit(shortest), F.length(code))
    return F.transform(F.sequence(least, F.length(code)), lambda n: F.substring(code, F.lit(1), n))


def posted_by_prefix(codes: DataFrame, posted: DataFrame, code: str, value: Column, into: str, shortest: int) -> DataFrame:
    """``code, into``: for each of ``codes`` the aggregate ``value`` of the posted rows nearest to it in the tariff.

    A posted code counts under each of its beginnings, so the rows under one
    beginning are the whole branch of the tariff.  A code takes the longest of
    its own beginnings under which there are any; lengths may be mixed on both
    sides.  Both sides are summed to codes first; one aggregate picks the longest.
    """
    branch = posted.withColumn("__prefix", F.explode(prefixes(plain_code(code), shortest))).groupBy("__prefix").agg(value.alias(into))
    own = codes.select(code).distinct().withColumn("__prefix", F.explode(prefixes(plain_code(code), shortest)))
    met = join_on(own, branch, ["__prefix"], "inner")
    return met.groupBy(code).agg(F.max_by(into, F.length("__prefix")).alias(into))


MEASURES = {"q_by_exporter": "cf_exporter", "q_by_max": "max_cf_by_code",
            "q_by_min": "min_cf_by_code", "q_by_official": "cf_official"}


def trade_live_weight(flows: DataFrame, factors: DataFrame, official: DataFrame, members: DataFrame,
                      digits: int | None = None, shortest_prefix: int | None = None,
                      exclude: Sequence[str] = ()) -> DataFrame:
    """Live weight of imports under four factors, per year, product and exporter.

    ``flows``: year, product, exporter, importer, q.  ``factors``: product,
    country, factor.  ``official``: product, factor.  Long form with the traded
    quantity as ``product form`` and the estimates as ``nominal weight``.

    With ``shortest_prefix`` official codes need not be those of the flows: a flow
    takes the mean of the official factors under the longest beginning of its
    code, of so many characters at least, that some official code has too
    (spaces removed).  Without it codes must be equal.  ``exclude`` names taxa
    whose factors take no part (``factors`` then has a column ``scientific_name``).
    """
    if exclude:
        factors = factors.where(not_in("scientific_name", exclude))
    keys = ["year", "product", "exporter"]
    traded = member_filter(flows, "importer", members).groupBy(*keys).agg(F.sum("q").alias("product_q"))
    by_code = factors.groupBy("product").agg(
        F.max("factor").alias("max_cf_by_code"), F.min("factor").alias("min_cf_by_code"))
    own = consolidate_factors(factors, ["product", "country"], "factor", digits=digits)
    own = own.withColumnRenamed("factor", "cf_exporter")
    mean = exact_mean("factor") if digits is None else rounded(exact_mean("factor"), digits)
    if shortest_prefix is None:
        posted = official.groupBy("product").agg(mean.alias("cf_official"))
    else:
        traded = materialise(traded, "traded")
        posted = posted_by_prefix(traded, official, "product", mean, "cf_official", shortest_prefix)

    matched = join_on(traded, own, {"product": "product", "exporter": "country"})
    matched = join_on(join_on(matched, by_code, ["product"]), posted, ["product"])
    weights = apply_factor(matched, "product_q", MEASURES).select(*keys, "product_q", *MEASURES)
    long = unpivot_measures(weights, ["product_q", *MEASURES])
    is_product = F.col("calculation") == "product_q"
    return long.withColumn("group", F.when(is_product, "product form").otherwise("nominal weight"))
