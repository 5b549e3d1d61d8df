"""Dictionary, synonym, common-name and country lookups as joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tareline.functions.nulls import is_blank
from tareline.functions.text import name_key
from tareline.operators.joins import join_on
from tareline.session import small_table


def decode_codes(df: DataFrame, dictionaries: Mapping[str, DataFrame], code_suffix: str | None = None,
                 strict: bool = True) -> DataFrame:
    """Replace codes by labels column by column; unknown codes stay.

    A dictionary has columns ``code`` and ``label``.  Repeated entries count
    once; a code with two labels is an error, or left out with ``strict=False``.
    ``code_suffix`` keeps the code beside the label, which matters where
    several codes share one label.
    """
    order = df.columns
    for column, dictionary in dictionaries.items():
        labels = unique_lookup(dictionary.select("code", F.col("label").alias("__label")), "code", "__label", strict)
        df = join_on(df, labels, {column: "code"})
        if code_suffix:
            df = df.withColumn(column + code_suffix, F.col(column))
        df = df.withColumn(column, F.coalesce("__label", column)).drop("__label")
    extra = [c for c in df.columns if c not in order]
    return df.select(*order, *extra)


def unique_lookup(table: DataFrame, key: str, value: str, strict: bool = True) -> DataFrame:
    """One row per key, so a lookup never multiplies facts.

    Repeated identical entries count once.  A key with different values is an
    error raised when the query runs, or with ``strict=False`` it is left out.
    """
    grouped = (table.where(F.col(key).isNotNull() & F.col(value).isNotNull())
               .groupBy(key).agg(F.min(value).alias("__low"), F.max(value).alias(value)))
    single = F.col("__low").eqNullSafe(F.col(value))
    if not strict:
        return grouped.where(single).select(key, value)
    message = F.concat(F.lit("ambiguous lookup entry: "), F.col(key).cast("string"))
    return grouped.select(key, F.when(single, F.col(value)).otherwise(F.raise_error(message)).alias(value))


def resolve_synonyms(df: DataFrame, name: str, *tiers: DataFrame, synonym: str = "synonym", accepted: str = "accepted",
                     status: str = "status", binomial_only: bool = False, strict: bool = True) -> DataFrame:
    """Replace outdated names by accepted ones; earlier tables take precedence.

    Only entries whose status is ``synonym`` count.  ``binomial_only`` leaves
    names of one word alone.
    """
    order = df.columns
    found = []
    for i, tier in enumerate(tiers):
        entries = tier.where(F.col(status) == "synonym")
        entries = entries.where(F.contains(F.col(synonym), F.lit(" "))) if binomial_only else entries
        table = unique_lookup(entries, synonym, accepted, strict).withColumnRenamed(accepted, f"__accepted{i}")
        df = join_on(df, table, {name: synonym})
        found.append(f"__accepted{i}")
    return df.withColumn(name, F.coalesce(*found, name)).select(*order)


def resolve_common_names(df: DataFrame, common: str, name: str, table: DataFrame,
                         table_common: str = "common_name", table_name: str = "scientific_name") -> DataFrame:
    """Fill blank scientific names from exact, unambiguous common names."""
    entries = table.select(F.col(table_common).alias("__common"), F.col(table_name).alias("__name"))
    known = join_on(df, unique_lookup(entries, "__common", "__name", strict=False), {common: "__common"})
    filled = F.when(is_blank(name), F.coalesce(F.lower("__name"), F.col(name))).otherwise(F.col(name))
    return known.withColumn(name, filled).select(*df.columns)


def resolve_country(df: DataFrame, name: str, countries: DataFrame, into: Mapping[str, str] | None = None,
                    key: str = "name_key", strict: bool = True) -> DataFrame:
    """Add codes and continent by country name; unknown names stay missing.

    ``countries`` holds a row per spelling, aliases and overrides included,
    under a lower-case ``name_key``.  Repeated rows count once; a spelling with
    different codes is an error, or left out with ``strict=False``.
    """
    into = dict(into or {"iso3c": "iso3c", "iso2c": "iso2c", "continent": "continent"})
    codes = F.struct(*[F.col(c).alias(n) for c, n in into.items()]).alias("__codes")
    table = unique_lookup(countries.select(F.col(key).alias("__name_key"), codes), "__name_key", "__codes", strict)
    table = table.select("__name_key", *[F.col(f"__codes.{n}").alias(n) for n in into.values()])
    keyed = df.withColumn("__name", name_key(name))
    return join_on(keyed, table, {"__name": "__name_key"}).drop("__name")


def fixed_overrides(spark: SparkSession, spellings: Mapping[str, tuple[str, str]],
                    overrides: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Rows ``name_key, of_key, country, iso3c, iso2c, continent`` of other spellings and of values to replace."""
    rows = [(key, of, name, None, None, None) for key, (of, name) in spellings.items()]
    rows += [(key, key, *(one.get(c) for c in ("country", "iso3c", "iso2c", "continent"))) for key, one in overrides.items()]
    schema = "name_key string, of_key string, country string, iso3c string, iso2c string, continent string"
    return small_table(spark, rows, schema)


def with_overrides(countries: DataFrame, *overrides: DataFrame) -> DataFrame:
    """A country table with other spellings added and single values replaced.

    ``countries`` has columns ``name_key, country, iso3c, iso2c, continent``;
    override rows as of ``fixed_overrides``, earlier tables taking precedence.
    A row takes what it does not state from the country ``of_key``.  A spelling
    that ``countries`` itself lists is left alone; a row with its own key as
    ``of_key`` replaces values of that country, or adds it.
    """
    shape = ["country", "iso3c", "iso2c", "continent"]
    ranked = [o.select("name_key", "of_key", *shape, F.lit(i).alias("__tier")) for i, o in enumerate(overrides)]
    best = reduce(DataFrame.unionByName, ranked).groupBy("name_key").agg(F.min_by(F.struct("of_key", *shape), "__tier").alias("__o"))
    known = countries.select("name_key", F.lit(True).alias("__listed")).distinct()
    own = F.col("__o.of_key") == F.col("name_key")
    wanted = join_on(best, known, ["name_key"]).where(own | F.col("__listed").isNull())
    base = countries.select(F.col("name_key").alias("__base"), *[F.col(c).alias(f"__{c}") for c in shape])
    made = wanted.join(base, F.col("__o.of_key") == F.col("__base"), "left").where(own | F.col("__base").isNotNull()).select(
        "name_key", *[F.coalesce(f"__o.{c}", f"__{c}").alias(c) for c in shape])
    rest = countries.select("name_key", *shape).join(made.select(F.col("name_key").alias("__made")),
                                                     F.col("name_key") == F.col("__made"), "left_anti")
    return rest.unionByName(made)


def membership_flag(df: DataFrame, column: str, members: DataFrame, out: str,
                    yes: str = "EU", no: str = "non-EU") -> DataFrame:
    """Label rows by membership of a one-column table; missing is no member."""
    key = members.columns[0]
    table = members.select(F.col(key).alias("__member"), F.lit(yes).alias("__yes")).distinct()
    joined = join_on(df, table, {column: "__member"})
    return joined.withColumn(out, F.coalesce("__yes", F.lit(no))).drop("__yes")


def mark_non_members(df: DataFrame, label: str, column: str, members: DataFrame, mark: str = "*") -> DataFrame:
    """Append a mark to the label of rows whose ``column`` is no member."""
    flagged = membership_flag(df, column, members, "__mark", yes="", no=mark)
    return flagged.withColumn(label, F.concat(F.col(label).cast("string"), "__mark")).drop("__mark")


def align_vocab(a: DataFrame, b: DataFrame, term: str, names: tuple[str, str]) -> DataFrame:
    """Two vocabularies side by side; a term absent on one side is missing there.

    Stacked and counted per term: the full outer alignment in one shuffle, and
    repeated terms are combined before it.
    """
    def terms(df: DataFrame, a: int, b: int) -> DataFrame:
        return df.select(F.col(term).alias("__term"), F.lit(a).alias("__a"), F.lit(b).alias("__b"))

    both = terms(a, 1, 0).unionByName(terms(b, 0, 1)).where(F.col("__term").isNotNull())
    found = both.groupBy("__term").agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    sides = [F.when(F.col(c) == 1, F.col("__term")).alias(n) for c, n in zip(("__a", "__b"), names)]
    return found.orderBy("__term").select(*sides)


def project_rename(df: DataFrame, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Select columns, renaming old -> new where a mapping is given."""
    pairs = columns if isinstance(columns, Mapping) else {c: c for c in columns}
    return df.select(*[F.col(old).alias(new) for old, new in pairs.items()])
