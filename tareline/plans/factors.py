"""Jobs on conversion factors: compile, summarise, compare, classify.

A compiled factor table has one row per factor: ``scientific_name, state,
presentation, landings_code, conversion_factor, country, iso3c, iso2c,
continent_affiliation, implementation, note, reference``.  A product is a
``(scientific_name, landings_code)`` pair.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tareline import vocab
from tareline.functions.nulls import is_blank, is_in, not_in, paste
from tareline.functions.recode import first_match, last_match, recode
from tareline.functions.text import (
    clean_taxon,
    first_dot_removed,
    name_key,
    product_code,
    sentence_case,
    without_commas,
)
from tareline.operators.aggregate import range_summary, relative_to_minimum
from tareline.operators.filters import drop_exception
from tareline.operators.joins import attach_group_stats, join_on, semi_keys
from tareline.operators.lookup import (
    align_vocab,
    fixed_overrides,
    membership_flag,
    resolve_common_names,
    resolve_country,
    resolve_synonyms,
    with_overrides,
)
from tareline.operators.ranking import only_unambiguous, prefer_source, top_k
from tareline.operators.reshape import explode_list
from tareline.operators.sets import union_sources
from tareline.session import materialise

PRODUCT = ["scientific_name", "landings_code"]
CODED = ["country", "scientific_name", "state", "presentation", "conversion_factor", "note", "reference"]


def general_source(general: DataFrame) -> DataFrame:
    """Usable rows of the general factor table, under the compiled names."""
    kept = general.where(
        not_in("Type", [vocab.EXCLUDED_TYPE]) & F.col("Type").isNotNull()
        & ~is_blank("Country") & ~is_blank("Species") & F.col("`Conversion.factor`").isNotNull()
    )
    named = kept.select(
        F.col("Country").alias("country"),
        F.col("Species").alias("scientific_name"),
        F.col("`Common.name`").alias("common_name"),
        F.lower("`Type.of.Processing`").alias("type_of_processing"),
        F.col("`Conversion.factor`").alias("conversion_factor"),
        F.col("Note").alias("note"),
        F.col("REF").alias("reference"),
    )
    superseded = None
    for column, value in vocab.SUPERSEDED_ROW.items():
        same = F.col(column) == value
        superseded = same if superseded is None else superseded & same
    return drop_exception(named, superseded).drop("common_name")


def curated_general(general: DataFrame, curated: DataFrame) -> DataFrame:
    """General rows with a state read from the text and curated presentations.

    One text may stand for several presentations; the row is then repeated.
    """
    stated = general.withColumns({
        "state": first_match("type_of_processing", vocab.STATE_RULES, vocab.UNKNOWN),
        "type_of_processing": without_commas("type_of_processing"),
    })
    usable = curated.where(~is_blank("presentation")).select("type_of_processing", "presentation")
    matched = join_on(stated, usable, ["type_of_processing"], "inner").distinct()
    return matched.where(
        (F.col("state") != vocab.UNKNOWN) & (F.col("reference") != vocab.EXCLUDED_SOURCE)
    ).select(*CODED).withColumn("presentation", recode("presentation", vocab.PRESENTATIONS, vocab.UNKNOWN))


def compile_factors(
    national: DataFrame,
    third_country: DataFrame,
    general: DataFrame,
    curated: DataFrame,
    synonyms: DataFrame,
    countries: DataFrame,
    members: DataFrame,
    strict: bool = True,
    overrides: DataFrame | None = None,
) -> DataFrame:
    """All factor sources as one harmonised table, duplicates resolved by authority.

    Usual spellings of countries, the bloc's own code and the continent of
    Greenland are known; ``overrides`` (rows as of ``fixed_overrides``) takes
    precedence over them.  With ``strict=False`` ambiguous synonyms and country
    spellings are left out instead of ending the run.
    """
    fixed = fixed_overrides(countries.sparkSession, vocab.COUNTRY_SPELLINGS, vocab.COUNTRY_OVERRIDES)
    countries = materialise(with_overrides(countries, *([overrides] if overrides is not None else []), fixed), "countries")
    coded = union_sources(national, third_country, allow_missing=True)
    official = coded.select(*[F.col("factor").alias(c) if c == "conversion_factor" else F.col(c) for c in CODED])
    official = official.withColumns({
        "state": recode("state", vocab.STATES, vocab.UNKNOWN),
        "presentation": recode("presentation", vocab.PRESENTATIONS, vocab.UNKNOWN),
    }).where(not_in("note", vocab.DEFERRING_NOTES) & (F.col("country") != ""))
    codes = {"iso3c": "iso3c", "iso2c": "iso2c"}
    official = resolve_country(official, "country", countries, codes, strict=strict).withColumn("continent", F.lit("Europe"))

    compiled = curated_general(general_source(general), curated)
    display = {**codes, "continent": "continent", "country": "__country"}
    compiled = resolve_country(compiled, "country", countries, display, strict=strict)
    compiled = compiled.withColumn("country", F.coalesce("__country", F.initcap(F.lower("country")))).drop("__country")

    named = resolve_synonyms(union_sources(compiled, official), "scientific_name", synonyms, strict=strict)
    labelled = named.withColumns({
        "scientific_name": first_dot_removed(sentence_case("scientific_name")),
        "landings_code": paste("state", "presentation", sep=", "),
    })
    flagged = membership_flag(labelled, "iso3c", union_sources(members, wide_member(members)), "affiliation")
    european = F.col("continent") == "Europe"
    full = flagged.withColumns({
        "continent_affiliation": F.when(european & (F.col("affiliation") == "EU"), "EU")
        .when(european, "European, non-EU").otherwise("other"),
        "implementation": F.when(F.col("iso3c") == vocab.WIDE_CODE, vocab.WIDE_CF).otherwise(vocab.NATIONAL_CF),
    }).select("scientific_name", "state", "presentation", "landings_code", "conversion_factor", "country",
              "iso3c", "iso2c", "continent_affiliation", "implementation", "note", "reference")
    return prefer_source(full, [*PRODUCT, "iso3c"], "reference", vocab.PREFERRED_SOURCES)


def member_table(spark: SparkSession, view: str = "members") -> DataFrame:
    """Member codes of one of the fixed views as a one-column table."""
    codes = F.array(*[F.lit(c) for c in vocab.MEMBER_VIEWS[view]])
    return spark.range(1).select(F.explode(codes).alias("iso3c"))


def wide_member(members: DataFrame) -> DataFrame:
    """The bloc's own code as a one-row member table."""
    key = members.columns[0]
    return members.sparkSession.range(1).select(F.lit(vocab.WIDE_CODE).alias(key))


def short_sources(factors: DataFrame) -> DataFrame:
    return factors.withColumn("reference", first_match("reference", vocab.SOURCE_RULES, F.col("reference")))


def factor_ranges(
    factors: DataFrame,
    landed_codes: DataFrame | None = None,
    keys: Sequence[str] = ("scientific_name", "state", "presentation", "landings_code"),
    varying_only: bool = True,
    na: str = "propagate",
) -> DataFrame:
    """Spread of the factors of each product that has several, some of members.

    ``landed_codes`` (one column) restricts to product codes that are landed.
    """
    if landed_codes is not None:
        factors = semi_keys(factors, landed_codes, {"landings_code": landed_codes.columns[0]})
    counts = {
        "n_EU": F.col("continent_affiliation") == "EU",
        "n_nonEuropean": F.col("continent_affiliation") == "other",
        "eu_wide_available": F.col("implementation") == vocab.WIDE_CF,
    }
    summary = range_summary(factors, keys, "conversion_factor", counts, na)
    several = summary.where("n_CF > 1 AND n_EU > 0")
    return several.where("range <> 0") if varying_only else several


def case_products(ranges: DataFrame, k: int | None = 20) -> DataFrame:
    """Products with exactly one bloc-wide factor, the widest ranges first."""
    one = ranges.where("eu_wide_available = 1")
    return one if k is None else top_k(one, "range", k, PRODUCT)


def relative_factors(factors: DataFrame, cases: DataFrame) -> DataFrame:
    """Factors of the case products against the smallest of the product."""
    kept = materialise(semi_keys(factors, cases, PRODUCT), "cases")
    return relative_to_minimum(kept, PRODUCT, "conversion_factor", null_safe=False)


def relative_by_presentation(factors: DataFrame, cases: DataFrame) -> DataFrame:
    """Spread of the case products' factors per presentation, whatever the taxon."""
    spread = range_summary(semi_keys(factors, cases, PRODUCT), ["landings_code"], "conversion_factor")
    return spread.select(
        "landings_code",
        F.col("min_CF").alias("min_in_group"),
        F.col("max_CF").alias("max_in_group"),
        F.col("range").alias("range_in_group"),
        F.try_divide("max_CF", "min_CF").alias("max_cf_relative"),
    )


def presentation_alignment(factors: DataFrame, landings: DataFrame,
                           names: tuple[str, str] = ("EU_Commission", "Eurostat_Landings")) -> DataFrame:
    """Presentations of the factor side against those of the landings side."""
    return align_vocab(
        factors.select(F.col("landings_code").alias("term")),
        landings.select(F.col("presentation").alias("term")), "term", names)


def factor_drift(official: DataFrame, code: str = "CN8", year: str = "year", factor: str = "CF",
                 least: float = 0.01) -> DataFrame:
    """Official trade factors of codes whose factor moved over the years.

    Only years with a single factor count, zeros and ones carry no information.
    """
    coded = official.withColumn(code, product_code(code))
    single = only_unambiguous(coded, [code, year]).where(~is_in(factor, [0, 1]) & F.col(factor).isNotNull())
    spread = attach_group_stats(single, [code], high=F.max(factor), low=F.min(factor))
    return spread.where(F.col("high") - F.col("low") > least)


def spread_examples(factors: DataFrame, keys: Sequence[str], factor: str, least_range: float = 0.3, least_count: int = 3,
                    exclude: Sequence[Mapping[str, str]] | None = None) -> DataFrame:
    """Factor rows of products with many and widely spread factors.

    ``exclude`` lists rows to leave out by the values of some columns, by
    default those known to be in error, as far as ``factors`` has the columns.
    """
    if exclude is None:
        exclude = [e for e in vocab.SPREAD_EXCLUSIONS if set(e) <= set(factors.columns)]
    for row in exclude:
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in row.items()])
        factors = factors.where(~same)
    spread = attach_group_stats(
        factors, keys,
        n=F.count("*"), upper=F.max(factor), lower=F.min(factor), range=F.max(factor) - F.min(factor))
    return spread.where((F.col("range") > least_range) & (F.col("n") > least_count))


def spread_labels(examples: DataFrame, non_members: Sequence[str] = tuple(vocab.SPREAD_NON_MEMBERS),
                  countries: Mapping[str, str] | None = None, common_names: Mapping[str, str] | None = None) -> DataFrame:
    """Display names of the examples and whether their country is a member.

    Columns used: ``country, scientific_name, common_name, type_of_processing``.
    Countries are renamed by lower-case spelling, common names as they are; the
    entries of ``countries`` and ``common_names`` take precedence over the fixed
    ones.  The bloc's own rows are left out, they are no country's factor, and so
    are the labels known to be said twice.
    """
    spelt = recode(name_key("country"), {**vocab.SPREAD_COUNTRIES, **(countries or {})}, "")
    shown = recode("common_name", {**vocab.SPREAD_COMMON_NAMES, **(common_names or {})}, "")
    dogfish = F.when(F.contains("common_name", F.lit(vocab.DOGFISH)), vocab.DOGFISH_NAME)
    examples = examples.withColumns({
        "country": F.when(spelt != "", spelt).otherwise(F.col("country")),
        "common_name": F.when(shown != "", shown).otherwise(F.coalesce(dogfish, "common_name")),
    })
    national = examples.where(F.col("country") != vocab.WIDE_CODE)
    processing = F.col("type_of_processing")
    named = national.withColumn("scientific_name", sentence_case("scientific_name"))
    labelled = named.withColumns({
        "Species_prep": paste("scientific_name", F.lit(" ("), processing, F.lit(")"), sep=""),
        "Common_name_prep": paste("common_name", F.lit(" ("), processing, F.lit(")"), sep=""),
        "State_membership": F.when(is_in("country", non_members), "non-EU").otherwise("EU"),
    })
    return labelled.where(not_in("Common_name_prep", vocab.SPREAD_EXCLUDED_LABELS))


def separation_rules(text: Column, kind: Column) -> list[tuple[Column, str | None]]:
    rules: list[tuple[Column, str | None]] = [(text.isin(vocab.WHOLE_DESCRIPTIONS), "whole")]
    rules += [(text.rlike(pattern), label) for pattern, label in vocab.SEPARATION_RULES]
    rules.append((F.contains(text, F.lit(vocab.FILLET)) & ~F.contains(text, F.lit(vocab.NOT_FILLET)), vocab.FILLET))
    rules.append((text == vocab.BONELESS, vocab.FILLET))
    rules.append((~F.contains(kind, F.lit(vocab.FISH_TYPE)), vocab.NON_FISH_SEPARATION))
    return rules


def classify_text(df: DataFrame, text: str = "type_of_processing", kind: str = "type") -> DataFrame:
    """Preparation and separation named in a processing description."""
    lowered = F.lower(text)
    spelt = (F.when(F.contains(lowered, F.lit(vocab.GUTTED_MISSPELT)), vocab.GUTTED)
             .when((lowered == vocab.SKINLESS_FILLETS) & (F.col(kind) == vocab.MOLLUSCS), vocab.UNKNOWN_PROCESSING)
             .otherwise(lowered))
    df = df.withColumn(text, spelt)
    preparation = [(F.col(text).rlike(p), label) for p, label in vocab.PREPARATION_RULES]
    return df.withColumns({
        "preparation": last_match(preparation),
        "separation": last_match(separation_rules(F.col(text), F.col(kind))),
    })


def classify_products(general: DataFrame, common_names: DataFrame, known_taxa: DataFrame,
                      *synonym_tiers: DataFrame) -> DataFrame:
    """General factors classified by processing, with resolved taxon names.

    Columns used: ``type, scientific_name, common_name, type_of_processing,
    conversion_factor``.  Synonyms are looked up only for two-word names that
    are not among ``known_taxa`` (one column), with names in lower case.
    """
    kept = general.where((F.col("conversion_factor") >= 1) & (F.col("type") != vocab.EXCLUDED_TYPE))
    named = classify_text(kept).withColumn(
        "scientific_name", recode(clean_taxon("scientific_name"), vocab.TAXON_FIXES))
    fixed = recode("common_name", vocab.COMMON_NAME_TAXA, "")
    named = named.withColumn("scientific_name", F.when(fixed != "", fixed).otherwise(F.col("scientific_name")))
    named = named.where(not_in("common_name", vocab.TOO_GENERAL))
    named = resolve_common_names(named, "common_name", "scientific_name", common_names)

    known = known_taxa.select(F.col(known_taxa.columns[0]).alias("__taxon"), F.lit(True).alias("__known")).distinct()
    marked = join_on(named, known, {"scientific_name": "__taxon"})
    lookup = marked.withColumn("__name", F.when(F.col("__known").isNull(), F.col("scientific_name")))
    lowered = [t.withColumns({"synonym": name_key("synonym"), "accepted": name_key("accepted")}) for t in synonym_tiers]
    resolved = resolve_synonyms(lookup, "__name", *lowered, binomial_only=True)
    return resolved.withColumn("scientific_name", F.coalesce("__name", "scientific_name")).drop("__name", "__known")


def taxa_of_codes(codes: DataFrame, code: str = "Code", taxa: str = "Taxa", separation: str = "Separation") -> DataFrame:
    """Code table with one row per taxon and the caviar code relabelled."""
    single = explode_list(codes, taxa).distinct()
    caviar = F.col(code).rlike(vocab.CAVIAR_CODE)
    return single.withColumn(separation, F.when(caviar, vocab.CAVIAR).otherwise(F.col(separation)))
