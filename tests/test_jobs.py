from datetime import date

import pytest
from helpers import plan_of, rows
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as entry_point
from tareline import vocab
from tareline.operators.aggregate import consolidate_factors
from tareline.operators.lookup import fixed_overrides, with_overrides
from tareline.plans import catch, coverage, factors as jobs, trade
from tareline.plans.landings import unit_prices, usable_catch, with_countries
from tareline.registry import job_queries

FACTORS = "scientific_name string, landings_code string, iso3c string, conversion_factor double"
LANDINGS = "scientific_name string, presentation string, iso3c string, port_iso3c string, year int, value double"


def factor_table(spark, data):
    df = spark.createDataFrame(data, FACTORS)
    wide = F.col("iso3c") == "EU"
    return df.withColumns({
        "implementation": F.when(wide, vocab.WIDE_CF).otherwise(vocab.NATIONAL_CF),
        "continent_affiliation": F.when(wide | F.col("iso3c").isin("ESP", "PRT", "DEU"), "EU").otherwise("other"),
    })


@pytest.fixture
def cod(spark):
    return factor_table(spark, [
        ("cod", "GUH", "EU", 1.7), ("cod", "GUH", "ESP", 1.5), ("cod", "GUH", "NOR", 1.5), ("cod", "GUH", "NOR", 1.7),
        ("cod", "FIL", "ESP", 2.6), ("cod", "WHL", "EU", 1.0), ("cod", "WHL", "ESP", 1.0),
        ("eel", "GUT", "NOR", 1.1), ("eel", "GUT", "ISL", 1.2)])


@pytest.fixture
def landed(spark):
    return spark.createDataFrame([
        ("cod", "GUH", "ESP", "PRT", 2000, 10.0), ("cod", "GUH", "ESP", "ESP", 2000, 4.0),
        ("cod", "GUH", "ESP", "ESP", 2002, 10.0), ("cod", "FIL", "ESP", "ESP", 2001, 6.0),
        ("cod", "WHL", "ESP", "ESP", 2003, 3.0), ("cod", "SMK", "ESP", "ESP", 2000, 2.0),
        ("cod", "GUH", "PRT", "ESP", 2000, 5.0), ("eel", "GUT", "PRT", "PRT", 2000, 1.0)], LANDINGS)


def test_factor_ranges(spark, cod):
    landed_codes = spark.createDataFrame([("GUH",), ("WHL",), ("GUT",)], "presentation string")
    found = rows(jobs.factor_ranges(cod, landed_codes, jobs.PRODUCT),
                 "scientific_name", "landings_code", "n_CF", "n_EU", "n_nonEuropean", "eu_wide_available", "max_CF", "min_CF")
    assert found == [("cod", "GUH", 4, 2, 2, 1, 1.7, 1.5)]
    archived = jobs.factor_ranges(cod, keys=jobs.PRODUCT, varying_only=False)
    assert rows(archived, "landings_code", "range") == [("GUH", pytest.approx(0.2)), ("WHL", 0.0)]


def test_a_missing_factor_makes_the_range_missing_and_last(spark):
    table = factor_table(spark, [("a", "x", "ESP", 1.0), ("a", "x", "EU", None), ("b", "x", "EU", 2.0), ("b", "x", "ESP", 1.0)])
    ranges = jobs.factor_ranges(table, keys=jobs.PRODUCT, varying_only=False)
    assert [r.scientific_name for r in jobs.case_products(ranges).collect()] == ["b", "a"]


def test_relative_factors(spark, cod):
    cases = jobs.case_products(jobs.factor_ranges(cod, keys=jobs.PRODUCT), k=None)
    out = jobs.relative_factors(cod, cases)
    assert rows(out, "iso3c", "min_in_group", "cf_relative") == [
        ("ESP", 1.5, 1.0), ("EU", 1.5, 1.7 / 1.5), ("NOR", 1.5, 1.0), ("NOR", 1.5, 1.7 / 1.5)]
    assert rows(jobs.relative_by_presentation(cod, cases), "landings_code", "max_cf_relative") == [("GUH", 1.7 / 1.5)]


def test_min_max_series(spark, cod, landed):
    bloc = spark.createDataFrame([("ESP",), ("PRT",)], "iso3c string")
    by_product = catch.min_max_by_product(landed, cod, bloc, first_year=2000)
    guh = by_product.where("presentation = 'GUH' AND year = 2000").first()
    assert (guh.year_landings, guh.min_iso3c, guh.max_iso3c) == (19.0, "ESP, NOR", "EU, NOR")
    series = {(r.scientific_name, r.year): r for r in catch.catch_min_max_series(by_product).collect()}
    first = series["cod", 2000]
    assert first.year_total_catch_min == pytest.approx(28.5) and first.year_total_catch_max == pytest.approx(32.3)
    assert first.year_landings_no_cf == 2.0 and first.difference == pytest.approx(3.8)
    assert series["cod", 2001].year_landings_no_cf is None


def test_national_against_wide_fills_years_of_pairs_with_common_presentations(spark, cod, landed):
    out = catch.catch_national_vs_wide(landed, cod)
    assert rows(out, "iso3c", "scientific_name", "year", "national_catch", "EU_catch") == [
        ("ESP", "cod", 2000, 21.0, pytest.approx(23.8)), ("ESP", "cod", 2001, 0.0, 0.0),
        ("ESP", "cod", 2002, 15.0, 17.0), ("ESP", "cod", 2003, 3.0, 3.0)]
    assert rows(catch.largest_gaps(out, ["scientific_name"]), "year") == [(2000,)]
    fixed = catch.catch_national_vs_wide(landed, cod, span=(2001, 2002))
    assert rows(fixed, "year", "national_catch") == [(2001, 0.0), (2002, 15.0)]


def test_national_lies_between_min_and_max(spark, cod, landed):
    own = landed.where("iso3c = 'ESP'")
    both = catch.catch_national_vs_wide(own, cod).where("national_catch > 0")
    covered = own.where("presentation IN ('GUH', 'WHL')")
    span = catch.catch_min_max_series(catch.min_max_by_product(covered, cod))
    joined = both.join(span, ["scientific_name", "year"])
    assert joined.count() == 3
    assert joined.where("national_catch < year_total_catch_min - 1e-9 OR national_catch > year_total_catch_max + 1e-9").count() == 0


def test_case_study_by_row_and_by_year(spark, cod, landed):
    cases = spark.createDataFrame([("cod", "GUH"), ("cod", "WHL")], "scientific_name string, landings_code string")
    found = catch.case_study_catch(landed, cod, cases, [2000, 2002, 2003])
    assert rows(found, "iso3c", "port_iso3c", "year", "value", "vessel_CF", "port_CF", "EU_CF") == [
        ("ESP", "ESP", 2002, 10.0, 1.5, 1.5, 1.7), ("ESP", "PRT", 2000, 10.0, 1.5, None, 1.7),
        ("PRT", "ESP", 2000, 5.0, None, 1.5, 1.7)]
    yearly = catch.case_study_catch(landed, cod, cases, [2000, 2002, 2003], grain="year")
    assert rows(yearly, "iso3c", "year", "value") == [("ESP", 2000, 14.0), ("PRT", 2000, 5.0)]
    bloc = spark.createDataFrame([("ESP",)], "iso3c string")
    long = catch.case_study_long(found, bloc)
    assert rows(long.where("vessel = 'PRT*'"), "calculation", "value", "index_to_plot_all_values") == [
        ("catch_by_EU_CF", 8.5, 1), ("catch_by_vessel_CF", None, 2), ("landings", 5.0, 3)]
    assert long.count() == 9


def test_value_uses_the_latest_price(spark):
    caught = spark.createDataFrame([("cod", "GUH", "ESP", 2.0), ("cod", "GUH", "PRT", 2.0)],
                                   "scientific_name string, presentation string, iso3c string, value double")
    prices = spark.createDataFrame([("cod", "GUH", "ESP", 2000, 5.0), ("cod", "GUH", "ESP", 2001, 7.0)],
                                   "scientific_name string, presentation string, iso3c string, year int, Euro_per_tonne double")
    assert rows(catch.value_catch(caught, prices), "iso3c", "Euros") == [("ESP", 14.0), ("PRT", None)]


def test_coverage_and_availability(spark, cod, landed):
    grid = coverage.coverage_grid(landed, cod)
    cells = {(r.scientific_name, r.presentation): r for r in grid.collect()}
    assert len(cells) == 2 * 5
    guh = cells["cod", "GUH"]
    assert (guh.n_countries_landing, guh.n_CF, guh.n_CF_with_landings, guh.proportion_have_CF) == (2, 3, 1, 0.5)
    assert cells["cod", "SMK"].proportion_have_CF == 0.0 and cells["eel", "GUH"].n_countries_landing is None
    status = coverage.availability_grid(landed, cod)
    found = {(r.scientific_name, r.presentation): (r.EU_CF, r.any_CF) for r in status.collect()}
    assert found["cod", "WHL"] == (vocab.WIDE_AVAILABLE, "yes")
    assert found["cod", "FIL"] == (vocab.NOT_AVAILABLE, "yes")
    assert found["cod", "SMK"] == (vocab.NOT_AVAILABLE, "no")
    assert found["eel", "WHL"] == (vocab.NOT_LANDED, vocab.NOT_LANDED)
    assert rows(coverage.availability_counts(status)) == [(5, 1, 4, 10)]
    assert rows(coverage.availability_totals(landed, cod)) == [(5, 1, 4, 10)]
    assert guh.countries_landing.count(",") == 1 and guh.countries_with_CF.count(",") == 2
    assert rows(coverage.missing_factors(landed, cod)) == [("cod", "SMK")]
    assert [r.scientific_name for r in coverage.top_taxa(landed, 1).collect()] == ["cod"]
    assert coverage.grid_of_top_taxa(status, landed, 1).count() == 5


def test_landings_next_to_catch(spark, landed):
    out = catch.landings_against_catch(landed.where("port_iso3c = 'ESP'"), landed, ["scientific_name"])
    assert rows(out.where("year = 2000")) == [("cod", 2000, 11.0, 21.0, -10.0), ("eel", 2000, None, 1.0, None)]


def test_traded_mackerel(spark):
    """One product from one exporter to the bloc, four factors."""
    flows = spark.createDataFrame(
        [(2018, "030354", "KOR", "AUS", 38.164179429919), (2018, "030354", "KOR", "FRA", 1.53), (2018, "030354", "KOR", "LTU", 27.0),
         (2018, "030354", "KOR", "PRT", 480.206199725765), (2018, "030354", "KOR", "ESP", 94.1670147683039)],
        "year int, product string, exporter string, importer string, q double")
    factors = spark.createDataFrame(
        [("030354", c, f) for c, f in [("DEU", 1.0), ("NOR", 1.15), ("POL", 1.39), ("BGR", 1.62), ("KOR", 1.2), ("EU", 1.11)]],
        "product string, country string, factor double")
    official = spark.createDataFrame([("030354", 1.0)] * 8, "product string, factor double")
    members = spark.createDataFrame([(m,) for m in vocab.MEMBERS], "iso3c string")
    out = {r.calculation: (r.value, r.group) for r in trade.trade_live_weight(flows, factors, official, members).collect()}
    assert out == {
        "product_q": (pytest.approx(602.9032144940688), "product form"),
        "q_by_exporter": (pytest.approx(723.4838573928826), "nominal weight"),
        "q_by_max": (pytest.approx(976.7032074803915), "nominal weight"),
        "q_by_min": (pytest.approx(602.9032144940688), "nominal weight"),
        "q_by_official": (pytest.approx(602.9032144940688), "nominal weight"),
    }


def test_prices_and_catch_are_picked_by_unit(spark):
    df = spark.createDataFrame([("cod", "Euro per tonne", "Total", 5.0), ("cod", "Tonnes live weight", "Total", 7.0),
                                (None, "Tonnes live weight", "Total", 8.0), ("cod", "Euro per tonne", "Other", 9.0)],
                               "scientific_name string, unit string, use string, value double")
    assert rows(unit_prices(df), "Euro_per_tonne") == [(5.0,)]
    assert rows(usable_catch(df), "value") == [(7.0,)]


def test_landings_by_coverage(spark, cod, landed):
    own = catch.landings_by_coverage(landed, cod).where("iso3c = 'ESP' AND year = 2000")
    assert rows(own, "presentation", "landings", "catch", "catch_vs_unaccounted") == [
        ("GUH", 14.0, 21.0, "catch"), (vocab.NO_NATIONAL_CF, 2.0, 0.0, "unaccounted")]
    wide = catch.landings_by_coverage(landed, cod, wide=True).where("iso3c = 'PRT'")
    assert rows(wide, "presentation", "landings", "catch") == [("GUH", 5.0, 8.5), (vocab.NO_WIDE_CF, 1.0, 0.0)]


def test_members_by_view(spark):
    assert jobs.member_table(spark, "with_gbr").count() == 28
    assert len(vocab.MEMBERS) == len(set(vocab.MEMBERS)) == 27
    assert set(vocab.MEMBER_VIEWS["with_nor"]) - set(vocab.MEMBERS) == {"NOR"}


def test_compile_factors(spark):
    official = "country string, scientific_name string, state string, presentation string, factor double, note string, reference string"
    council = "EU Council Website Third Country Info"
    national = spark.createDataFrame([
        ("Spain", "Gadus morhua", "FRE", "GUT", 1.17, None, "EU Council Regulations Annex"),
        ("France", "Gadus morhua", "FRE", "GUT", 1.17, "see list of CCF", "EU Council Regulations Annex"),
        ("EU", "Gadus morhua", "FRE", "GUT", 1.18, "", "EU Council Regulations Annex"),
        ("", "Gadus morhua", "FRE", "GUT", 9.0, None, "EU Council Regulations Annex")], official)
    third = spark.createDataFrame([
        ("Norway", "Gadus morhua", "FRE", "GUH", 1.5, "x", council), ("Norway", "Gadus morhua", "FRE", "GUH", 1.55, "y", council),
        ("Norway", "Gadus morhua", "DRI", None, 6.41, "z", council), ("Greenland", "Gadus callarias", "SAL", "WNG+SKI", 2.0, "w", council)],
        official)
    general = spark.createDataFrame([
        ("Fishes", "gadus MORHUA", "Cod", "Fresh/chilled, gutted", "SPAIN", 1.2, None, "FAO 2000"),
        ("Fishes", "Raja spp.", "Ray", "Frozen, gutted", "Faeroe islands", 1.4, None, "FAO 2000"),
        ("Fishes", "Raja spp.", "Ray", "Frozen, gutted", "Faeroe islands", 1.4, None, "FAO 2000"),
        ("Fishes", "Raja spp.", "Ray", "Liver oil", "Chile", 1.4, None, "FAO 2000"),
        ("Fishes", "Raja spp.", "Ray", "Live", "Chile", 1.4, None, "EUMOFA Appendix 7"),
        ("Fishes", "Raja spp.", "Ray", "Live", "Chile", 1.0, None, "FAO 2000"),
        ("Fishes", "Raja spp.", "Ray", "Live", "Chile", 1.1, None, "FAO 2001"),
        ("Fishes", "Molva molva", "Ling", "Frozen, fillets", "Spain", 2.8, None, "FAO 2000"),
        ("Fishes", "Molva molva", None, "Frozen, fillets", "Spain", 2.8, None, "FAO 2000"),
        ("Aquatic plants", "Ulva", "Ulva", "Live", "Chile", 1.0, None, "FAO 2000")],
        "Type string, Species string, `Common.name` string, `Type.of.Processing` string, Country string, "
        "`Conversion.factor` double, Note string, REF string")
    curated = spark.createDataFrame([
        ("fresh/chilled gutted", "GUT"), ("frozen gutted", "GUT"), ("frozen gutted", "GTA"), ("live", "WHL"), ("liver oil", "WHL"),
        ("frozen fillets", ""), ("salted", None)], "type_of_processing string, presentation string")
    synonyms = spark.createDataFrame([("Gadus callarias", "Gadus morhua", "synonym"), ("Raja spp.", "Nothing", "accepted name")],
                                     "synonym string, accepted string, status string")
    countries = spark.createDataFrame([
        ("spain", "Spain", "ESP", "ES", "Europe"), ("eu", "EU", "EU", "EU", "Europe"), ("norway", "Norway", "NOR", "NO", "Europe"),
        ("greenland", "Greenland", "GRL", "GL", "Europe"), ("faeroe islands", "Faroe Islands", "FRO", "FO", "Europe"),
        ("chile", "Chile", "CHL", "CL", "Americas")],
        "name_key string, country string, iso3c string, iso2c string, continent string")
    members = spark.createDataFrame([("ESP",)], "iso3c string")
    out = jobs.compile_factors(national, third, general, curated, synonyms, countries, members)
    found = rows(out, "scientific_name", "landings_code", "conversion_factor", "country", "iso3c", "continent_affiliation",
                 "implementation")
    assert found == [
        ("Gadus morhua", "Fresh, gutted", 1.17, "Spain", "ESP", "EU", vocab.NATIONAL_CF),
        ("Gadus morhua", "Fresh, gutted", 1.18, "EU", "EU", "EU", vocab.WIDE_CF),
        ("Gadus morhua", "Fresh, gutted and headed", 1.5, "Norway", "NOR", "European, non-EU", vocab.NATIONAL_CF),
        ("Gadus morhua", "Fresh, gutted and headed", 1.55, "Norway", "NOR", "European, non-EU", vocab.NATIONAL_CF),
        ("Gadus morhua", "Salted, wings only, skinned", 2.0, "Greenland", "GRL", "European, non-EU", vocab.NATIONAL_CF),
        ("Gadus morhua", "none, none", 6.41, "Norway", "NOR", "European, non-EU", vocab.NATIONAL_CF),
        ("Raja spp", "Frozen, gutted", 1.4, "Faroe Islands", "FRO", "European, non-EU", vocab.NATIONAL_CF),
        ("Raja spp", "Frozen, gutted, tail off", 1.4, "Faroe Islands", "FRO", "European, non-EU", vocab.NATIONAL_CF)]
    assert out.columns == ["scientific_name", "state", "presentation", "landings_code", "conversion_factor", "country",
                           "iso3c", "iso2c", "continent_affiliation", "implementation", "note", "reference"]


def test_source_names_are_shortened(spark):
    df = spark.createDataFrame([("EU Council Regulations Annex",), ("EU Council Website Third Country Info",), ("FAO 2000",), ("x",), (None,)],
                               "reference string")
    assert [r[0] for r in jobs.short_sources(df).collect()] == ["EU Council", "National Fisheries Authority", "FAO", "x", None]


def test_classification(spark):
    texts = {
        "Fresh/chilled": ("fresh", "whole"), "live": ("live", "whole"), "Liver oil": (None, "livers and roes"),
        "Frozen, guttted": (None, "whole"), "frozen, gutted, split": ("frozen", "other meat"), "Canned": ("preserved", "other meat"),
        "frozen, fillets, blocks": ("frozen", "other meat"), "salted, fillets": ("preserved", "fillet"), "boneless": (None, "fillet"),
        "boneless, frozen": ("frozen", "other meat"), "caviar": (None, "caviar"), "wings only": (None, "other body parts"),
        "fresh liver": ("fresh", "livers and roes"), "x": (None, None)}
    df = spark.createDataFrame([(t, "Fishes") for t in texts] + [("fillets, skinless", "Molluscs"), ("frozen", "Crustaceans")],
                               "type_of_processing string, type string")
    out = jobs.classify_text(df.coalesce(1)).collect()
    assert [(r.preparation, r.separation) for r in out[:-2]] == list(texts.values())
    assert (out[-2].type_of_processing, out[-2].separation) == ("unknown", vocab.NON_FISH_SEPARATION)
    assert (out[-1].preparation, out[-1].separation) == ("frozen", vocab.NON_FISH_SEPARATION)


def test_classified_products_get_resolved_names(spark):
    columns = "type string, scientific_name string, common_name string, type_of_processing string, conversion_factor double"
    general = spark.createDataFrame([
        ("Fishes", "Lophidae", "Monk", "frozen", 2.0), ("Fishes", "", "Cod", "frozen", 2.0), ("Fishes", "", "Fishes", "frozen", 2.0),
        ("Fishes", "", "Nile perch", "frozen", 2.0), ("Fishes", "Old name", "x", "frozen", 2.0), ("Fishes", "Known name", "x", "frozen", 2.0),
        ("Fishes", "Gadus spp.", "x", "frozen", 0.9), ("Fishes", "Gadus spp.", None, "frozen", 1.0), ("Aquatic plants", "Ulva", "x", "frozen", 1.0),
        ("Fishes", "Sea name", "x", "frozen", 1.0)], columns)
    common = spark.createDataFrame([("Nile perch", "Lates niloticus")], "common_name string, scientific_name string")
    known = spark.createDataFrame([("known name",)], "taxon string")
    schema = "synonym string, accepted string, status string"
    fish = spark.createDataFrame([("Old name", "New name", "synonym"), ("Known name", "Wrong", "synonym")], schema)
    sea = spark.createDataFrame([("Old name", "Never", "synonym"), ("Sea name", "Better sea", "synonym")], schema)
    out = jobs.classify_products(general, common, known, fish, sea)
    assert rows(out, "scientific_name") == [("better sea",), ("gadus",), ("gadus",), ("known name",), ("lates niloticus",), ("lophiidae",), ("new name",)]


def test_countries_of_vessel_and_port(spark):
    df = spark.createDataFrame([("United Kingdom", "Portugal"), ("European Union", "Nowhere")],
                               "nationality_of_vessel string, reporting_entity string")
    table = spark.createDataFrame([("united kingdom", "GBR", "GB"), ("portugal", "PRT", "PT")],
                                  "name_key string, iso3c string, iso2c string")
    assert rows(with_countries(df, table), "iso3c", "iso2c", "port_iso3c", "port_iso2c") == [
        ("GBR", "UK", "PRT", "PT"), (None, None, None, None)]


def test_drift_and_spread(spark):
    official = spark.createDataFrame([
        ("0303 54 10", 2015, 1.2), ("303 54 10", 2016, 1.3), ("03035411", 2015, 1.2), ("03035411", 2016, 1.205),
        ("03035412", 2015, 1.2), ("03035412", 2015, 1.4), ("03035412", 2016, 1.0), ("03035412", 2017, 1.9)], "CN8 string, year int, CF double")
    assert rows(jobs.factor_drift(official), "CN8", "year", "low", "high") == [
        ("03035410", 2015, 1.2, 1.3), ("03035410", 2016, 1.2, 1.3)]
    df = spark.createDataFrame([("a", f) for f in (1.0, 1.1, 1.2, 1.5)] + [("b", 1.0), ("b", 2.0)], "k string, f double")
    assert rows(jobs.spread_examples(df, ["k"], "f"), "k", "n", "upper", "lower") == [("a", 4, 1.5, 1.0)] * 4


def test_labels_of_spread_examples(spark):
    df = spark.createDataFrame([("Norway", "gadus MORHUA", "Cod", "frozen"), ("EU", "a", "b", "c"), ("Spain", "x", None, "y")],
                               "country string, scientific_name string, common_name string, type_of_processing string")
    assert rows(jobs.spread_labels(df), "Species_prep", "Common_name_prep", "State_membership") == [
        ("Gadus morhua (frozen)", "Cod (frozen)", "non-EU"), ("X (y)", "NA (y)", "EU")]


def test_codes_are_flattened_to_taxa(spark):
    codes = spark.createDataFrame([("160431", "a, b", "whole"), ("0303", "c", "whole"), ("0303", "c", "whole")],
                                  "Code string, Taxa string, Separation string")
    assert rows(jobs.taxa_of_codes(codes)) == [("0303", "c", "whole"), ("160431", "a", "caviar"), ("160431", "b", "caviar")]


# Provenance, tariff branches and shipped rows

def test_averaged_factors_keep_their_sources(spark):
    df = spark.createDataFrame([("a", 1.0, "FAO"), ("a", 2.0, "EU"), ("a", 3.0, "FAO"), ("b", 1.0, None)],
                               "k string, conversion_factor double, reference string")
    found = consolidate_factors(df, ["k"], sources=["reference"])
    assert rows(found, "k", "conversion_factor", "reference") == [("a", 2.0, "EU, FAO"), ("b", 1.0, None)]


def test_catch_per_presentation_names_both_sources(spark):
    landed = spark.createDataFrame(
        [("Cod", "Gadus", "Fresh, gutted", "PRT", 2001, 10.0), ("Cod", "Gadus", "Fresh, gutted", "PRT", 2001, 5.0),
         ("Cod", "Gadus", "Frozen, whole", "PRT", 2001, 2.0)],
        "common_name string, scientific_name string, presentation string, iso3c string, year int, value double")
    held = spark.createDataFrame(
        [("Gadus", "Fresh, gutted", "PRT", 1.0, "B"), ("Gadus", "Fresh, gutted", "PRT", 2.0, "A"),
         ("Gadus", "Fresh, gutted", "EU", 1.2, "C"), ("Gadus", "Frozen, whole", "EU", 1.1, "D")],
        "scientific_name string, landings_code string, iso3c string, conversion_factor double, reference string")
    out = catch.catch_per_presentation(landed, held, ["common_name"])
    assert rows(out, "common_name", "presentation", "landings", "national_CF", "national_ref", "EU_wide_CF", "EU_ref",
                "catch_by_national_CF") == [
        ("Cod", "Fresh, gutted", 15.0, 1.5, "A, B", 1.2, "C", 22.5), ("Cod", "Frozen, whole", 2.0, None, None, 1.1, "D", None)]


def test_codes_take_the_nearest_branch_of_the_tariff(spark):
    codes = spark.createDataFrame([("030354",), ("030389",), ("0304",), ("0399 10",), ("160",), (None,)], "product string")
    posted = spark.createDataFrame(
        [("0303 54 10", 2.0), ("0303 54 90", 4.0), ("0303", 1.0), ("0304 71", 3.0), ("160", 9.0), ("1604", 7.0), (None, 5.0)],
        "product string, factor double")
    found = trade.posted_by_prefix(codes, posted, "product", F.avg("factor"), "cf", 4)
    assert rows(found, "product", "cf") == [("030354", 3.0), ("030389", 7.0 / 3), ("0304", 3.0), ("160", 9.0)]


COUNTRIES = "name_key string, country string, iso3c string, iso2c string, continent string"


def test_shipped_country_rows_yield_to_the_users_own(spark):
    known = spark.createDataFrame(
        [("united kingdom", "United Kingdom", "GBR", "GB", "Europe"), ("greenland", "Greenland", "GRL", "GL", "Americas"),
         ("usa", "U.S.A.", "USA", "US", "Americas"), ("united states", "United States", "USA", "US", "Americas")], COUNTRIES)
    fixed = fixed_overrides(spark, vocab.COUNTRY_SPELLINGS, vocab.COUNTRY_OVERRIDES)
    assert rows(with_overrides(known, fixed)) == sorted([
        ("eu", "EU", "EU", "EU", "Europe"), ("greenland", "Greenland", "GRL", "GL", "Europe"), ("uk", "UK", "GBR", "GB", "Europe"),
        ("united kingdom", "United Kingdom", "GBR", "GB", "Europe"), ("united states", "United States", "USA", "US", "Americas"),
        ("usa", "U.S.A.", "USA", "US", "Americas")])
    own = fixed_overrides(spark, {}, {"greenland": {"continent": "Americas"}, "eu": {"iso3c": "EUE"}})
    found = {r.name_key: (r.iso3c, r.continent) for r in with_overrides(known, own, fixed).collect()}
    assert found["greenland"] == ("GRL", "Americas") and found["eu"] == ("EUE", None)


def test_spread_examples_leave_known_errors_out(spark):
    data = [("lepidorhombus", "frozen", 1.0 + i) for i in range(5)] + [("gadus", "frozen", 1.0 + i) for i in range(5)]
    data += [("clupea harengus", "fresh/chilled", 1.0 + i) for i in range(5)] + [("clupea harengus", "frozen", 1.0 + i) for i in range(5)]
    df = spark.createDataFrame(data, "scientific_name string, type_of_processing string, cf double")
    kept = jobs.spread_examples(df, ["scientific_name", "type_of_processing"], "cf")
    assert rows(kept.select("scientific_name", "type_of_processing").distinct()) == [("clupea harengus", "frozen"), ("gadus", "frozen")]
    assert jobs.spread_examples(df, ["scientific_name", "type_of_processing"], "cf", exclude=[]).count() == 20


def test_spread_labels_show_usual_names(spark):
    df = spark.createDataFrame([("Uk", "gadus", "Angler(=Monk)", "frozen"), ("Korea rep", "x", "Greenland halibut", "frozen"),
                                ("Spain", "y", "Spiny dogfish nei", "frozen"), ("eu", "z", "Ling", "frozen")],
                               "country string, scientific_name string, common_name string, type_of_processing string")
    assert rows(jobs.spread_labels(df), "country", "common_name", "State_membership") == [
        ("Spain", "Piked dogfish", "EU"), ("UK", "Monkfish", "non-EU")]


def test_the_query_of_spread_examples_leaves_no_taxon_out(spark, tmp_path):
    parts = [(i, brand, "PROMO", 5, 900.0 + 100 * i, f"red gear {i}") for i, brand in enumerate(["Brand#12", "Brand#13"] * 5)]
    schema = "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double, p_name string"
    spark.createDataFrame(parts, schema).write.parquet(str(tmp_path / "part.parquet"))
    found = entry_point.queries()["spread_examples"](spark, str(tmp_path))
    assert rows(found.groupBy("scientific_name").count()) == [("Brand#12", 5), ("Brand#13", 5)]
    assert "Brand#" not in entry_point.oracle_sql()["spread_examples"]


def test_totals_of_the_wide_files_are_summed_before_they_meet(spark, tmp_path, monkeypatch):
    tables = {
        "lineitem": spark.createDataFrame([(i, 0, date(1995 + i % 2, 1, 1), "N", "FO"[i % 2], 1.0, 2.0) for i in range(8)], (
            "l_partkey long, l_suppkey long, l_shipdate date, l_returnflag string, l_linestatus string, l_quantity double, "
            "l_extendedprice double")),
        "part": spark.createDataFrame([(i, f"Brand#{i}", "SMALL", i, "red gear") for i in range(8)],
                                      "p_partkey long, p_brand string, p_type string, p_size int, p_name string"),
        "supplier": spark.createDataFrame([(0, 3)], "s_suppkey long, s_nationkey long")}
    for name, df in tables.items():
        df.repartition(4).write.parquet(str(tmp_path / f"{name}.parquet"))
    plans, write = [], DataFrameWriter.csv

    def seen(self, path, *args, **kwargs):
        plans.append(plan_of(self._df))
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "csv", seen)
    paths = job_queries.wide_files(spark, str(tmp_path), ["scientific_name", "unit", "geo"], "species,unit,geo\\time", "fish_ca")
    assert len(plans) == 3 and not [p for p in plans if "Coalesce 1" in p]
    folder = paths[0].rsplit("/", 1)[0]
    assert not [p for p in paths if "main" in p]
    main = spark.read.text(folder + "/fish_ca_main*")
    assert main.select("_metadata.file_name").distinct().count() == 1
    assert sorted(r.value.split("\t")[0] for r in main.collect()) == ["all,F,all", "all,O,all", "species,unit,geo\\time"]
