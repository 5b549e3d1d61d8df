import pytest
from helpers import plan_of, rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tareline.operators import aggregate, checks, filters, joins, lookup, ranking, reshape, sets


def test_joins_on_missing_keys(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int")
    b = spark.createDataFrame([("x", 10), (None, 20)], "key string, b int")
    assert rows(joins.join_on(a, b, {"k": "key"})) == [("x", 1, 10), (None, 2, None)]
    assert rows(joins.join_on(a, b, {"k": "key"}, null_safe=True)) == [("x", 1, 10), (None, 2, 20)]
    assert rows(joins.semi_keys(a, b, {"k": "key"})) == [("x", 1)]
    assert rows(joins.missing_keys(a, b, {"k": "key"})) == [(None, 2)]


def test_semi_and_anti_make_the_whole(spark):
    a = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    b = spark.createDataFrame([(0,), (3,), (3,), (9,)], "k long")
    kept, rest = joins.semi_keys(a, b, ["k"]), joins.missing_keys(a, b, ["k"])
    assert rows(kept.unionByName(rest)) == rows(a)


def test_group_stats_cover_missing_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, 5)], "k string, x int")
    out = joins.attach_group_stats(df, ["k"], low=F.min("x"), n=F.count("*"))
    assert rows(out, "k", "x", "low", "n") == [("a", 1, 1, 2), ("a", 3, 1, 2), (None, 5, 5, 1)]


def test_duplicate_factors_multiply_rows(spark):
    facts = spark.createDataFrame([("cod", 2.0), ("eel", 1.0)], "taxon string, value double")
    factors = spark.createDataFrame([("cod", 1.5), ("cod", 1.7)], "taxon string, conversion_factor double")
    matched = joins.match_factor(facts, factors, ["taxon"])
    caught = joins.apply_factor(matched, "value", {"catch": "factor"})
    assert rows(caught, "taxon", "catch") == [("cod", 3.0), ("cod", 3.4), ("eel", None)]


def test_clean_filter(spark):
    df = spark.createDataFrame(
        [("cod", "Fresh, whole", 1.0, 2000), ("cod", "Fresh", 5.0, 2000), ("cod", None, 2.0, 2000),
         (" ", "Fresh, whole", 3.0, 2000), ("cod", "Fresh, whole", 0.0, 2000), ("cod", "Fresh, whole", None, 2000),
         ("cod", "Fresh, whole", 4.0, 1999)], "name string, form string, value double, year int")
    kept = filters.clean_filter(df, filled=["name"], nonzero=["value"], exclude={"form": ["Fresh"]}, years=(2000, None))
    assert rows(kept, "form", "value") == [("Fresh, whole", 1.0), (None, 2.0)]


def test_exception_rows_with_unknown_condition_go(spark):
    df = spark.createDataFrame([("Spain", "Ling"), ("Spain", None), ("Norway", "Ling")], "c string, n string")
    assert rows(filters.drop_exception(df, (F.col("c") == "Spain") & (F.col("n") == "Ling"))) == [("Norway", "Ling")]


def test_member_filter(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    table = spark.createDataFrame([("a",)], "m string")
    for members in (["a"], table):
        assert rows(filters.member_filter(df, "k", members)) == [("a",)]
        assert rows(filters.member_filter(df, "k", members, member=False)) == [("b",), (None,)]


def test_split_key_reads_names_from_the_header(spark):
    df = spark.createDataFrame([("COD,FRE,PT", "1"), ("COD", "2"), ("COD,FRE,PT,x", "3")], "key string, v string")
    out = reshape.split_key(df, "species,pres,geo\\time", "key")
    assert out.columns == ["species", "pres", "geo", "v"]
    assert rows(out) == [("COD", "FRE", "PT", "1"), ("COD", "FRE", "PT", "3"), ("COD", None, None, "2")]


def test_split_pair(spark):
    df = spark.createDataFrame([("Atlantic cod - Gadus morhua",), ("Fishes",), ("a - b - c",)], "s string")
    assert rows(reshape.split_pair(df, "s", ("common", "sci"))) == [
        ("Atlantic cod", "Gadus morhua"), ("Fishes", None), ("a", "b")]


def test_unpivot_years_keeps_missing_cells(spark):
    df = spark.createDataFrame([("PT", "12.5 e", ": c"), ("NA", "3", "7 bp")], "geo string, `2018` string, `1999` string")
    out = reshape.unpivot_years(df)
    assert dict(out.dtypes) == {"geo": "string", "year": "int", "value": "double", "flag": "string"}
    assert rows(out) == [("NA", 1999, 7.0, "bp"), ("NA", 2018, 3.0, None), ("PT", 1999, None, "c"), ("PT", 2018, 12.5, "e")]


def test_unpivot_measures_by_pattern(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "k string, q_min double, q_max double")
    assert rows(reshape.unpivot_measures(df, "^q_")) == [("a", "q_max", 2.0), ("a", "q_min", 1.0)]


def test_lift_category(spark):
    df = spark.createDataFrame([("cod", "EU", 1.2), ("cod", "ESP", 1.5), ("eel", "ESP", 1.1)], "t string, c string, f double")
    assert rows(reshape.lift_category(df, ["t"], F.col("c") == "EU", "f", "wide")) == [("cod", 1.2)]


def test_explode_list(spark):
    df = spark.createDataFrame([(1, "a, b"), (2, None)], "id int, taxa string")
    assert rows(reshape.explode_list(df, "taxa")) == [(1, "a"), (1, "b"), (2, None)]


@pytest.mark.parametrize("salts", [256, 1])
def test_complete_grid(spark, salts):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), (None, "x", 3)], "a string, b string, n int")
    grid = reshape.complete_grid(df, "a", "b", salts=salts)
    assert rows(grid) == [("a", "x", 1), ("a", "y", None), ("b", "x", None), ("b", "y", 2), (None, "x", 3), (None, "y", None)]
    filled = reshape.complete_grid(df, "a", "b", fill={"n": 0}, salts=salts)
    assert filled.where("n = 0").count() == 3
    only = reshape.complete_grid(df, "a", "b", only=spark.createDataFrame([("b",), ("z",)], "a string"))
    assert rows(only) == [("b", "x", None), ("b", "y", 2)]
    assert "CartesianProduct" not in plan_of(grid) and "NestedLoop" not in plan_of(grid)


def test_densify_years(spark):
    df = spark.createDataFrame([("a", 2000, 1.0), ("a", 2003, 2.0), ("a", 2003, 4.0), ("b", 2001, 5.0)],
                               "k string, year int, v double")
    assert rows(reshape.densify_years(df, ["k"], ["v"])) == [
        ("a", 2000, 1.0), ("a", 2001, 0.0), ("a", 2002, 0.0), ("a", 2003, 6.0), ("b", 2001, 5.0)]
    fixed = reshape.densify_years(df, ["k"], ["v"], span=(2001, 2002))
    assert rows(fixed) == [("a", 2001, 0.0), ("a", 2002, 0.0), ("b", 2001, 5.0), ("b", 2002, 0.0)]


def test_decode_keeps_unknown_codes_and_row_count(spark):
    df = spark.createDataFrame([("PT",), ("PT01",), ("NA",), ("XX",), (None,)], "geo string")
    names = spark.createDataFrame([("PT", "Portugal"), ("PT01", "Portugal"), ("NA", "Namibia")], "code string, label string")
    out = lookup.decode_codes(df, {"geo": names}, "_code")
    assert rows(out) == [("Namibia", "NA"), ("Portugal", "PT"), ("Portugal", "PT01"), ("XX", "XX"), (None, None)]


def test_repeated_dictionary_rows_count_once(spark):
    df = spark.createDataFrame([("PT",), ("ES",)], "geo string")
    names = spark.createDataFrame([("PT", "Portugal"), ("PT", "Portugal"), ("ES", "Spain"), ("ES", "Espana")], "code string, label string")
    assert rows(lookup.decode_codes(df, {"geo": names}, strict=False)) == [("ES",), ("Portugal",)]
    with pytest.raises(Exception, match="ambiguous lookup entry"):
        lookup.decode_codes(df, {"geo": names}).collect()


def test_repeated_country_spellings_count_once(spark):
    df = spark.createDataFrame([("Spain",), ("Portugal",)], "country string")
    table = spark.createDataFrame([("spain", "ESP", None), ("spain", "ESP", None), ("portugal", "PRT", "PT"), ("portugal", "POR", "PT")],
                                  "name_key string, iso3c string, iso2c string")
    into = {"iso3c": "iso3c", "iso2c": "iso2c"}
    assert rows(lookup.resolve_country(df, "country", table, into, strict=False)) == [("Portugal", None, None), ("Spain", "ESP", None)]
    with pytest.raises(Exception, match="ambiguous lookup entry"):
        lookup.resolve_country(df, "country", table, into).collect()


def test_dotted_column_names(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 4.0), ("b", 5.0, 6.0)], ["CN.8", "q.min", "q.max"])
    assert rows(reshape.unpivot_measures(df, "^q").where("value > 4")) == [("b", "q.max", 6.0), ("b", "q.min", 5.0)]
    assert rows(ranking.only_unambiguous(df, ["CN.8"])) == [("b", 5.0, 6.0)]
    assert rows(ranking.first_per_key(df, ["CN.8"], ["q.min"])) == [("a", 1.0, 2.0), ("b", 5.0, 6.0)]


def synonyms(spark, *entries):
    return spark.createDataFrame(list(entries), "synonym string, accepted string, status string")


def test_synonyms_in_order_of_tables(spark):
    df = spark.createDataFrame([("a a",), ("b b",), ("c",), ("d d",), (None,)], "name string")
    first = synonyms(spark, ("a a", "A1", "synonym"), ("b b", "B1", "misapplied"), ("c", "C1", "synonym"))
    second = synonyms(spark, ("a a", "A2", "synonym"), ("b b", "B2", "synonym"), ("b b", "B2", "synonym"))
    assert rows(lookup.resolve_synonyms(df, "name", first, second)) == [("A1",), ("B2",), ("C1",), ("d d",), (None,)]
    two_words = lookup.resolve_synonyms(df, "name", first, second, binomial_only=True)
    assert rows(two_words) == [("A1",), ("B2",), ("c",), ("d d",), (None,)]


def test_ambiguous_synonym_fails(spark):
    df = spark.createDataFrame([("a a",)], "name string")
    table = synonyms(spark, ("a a", "A1", "synonym"), ("a a", "A2", "synonym"))
    with pytest.raises(PySparkException, match="ambiguous lookup entry: a a"):
        lookup.resolve_synonyms(df, "name", table).collect()


def test_common_names_only_where_blank_and_unambiguous(spark):
    df = spark.createDataFrame([("Cod", ""), ("Cod", "kept"), ("Hake", None), ("Eel", ""), ("Ray", "")], "c string, n string")
    table = spark.createDataFrame([("Cod", "Gadus morhua"), ("Hake", "M. m"), ("Hake", "M. c"), ("Eel", "Anguilla")],
                                  "common_name string, scientific_name string")
    assert rows(lookup.resolve_common_names(df, "c", "n", table)) == [
        ("Cod", "gadus morhua"), ("Cod", "kept"), ("Eel", "anguilla"), ("Hake", None), ("Ray", "")]


def test_country_names(spark):
    df = spark.createDataFrame([("FAEROE islands",), ("Eu",), ("Atlantis",), (None,)], "country string")
    table = spark.createDataFrame(
        [("faeroe islands", "FRO", "FO", "Europe"), ("eu", "EU", "EU", "Europe")],
        "name_key string, iso3c string, iso2c string, continent string")
    assert rows(lookup.resolve_country(df, "country", table)) == [
        ("Atlantis", None, None, None), ("Eu", "EU", "EU", "Europe"), ("FAEROE islands", "FRO", "FO", "Europe"),
        (None, None, None, None)]


def test_membership_and_marks(spark):
    df = spark.createDataFrame([("ESP", "Spain"), ("NOR", "Norway"), (None, "?")], "iso string, name string")
    bloc = spark.createDataFrame([("ESP",)], "iso3c string")
    assert rows(lookup.membership_flag(df, "iso", bloc, "m"), "name", "m") == [
        ("?", "non-EU"), ("Norway", "non-EU"), ("Spain", "EU")]
    assert rows(lookup.mark_non_members(df, "name", "iso", bloc), "name") == [("?*",), ("Norway*",), ("Spain",)]


def test_vocabulary_alignment(spark):
    a = spark.createDataFrame([("Fresh, whole",), ("Alive, whole",), ("Alive, whole",)], "t string")
    b = spark.createDataFrame([("Claws",), ("Fresh, whole",)], "t string")
    out = lookup.align_vocab(a, b, "t", ("A", "B"))
    assert [tuple(r) for r in out.collect()] == [("Alive, whole", None), (None, "Claws"), ("Fresh, whole", "Fresh, whole")]


def test_range_summary_with_missing_factor(spark):
    df = spark.createDataFrame([("a", 1.2), ("a", 3.25), ("b", 1.0), ("b", None)], "k string, f double")
    out = aggregate.range_summary(df, ["k"], "f", na="propagate")
    assert rows(out, "k", "n_CF", "max_CF", "min_CF") == [("a", 2, 3.25, 1.2), ("b", 2, None, None)]
    assert rows(aggregate.range_summary(df, ["k"], "f"), "k", "range")[1] == ("b", 0.0)


def test_holders_of_extremes_keep_ties(spark):
    df = spark.createDataFrame(
        [("a", "ESP", 1.0), ("a", "DEU", 1.0), ("a", "FRA", 2.0), ("a", "FRA", 2.0), ("a", None, 2.0), ("b", "ESP", None)],
        "k string, iso3c string, f double")
    assert rows(aggregate.min_max_with_holders(df, ["k"], "f", "iso3c")) == [("a", 1.0, 2.0, "DEU, ESP", "FRA, NA")]
    strict = aggregate.min_max_with_holders(df, ["k"], "f", "iso3c", na="propagate")
    assert rows(strict) == [("a", 1.0, 2.0, "DEU, ESP", "FRA, NA"), ("b", None, None, None, None)]


def test_bucket_of_uncovered(spark):
    df = spark.createDataFrame([("x", None, 1.0), ("y", None, 2.0), ("z", 1.5, 4.0)], "form string, f double, v double")
    out = aggregate.bucket_uncovered(df, "f", "form", "no value", ["v"])
    assert rows(out) == [("no value", None, 3.0, "unaccounted"), ("z", 1.5, 4.0, "catch")]
    totals = aggregate.covered_totals(df, [], "f", "v")
    assert rows(totals) == [(4.0, 3.0)]


def test_group_by_all_but(spark):
    df = spark.createDataFrame([("a", "p", 1.0), ("a", "q", 2.0)], "k string, drop string, v double")
    assert rows(aggregate.group_by_all_but(df, ["v"], ["drop"])) == [("a", 3.0)]


def test_consolidation_policies(spark):
    df = spark.createDataFrame([("a", 1.50), ("a", 1.55), ("a", 1.74)], "k string, conversion_factor double")
    found = {p: aggregate.consolidate_factors(df, ["k"], policy=p).first()[1] for p in ("mean", "min", "max")}
    assert found["min"] == 1.50 and found["max"] == 1.74 and round(found["mean"], 6) == 1.596667
    assert aggregate.consolidate_factors(df, ["k"], digits=2).first()[1] == 1.6


def test_shares_by_pattern(spark):
    df = spark.createDataFrame([("Fresh, not specified", 1.0), ("Dried, whole", 2.0), (None, 1.0)], "p string, v double")
    assert rows(aggregate.share_by_pattern(df, "p", "v", ["Fresh, not", "Dried", "zzz"])) == [
        ("Dried", 0.5), ("Fresh, not", 0.25), ("zzz", 0.0)]


def test_shares_by_pattern_with_dots_and_zero_total(spark):
    df = spark.createDataFrame([("Fresh, cut", 1.0), ("Dried", 3.0)], "p string, v double")
    assert rows(aggregate.share_by_pattern(df, "p", "v", ["Fresh.*", "D.ied"])) == [("D.ied", 0.75), ("Fresh.*", 0.25)]
    none = spark.createDataFrame([("Fresh", 0.0)], "p string, v double")
    assert rows(aggregate.share_by_pattern(none, "p", "v", ["F.*"])) == [("F.*", None)]


def test_coverage_lists(spark):
    landed = spark.createDataFrame([("a", "FRA"), ("a", "ESP"), ("b", "FRA")], "k string, m string")
    held = spark.createDataFrame([("a", "ESP"), ("a", "DEU")], "k string, m string")
    listed = aggregate.coverage_ratio(landed, held, ["k"], "m", lists=("landing", "with_factor"))
    assert rows(listed, "k", "landing", "with_factor") == [("a", "ESP, FRA", "DEU, ESP"), ("b", "FRA", "")]


def test_coverage_ratio(spark):
    landed = spark.createDataFrame([("a", "ESP"), ("a", "ESP"), ("a", "FRA"), ("b", "FRA"), ("b", None)], "k string, m string")
    held = spark.createDataFrame([("a", "ESP"), ("a", "DEU"), ("c", "ESP")], "k string, m string")
    assert rows(aggregate.coverage_ratio(landed, held, ["k"], "m")) == [("a", 2, 2, 1, 0.5), ("b", 1, 0, 0, 0.0)]


def test_series_difference(spark):
    a = spark.createDataFrame([(2000, 5.0), (2001, 6.0)], "year int, v double")
    b = spark.createDataFrame([(2000, 3.0), (2002, 1.0)], "year int, v double")
    left = aggregate.series_difference(a, b, ["year"], "v", ("a", "b"))
    assert rows(left) == [(2000, 5.0, 3.0, 2.0), (2001, 6.0, None, None)]
    both = aggregate.series_difference(a, b, ["year"], "v", ("a", "b"), keep="all")
    assert rows(both)[2] == (2002, None, 1.0, None)


def test_distinct_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "k string, n int")
    assert rows(aggregate.distinct_counts(df, ["k", "n"])) == [(2, 2)]
    assert rows(aggregate.distinct_counts(df, ["k", "n"], approximate=True)) == [(2, 2)]


def test_unions(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([(2,)], "n int")
    assert rows(sets.union_sources(a, b, allow_missing=True)) == [(1, "x"), (2, None)]
    assert rows(sets.union_sources(a, a.select("s", "n"))) == [(1, "x"), (1, "x")]


def test_common_categories_drop_empty_groups(spark):
    a = spark.createDataFrame([("g", "x", 1), ("g", "y", 2), ("h", "x", 3)], "k string, c string, v int")
    b = spark.createDataFrame([("g", "x", 9), ("h", "z", 8)], "k string, c string, v int")
    left, right = sets.common_categories(a, b, ["k"], "c")
    assert rows(left) == [("g", "x", 1)] and rows(right) == [("g", "x", 9)]


def test_reconcile_counts_repetitions(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "n int, s string")
    b = spark.createDataFrame([(1, None), (3, "y")], "n int, s string")
    assert rows(sets.reconcile_sources(a, b)) == [(2, 1, 1)]
    assert rows(sets.reconcile_sources(a.where("n > 9"), b.where("n > 9"))) == [(0, 0, 0)]


def test_checks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 0.5)], "k string, v double")
    assert rows(checks.check_unique(df, ["k"])) == [("a", 2)]
    assert rows(checks.check_nonempty(df, ["k"], "v")) == [("b", 0.0), (None, 0.5)]
    assert rows(checks.check_null_keys(df, ["k", "v"])) == [(1, 1)]


def test_projection(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert lookup.project_rename(df, {"b": "x"}).columns == ["x"]
    assert lookup.project_rename(df, ["a"]).columns == ["a"]


def test_precedence_of_sources(spark):
    preferred = ["annex", "council"]
    df = spark.createDataFrame(
        [("A a", "ESP", 1.10, "FAO"), ("A a", "FRA", 1.10, "FAO"), ("A a", "FRA", 1.20, "annex"),
         ("B b", "NOR", 1.00, "FAO"), ("B b", "NOR", 1.30, None), ("C c", None, 1.0, None), ("D d", "ESP", 2.0, "annex"),
         ("D d", "ESP", 2.0, "annex")], "t string, c string, f double, r string")
    assert rows(ranking.prefer_source(df, ["t", "c"], "r", preferred)) == [
        ("A a", "ESP", 1.1, "FAO"), ("A a", "FRA", 1.2, "annex"), ("C c", None, 1.0, None), ("D d", "ESP", 2.0, "annex"),
        ("D d", "ESP", 2.0, "annex")]
