import random
import re

from helpers import rows
from pyspark.sql import functions as F

from tareline import vocab
from tareline.functions.flags import flag_letters, flagged_value, number_or_null
from tareline.functions.measure import display, exact_mean, ratio, rounded
from tareline.functions.nulls import if_known, is_in, max_of, mean_of, min_of, not_in, paste, sum_of
from tareline.functions.recode import first_match, last_match, recode
from tareline.functions.text import (
    clean_taxon,
    first_dot_removed,
    name_key,
    plain_spaces,
    product_code,
    sentence_case,
    without_commas,
)


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def apply(spark, values, expression, kind="string"):
    df = one_column(spark, values, kind).coalesce(1)
    return [r[0] for r in df.select(expression).collect()]


def test_missing_is_no_member(spark):
    values = ["a", "b", None]
    assert apply(spark, values, is_in("x", ["a"])) == [True, False, False]
    assert apply(spark, values, not_in("x", ["a"])) == [False, True, True]


def test_paste_writes_missing_as_text(spark):
    assert apply(spark, ["a", None], paste("x", F.lit("z"), sep=", ")) == ["a, z", "NA, z"]


def test_unknown_condition_gives_missing(spark):
    assert apply(spark, [1, 2, None], if_known(F.col("x") > 1, "y", "n"), "int") == ["n", "y", None]


def test_strict_and_skipping_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, x double")
    for na, expected in (("propagate", (None, None, None, None)), ("skip", (1.0, 1.0, 1.0, 1.0))):
        out = df.groupBy("k").agg(max_of("x", na), min_of("x", na), sum_of("x", na), mean_of("x", na))
        assert rows(out) == [("a", *expected), ("b", 4.0, 2.0, 6.0, 3.0)]


def test_recode(spark):
    assert apply(spark, ["FRE", "XXX", None], recode("x", vocab.STATES, "none")) == ["Fresh", "none", "none"]
    assert apply(spark, ["GB", "FR", None], recode("x", vocab.RELABELLED_ISO2)) == ["UK", "FR", None]
    assert len(vocab.PRESENTATIONS) == 30
    assert apply(spark, ["WNG+SKI"], recode("x", vocab.PRESENTATIONS, "none")) == ["wings only, skinned"]


def test_state_rules_tell_live_from_liver(spark):
    texts = ["live", "alive", "liver oil", "fresh and frozen", "salted", None]
    found = apply(spark, texts, first_match("x", vocab.STATE_RULES, "none"))
    assert found == ["Alive", "Alive", "none", "Fresh", "Salted", "none"]


def test_last_rule_wins_and_may_reset(spark):
    rules = [(F.col("x").rlike("live"), "live"), (F.col("x").rlike("liver"), None), (F.col("x").rlike("fresh"), "fresh")]
    assert apply(spark, ["live", "liver", "fresh liver", "x", None], last_match(rules)) == [
        "live", None, "fresh", None, None]


def test_flagged_cells(spark):
    cells = ["12.5 e", ": c", "3 ", "0 n", "7 bp", ":", "1d", "NaN", "", None, "1e3", "4 e p", "-2.", ".5 z",
             "1 e5", "2 x.5", "3 4"]
    assert apply(spark, cells, flagged_value("x")) == [
        12.5, None, 3.0, 0.0, 7.0, None, None, None, None, None, 1000.0, 4.0, -2.0, 0.5,
        15.0, 2.5, None]
    assert apply(spark, cells, flag_letters("x")) == [
        "e", "c", None, "n", "bp", None, None, None, None, None, None, "ep", None, "z",
        "e", "x", None]


def test_text_that_is_no_number_is_missing(spark):
    assert apply(spark, ["1", "1d", "x", " 2 "], number_or_null("x")) == [1.0, None, None, 2.0]


def test_text_helpers(spark):
    assert apply(spark, ["gadus MORHUA", "", None], sentence_case("x")) == ["Gadus morhua", "", None]
    assert apply(spark, ["a, b,c"], without_commas("x")) == ["a bc"]
    assert apply(spark, ["Brama spp. x.", "Brama"], first_dot_removed("x")) == ["Brama spp x.", "Brama"]
    assert apply(spark, ["a b"], plain_spaces("x")) == ["a b"]
    assert apply(spark, ["  Faeroe  Islands "], name_key("x")) == ["faeroe islands"]
    taxa = ["Gadus spp.", "Gadus spp", "Thunnus (all kinds)", " Gadus morhua ", "Gadus spp. x spp.", None]
    assert apply(spark, taxa, clean_taxon("x")) == ["gadus", "gadus", "thunnus", "gadus morhua", "gadus x spp.", None]


def test_product_codes(spark):
    assert apply(spark, ["0303 54 10", "30354", "123456789"], product_code("x")) == ["03035410", "00030354", "123456789"]


def test_measures(spark):
    assert apply(spark, [0.0, 2.0], ratio(F.lit(1), "x"), "double") == [None, 0.5]
    assert apply(spark, [0.125, 1.0, 2.345], display("x"), "double") == ["0.12", "1.00", "2.34"]
    assert apply(spark, [1.23425], rounded("x", 4), "double") == [1.2343]


def test_mean_does_not_depend_on_partitions(spark):
    values = [round(1 + i / 1000, 3) for i in range(997)]
    df = one_column(spark, values, "double")
    found = {df.repartition(n).agg(exact_mean("x")).first()[0] for n in (1, 3, 7, 16)}
    assert len(found) == 1


def test_mean_of_several_national_factors(spark):
    assert round(one_column(spark, [1.50, 1.55, 1.74], "double").agg(exact_mean("x")).first()[0], 6) == 1.596667


def test_flagged_cells_against_replace_and_check(spark):
    """Random cells, compared with removing flags, then checking the rest."""
    rng = random.Random(11)
    cells = ["".join(rng.choice("0123456789..  :eEabcz-+") for _ in range(rng.randrange(9))) for _ in range(5000)]
    number = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")

    def expected(cell):
        bare = re.sub(" [A-Za-z]+", "", cell).strip(" ")
        return float(bare) if ":" not in bare and number.fullmatch(bare) else None

    found = apply(spark, cells, flagged_value("x"))
    assert found == [expected(c) for c in cells]
    assert sum(v is not None for v in found) > 200


def test_cell_functions_work_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("12.5 e\n: c\n")
    cells = spark.readStream.schema("x string").text(str(tmp_path / "in"))
    parsed = cells.select(flagged_value("x").alias("value"), flag_letters("x").alias("flag"))
    query = (parsed.writeStream.format("memory").queryName("cells").trigger(availableNow=True)
             .option("checkpointLocation", str(tmp_path / "state")).start())
    assert query.awaitTermination(60)
    assert rows(spark.table("cells")) == [(12.5, "e"), (None, "c")]
