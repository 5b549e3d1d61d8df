import random

import pytest
from helpers import plan_of, rows
from pyspark.sql import functions as F

from tareline.operators import ranking


@pytest.fixture
def many_chunks(spark):
    """Keep every range partition, so groups spread over several chunks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def hot_rows(n=3000):
    """One group holds a third of all rows."""
    rng = random.Random(7)
    return [("hot" if i % 3 == 0 else f"g{i % 40}" if i % 17 else None, i, float(rng.randrange(50))) for i in range(n)]


def test_running_total_and_index_with_a_hot_group(many_chunks):
    data = hot_rows()
    df = many_chunks.createDataFrame(data, "k string, id int, v double").repartition(8)
    order = ["-v", "id"]
    out = ranking.running_total(df, order, "v", ["k"])
    found = {r.id: (r.running_total, r.total) for r in out.collect()}
    index = {r.id: r.row_index for r in ranking.row_index(df, ["k"], order).collect()}
    for key in {k for k, _, _ in data}:
        group = sorted((r for r in data if r[0] == key), key=lambda r: (-r[2], r[1]))
        running, total = 0.0, sum(r[2] for r in group)
        for i, (_, ident, v) in enumerate(group, 1):
            running += v
            assert found[ident] == (running, total)
            assert index[ident] == i


def test_running_total_uses_several_chunks(many_chunks):
    df = many_chunks.range(10000).select("id", F.lit(1).alias("one"))
    out = ranking.running_total(df, ["id"], "one")
    assert out.where("running_total <> id + 1").count() == 0
    assert out.agg(F.max("total")).first()[0] == 10000
    ranged = df.repartitionByRange(F.col("id").asc()).select(F.spark_partition_id().alias("p")).distinct()
    assert ranged.count() == 8


def test_running_total_with_more_chunks_than_shuffle_partitions(many_chunks):
    df = many_chunks.range(5000).select("id", F.lit(1).alias("one"))
    out = ranking.running_total(df, ["id"], "one", chunks=37)
    assert out.where("running_total <> id + 1").count() == 0


def test_numbering_stores_no_payload(many_chunks, monkeypatch):
    """A thousand chunks; only keys, order and value are written, the rows meet their numbers afterwards."""
    stored, store = [], ranking.materialise
    monkeypatch.setattr(ranking, "materialise", lambda df, name="stage": stored.append(df.columns) or store(df, name))
    df = many_chunks.range(3000).select((F.col("id") % 3).alias("k"), "id", F.lit(1).alias("v"), F.repeat(F.lit("x"), F.lit(100)).alias("text"))
    out = ranking.running_total(df, ["-id"], "v", ["k"], chunks=1000)
    assert out.where("running_total <> floor((2999 - id) / 3) + 1 OR length(text) <> 100").count() == 0
    assert out.count() == 3000 and set(stored[0]) == {"k", "id", "v", "__chunk"}


def test_ties_of_numbered_rows_end_the_query(many_chunks):
    df = many_chunks.createDataFrame([("a", 1, "x"), ("a", 1, "y")], "k string, id int, text string")
    with pytest.raises(Exception, match="rows tie"):
        ranking.row_index(df, ["k"], ["id"]).collect()


def test_share_of_a_zero_total_is_missing(many_chunks):
    df = many_chunks.createDataFrame([("a", 0.0), ("b", 0.0)], "k string, v double")
    assert {r.proportion for r in ranking.cumulative_share(df, "k", "v").collect()} == {None}


def test_cumulative_share(many_chunks):
    df = many_chunks.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 5.0), ("c", 10.0), ("d", None)], "k string, v double")
    assert [tuple(r) for r in ranking.cumulative_share(df, "k", "v").orderBy("cumulative_sum", "k").collect()] == [
        ("c", 10.0, 10.0, 0.5), ("a", 5.0, 15.0, 0.75), ("b", 5.0, 20.0, 1.0), ("d", 0.0, 20.0, 1.0)]


def test_share_ends_at_one(many_chunks):
    df = many_chunks.range(500).select(F.col("id").alias("k"), (F.col("id") % 13 + 1).alias("v"))
    shares = ranking.cumulative_share(df, "k", "v")
    assert shares.agg(F.max("proportion")).first()[0] == 1.0
    assert shares.count() == 500


@pytest.mark.parametrize("size", [1, 2, 5, 500, 501])
def test_median(many_chunks, size):
    rng = random.Random(size)
    data = [("g", float(rng.randrange(20))) for _ in range(size)] + [("h", 1.0), ("h", 2.0), ("n", None)]
    df = many_chunks.createDataFrame(data, "k string, v double")
    ours = rows(ranking.group_median(df, ["k"], "v"))
    theirs = rows(df.where("v IS NOT NULL").groupBy("k").agg(F.median("v")))
    assert ours == theirs


def test_equal_medians_share_a_rank(many_chunks):
    df = many_chunks.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 3.0), ("c", 9.0)], "k string, v double")
    assert rows(ranking.rank_categories(df, "k", "v"), "k", "median", "rank") == [
        ("a", 2.0, 1), ("b", 2.0, 1), ("c", 9.0, 2)]


def test_largest_rows_keep_ties(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 1.0), (None, 4, 2.0), ("b", 5, None)],
                               "k string, id int, v double")
    assert rows(ranking.max_rows_per_group(df, ["k"], "v"), "id") == [(1,), (2,), (4,)]
    assert rows(ranking.rows_at_maximum(df, "v"), "id") == [(1,), (2,)]


def test_latest_year(spark):
    df = spark.createDataFrame([("a", 2001, 1.0), ("a", 2003, 2.0), ("b", 2000, 3.0)], "k string, year int, v double")
    assert rows(ranking.max_rows_per_group(df, ["k"], "year"), "v") == [(2.0,), (3.0,)]


def test_top_k_puts_missing_last_and_breaks_ties(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None), ("d", 2.0)], "k string, v double")
    assert [r.k for r in ranking.top_k(df, "v", 4, ["k"]).collect()] == ["d", "a", "b", "c"]
    assert "TakeOrderedAndProject" in plan_of(ranking.top_k(df, "v", 2, ["k"]))


def test_order_by_ranking(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "k string, v int")
    rank = spark.createDataFrame([("y", 1), ("x", 2)], "k string, rank int")
    assert [r.k for r in ranking.order_by_ranking(df, rank, ["k"]).collect()] == ["y", "x", "z"]


def test_lone_and_first_rows(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "p"), ("b", 3, "q"), (None, 4, "r")], "k string, n int, s string")
    assert rows(ranking.only_unambiguous(df, ["k"])) == [("b", 3, "q"), (None, 4, "r")]
    assert rows(ranking.first_per_key(df, ["k"], ["s"])) == [("a", 1, "p"), ("b", 3, "q"), (None, 4, "r")]


def test_groups_with_a_hit(spark):
    df = spark.createDataFrame([("a", True), ("a", None), ("b", False), ("b", None)], "k string, hit boolean")
    assert rows(ranking.groups_with(df, ["k"], F.col("hit"))) == [("a", True), ("a", None)]
