import pytest
from compare import connect, differences
from helpers import plan_of

import __spark_entry__ as entry_point
from pyspark.sql.readwriter import DataFrameWriter
from tareline.registry import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def plan_faults(df):
    """Joins without keys, Python workers, and windows over whole groups."""
    plan = plan_of(df)
    banned = ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "Scan ExistingRDD"]
    faults = [b for b in banned if b in plan]
    windows = [line for line in plan.splitlines() if "Window [" in line]
    return faults + [line for line in windows if "__chunk" not in line and "__sum" not in line]


@pytest.fixture
def stages(monkeypatch):
    """Plan faults of every table that is stored while a query is built."""
    found, write = [], DataFrameWriter.parquet

    def checked(self, *args, **kwargs):
        found.extend(plan_faults(self._df))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", checked)
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, stages, name):
    df = entry_point.queries()[name](spark, SF)
    assert differences(df, con, entry_point.oracle_sql()[name]) == []
    assert plan_faults(df) == []
    assert stages == []


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["scientific_name", "year", "year_total_catch_min", "year_total_catch_max",
                          "year_landings_no_cf", "difference"]
    assert df.count() == 175


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
