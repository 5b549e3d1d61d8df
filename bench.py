"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tareline import recommended_conf
from tareline.registry import QUERIES

HEADLINE = [
    "catch_min_max_series",
    "catch_min_max_by_product",
    "catch_national_vs_wide",
    "case_study_catch",
    "factor_ranges",
    "relative_factors",
    "compile_factors",
    "clean_landings",
    "coverage_grid",
    "availability_counts",
    "missing_factors",
    "cumulative_share",
    "share_by_pattern",
    "trade_live_weight",
    "classify_products",
    "unpivot_years",
    "densify_years",
    "parse_flagged",
]


def session(cpus: str) -> SparkSession:
    settings = recommended_conf() | {
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark: SparkSession, name: str, sf: str) -> float:
    """Seconds from building the query to its last row, results not kept."""
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    cold = {name: round(timed(spark, name, sf), 3) for name in names}
    warm = {name: round(timed(spark, name, sf), 3) for name in names}
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_warm_total",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
