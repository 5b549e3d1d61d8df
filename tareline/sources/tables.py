"""Plain tables: CSV in, comma-free CSV and partitioned Parquet out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tareline.functions.nulls import quoted
from tareline.functions.text import without_commas


def read_csv_table(spark: SparkSession, path: str | list[str], schema: StructType | str,
                   multiline: bool = False) -> DataFrame:
    """CSV with header and a given schema.

    Quotes inside quoted fields are doubled.  ``multiline`` reads fields that
    contain line breaks; such a file cannot be split between tasks, so leave it
    off where it is not needed.
    """
    return (spark.read.schema(schema)
            .options(header=True, quote='"', escape='"', multiLine=multiline, mode="FAILFAST")
            .csv(path))


def read_code_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Two tab-separated columns without header or quoting: code, label.

    The text ``NA`` is a code like any other.
    """
    raw = (spark.read.schema("code string, label string")
           .options(sep="\t", quote="", header=False).csv(path))
    return raw.select(F.trim("code").alias("code"), F.regexp_replace("label", r"\s+$", "").alias("label"))


def without_separators(df: DataFrame) -> DataFrame:
    """Every column as text without commas, missing written as ``NA``."""
    return df.select(*[F.coalesce(without_commas(F.col(quoted(c)).cast("string")), F.lit("NA")).alias(c) for c in df.columns])


def write_safe_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Unquoted CSV: commas are removed from all text beforehand."""
    without_separators(df).write.mode(mode).options(header=True, quote="", escapeQuotes=False).csv(path)


def write_tidy(df: DataFrame, path: str, year: str = "year", sort_by: Sequence[str] = (),
               mode: str = "errorifexists") -> None:
    """Parquet partitioned by year, so year filters prune files.

    Rows of a year are spread over as many files as their size asks for; a
    rebalance (unlike a repartition by year) splits years that are large.
    ``sort_by`` orders the rows of a file, so that filters on those columns skip
    row groups by their minimum and maximum.
    """
    spread = df.hint("rebalance", year).sortWithinPartitions(year, *sort_by)
    spread.write.mode(mode).partitionBy(year).parquet(path)


def curation_worklist(df: DataFrame, text: str, curated: DataFrame) -> DataFrame:
    """Distinct descriptions the curated map does not know yet."""
    known = curated.select(F.col(text).alias("__known"))
    return df.select(text).distinct().join(known, F.col(text) == F.col("__known"), "left_anti")
