"""Files derived from the given tables, for the queries that read files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tareline.session import new_scratch_path


def calendar(line: DataFrame) -> list[int]:
    """Years of the table; the only thing read on the driver."""
    return sorted(r[0] for r in line.select(F.year("l_shipdate")).distinct().collect())


def wide_cells(df: DataFrame, keys: list[str], value: str, years: list[int]) -> DataFrame:
    """One text column per year: a number, a number with a flag, or ``:``."""

    def cell(year: int) -> Column:
        total = F.sum(F.when(F.col("year") == year, F.col(value)))
        text = total.cast("long").cast("string")
        return (F.when(total.isNull(), ": c").when(total >= 60, F.concat(text, F.lit(" e")))
                .when(total >= 30, F.concat(text, F.lit(" bp"))).otherwise(text)).alias(str(year))

    return df.groupBy(*keys).agg(*[cell(y) for y in years])


def write_wide(wide: DataFrame, keys: list[str], header: str, name: str) -> str:
    """Tab-separated text whose first header names the parts of its key."""
    path = new_scratch_path(wide.sparkSession, name)
    cells = [c for c in wide.columns if c not in keys]
    shape = wide.select(F.concat_ws(",", *keys), *cells).toDF(header, *cells)
    shape.write.options(sep="\t", header=True, quote="").csv(path)
    return path


def move_files(spark: SparkSession, source: str, folder: str, name: str) -> None:
    """Move the part files of ``source`` to ``folder`` under a name of their own, ``name`` and a number."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path(folder))
    parts = [s.getPath() for s in files.listStatus(path(source)) if s.getPath().getName().startswith("part-")]
    for i, part in enumerate(parts):
        files.rename(part, path(f"{folder}/{name}{i or ''}.tsv"))


def write_dictionary(dictionary: DataFrame, name: str) -> str:
    """Codes and labels as a dictionary file: two tab-separated columns without header or quotes."""
    path = new_scratch_path(dictionary.sparkSession, name)
    dictionary.select("code", "label").write.options(sep="\t", header=False, quote="").csv(path)
    return path


SQL_CELLS = """
    k AS (SELECT DISTINCT {keys} FROM {source}),
    y AS (SELECT DISTINCT year FROM {source}),
    s AS (SELECT {keys}, year, sum(value) AS total FROM {source} GROUP BY ALL),
    cells AS (SELECT {keys}, year, CAST(total AS DOUBLE) AS value,
                     CASE WHEN total IS NULL THEN 'c' WHEN total >= 60 THEN 'e' WHEN total >= 30 THEN 'bp' END AS flag
              FROM k CROSS JOIN y LEFT JOIN s USING ({keys}, year))"""
