"""Wide, flagged, tab-separated statistics files."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tareline.operators.reshape import CELLS, YEAR_COLUMN
from tareline.session import small_table

#: Both ``file:///x`` and ``file:/x`` are in use for a path without an authority.
NO_AUTHORITY = "^([^:/]+):///"
#: Files whose first lines are read at a time.
OPENED = 16
#: Bytes that are fetched of a file to find its first line; more only where that line is longer.
HEADER_BYTES = 8192


def list_wide_files(spark: SparkSession, folder: str, prefix: str, exclude: tuple[str, ...] = ("main",)) -> list[str]:
    """Paths of ``<prefix>_<part>.tsv`` files, without the excluded parts."""
    found = (spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}_*.tsv")
             .load(folder).select("path").collect())
    skipped = tuple(f"{prefix}_{part}.tsv" for part in exclude)
    return sorted(r.path for r in found if not r.path.endswith(skipped))


def first_line(spark: SparkSession, path: str) -> str | None:
    """First line of a text file, compressed ones too, by its first kilobytes; missing if it is empty."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    stream = file.getFileSystem(conf).open(file)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
        text = codec.createInputStream(stream) if codec else stream
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8"), HEADER_BYTES).readLine()
    finally:
        stream.close()


def wide_headers(spark: SparkSession, paths: list[str] | str) -> dict[str, str]:
    """Header line of every file that is not empty; folders count as the files in them."""
    files = spark.read.text(paths).inputFiles()
    with ThreadPoolExecutor(OPENED) as pool:
        lines = pool.map(lambda path: first_line(spark, path), files)
    return {path: line for path, line in zip(files, lines) if line is not None}


class Layout:
    """Where the columns of one header stand: key parts, other columns and years."""

    def __init__(self, header: str, years: str) -> None:
        key, *names = header.rstrip("\r").split("\t")
        named = list(enumerate(map(str.strip, names), 1))
        # A trailing axis label after a backslash (geo\time) is not a name.
        self.parts = {n.split("\\")[0].strip(): i for i, n in enumerate(key.split(","))}
        self.others = {n: i for i, n in named if not re.match(years, n)}
        self.years = [(n, i) for i, n in named if re.match(years, n)]
        self.size, self.header = len(names) + 1, header


def layout_table(spark: SparkSession, headers: dict[str, str], years: str) -> tuple[DataFrame, list[str]]:
    """One row per file with the places of its columns, and the names that any file has."""
    layouts = {path: Layout(header, years) for path, header in headers.items()}
    names = list(dict.fromkeys(n for one in layouts.values() for n in [*one.parts, *one.others]))
    rows = [(re.sub(NO_AUTHORITY, r"\1:/", path), one.header, one.size, [y for y, _ in one.years], [i for _, i in one.years],
             [one.parts.get(n) for n in names], [one.others.get(n) for n in names]) for path, one in layouts.items()]
    schema = ("__file string, __header string, __size int, __years array<string>, __at array<int>, "
              "__part array<int>, __other array<int>")
    return small_table(spark, rows, schema), names


def read_wide_flagged(spark: SparkSession, paths: list[str] | str, source_file: str | None = "source_file",
                      years: str = YEAR_COLUMN) -> DataFrame:
    """Wide files of any headers by one scan; ``unpack_years`` makes one row per year of the result.

    A small table of the headers (file, places of its columns) meets the lines
    by their file, so every cell is found under its own file's header, whatever
    the number of different headers and also where ``paths`` names a folder.
    The composite key is split into the columns named in its header; columns
    that a file does not have are missing.  The cells of year columns are packed
    into a map from year to text.

    A line whose number of cells differs from its header's ends the query with
    an error; blank lines are skipped and empty cells are missing.  Only the
    first lines of files are looked at on the driver.
    """
    layouts, names = layout_table(spark, wide_headers(spark, paths), years)
    lines = spark.read.text(paths).where(F.trim("value") != "").select(
        "value", F.regexp_replace("_metadata.file_path", NO_AUTHORITY, "$1:/").alias("__path"), F.col("_metadata.file_name").alias("__name"))
    met = lines.join(layouts, F.col("__path") == F.col("__file"), "left")
    known = F.when(F.col("__size").isNotNull(), F.col("__size")).otherwise(
        F.raise_error(F.concat(F.lit("no header was read of "), F.col("__path"))).cast("int"))
    cells = F.split(F.rtrim("value", F.lit("\r")), "\t", -1)
    whole = F.when(F.size(cells) == known, cells).otherwise(F.raise_error(F.concat(
        F.lit("expected "), known.cast("string"), F.lit(" cells: "), F.col("value"))))
    read = met.where(~F.col("value").eqNullSafe(F.col("__header"))).withColumn("__line", whole)
    read = read.withColumn("__key", F.split(F.get("__line", F.lit(0)), ","))

    def cell(at: Column) -> Column:
        return F.nullif(F.get("__line", at), F.lit(""))

    def column(i: int) -> Column:
        part, other = F.get("__part", F.lit(i)), F.get("__other", F.lit(i))
        return F.when(part.isNotNull(), F.trim(F.get("__key", part))).when(other.isNotNull(), cell(other))

    packed = F.map_from_arrays("__years", F.transform("__at", cell)).alias(CELLS)
    own = [F.col("__name").alias(source_file)] if source_file else []
    return read.select(*[column(i).alias(n) for i, n in enumerate(names)], *own, packed)
