"""Arrow helpers shared by the operators that read texts inside tasks."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW, TEXT = "__row", "__text"
#: Rows of an Arrow batch at most: whole texts travel in it, and both sides of the pipe hold a few.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A task turns so many rows and about so many bytes of text at a time into Python objects.
PIECE_ROWS, PIECE_BYTES = 512, 4 << 20


def pieces(batch: pa.RecordBatch, column: str = TEXT) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that a piece holds a bounded amount of text (one text at least)."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and (size + n > PIECE_BYTES or i - start >= PIECE_ROWS):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


def reach_library(spark: SparkSession) -> None:
    """Let Python workers on this machine import the library as the driver does, from wherever it was started.

    On a cluster the library is shipped or installed as usual; a folder that a
    worker does not have is passed over.
    """
    paths, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = paths.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


@cache
def trimmer() -> Callable[[int], int] | None:
    """The C library's call that gives freed memory back to the machine, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return what a task freed: Python workers outlive tasks, and idle ones keep it from the next stage."""
    pa.default_memory_pool().release_unused()
    if trimmer():
        trimmer()(0)


def with_text_columns(
    df: DataFrame,
    text: str,
    make: Callable[[], Callable[[list], list[pa.Array]]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
    as_bytes: bool = False,
) -> DataFrame:
    """Add columns computed from each row's whole text; no shuffle, one output row per input row.

    ``make`` is called once per task and returns a function from the texts of
    a piece (str, or bytes with ``as_bytes``; None where null) to the arrays of
    ``fields``.  ``keep`` names the columns that pass through (all by default).
    They travel as one struct, so their names never clash with the working columns;
    one called like a field is replaced by it.  When a task ends, unused memory goes
    back to the machine (`give_back`).
    """
    spark = df.sparkSession
    reach_library(spark)
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    made_names = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in made_names]
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(None).cast("int").alias(ROW)]).alias(ROW),
        F.col(f"`{text}`").cast("binary" if as_bytes else "string").alias(TEXT),
    )
    schema = T.StructType([packed.schema[ROW], *fields])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        try:
            for batch in batches:
                for piece in pieces(batch):
                    made = compute(piece.column(TEXT).to_pylist())
                    yield pa.RecordBatch.from_arrays([piece.column(ROW), *made], names=names)
        finally:
            give_back()

    return packed.mapInArrow(run, schema).select(*[F.col(f"{ROW}.`{c}`") for c in kept], *[f.name for f in fields])
