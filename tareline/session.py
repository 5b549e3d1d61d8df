"""Session settings and the one place where intermediate tables are stored."""

from __future__ import annotations

import math
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

_local_scratch: str | None = None


def recommended_conf(shuffle_bytes: int | None = None) -> dict[str, str]:
    """Settings the jobs are tuned for.

    ``shuffle_bytes``, the size of the largest shuffle, sets the number of
    shuffle partitions to one per 256 MB; adaptive execution merges small ones.

    No operator calls ``broadcast()``.  A lookup side is broadcast only when
    Spark has measured it: by file size when the plan is made, by the size of
    the finished stage when adaptive execution re-plans.  Larger sides fall
    back to a sort-merge join whose hot partitions are split.
    """
    partitions = {}
    if shuffle_bytes is not None:
        partitions["spark.sql.shuffle.partitions"] = str(max(200, math.ceil(shuffle_bytes / (256 << 20))))
    return partitions | {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split hot join partitions even where that costs one more shuffle.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        "spark.sql.autoBroadcastJoinThreshold": "32m",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.session.timeZone": "UTC",
    }


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a local relation, whose size Spark knows when it plans."""
    kinds = StructType.fromDDL(schema)
    columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(kinds)]
    return spark.createDataFrame(pa.table(columns, names=kinds.names), kinds)


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for stored intermediates, as named by the cluster.

    A local session without ``spark.checkpoint.dir`` gets a temporary folder;
    a cluster session without it is an error, because executors do not share
    the driver's disk.
    """
    global _local_scratch
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="tareline-")
    return _local_scratch


def new_scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path in this application's folder, which is removed when it ends."""
    context = spark.sparkContext
    folder = f"{scratch_dir(spark)}/tareline/{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, fixes columns that are
    not repeatable (partition numbers), and gives Spark the true size of the
    table for later join choices.
    """
    spark = df.sparkSession
    path = new_scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
