"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Equal texts form a group that stays together unless it holds more than a fair
part of a shard.  Groups are pre-aggregated into a bounded number of cells by a
hash of their text; a group above a cell's even share is a cell of its own, and
one above a quarter of a shard is split into several, so no cell is hot.  The
driver sees only the cells' sums (a bounded number), and places the cells,
largest first, into the shard where the dot product of the cell with the shard's
residual capacity is highest.

Slots are gapless in a shard: a cell's first slot is the number of rows in the
cells before it, and rows are numbered inside their cell only.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tareline.session import materialise

SHARDS = 24
#: Cells a shard is made of, on average, and the part of a shard above which a group is split.
CELLS_PER_SHARD, WHOLE = 512, 4
SUMS = ("bytes", "tokens", "rows")


def measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One small row per document: size, checksum, words, and the key of its text's group."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.regexp_count(body, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.xxhash64(body).alias("group"),
    )


def sums() -> list[Column]:
    return [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]


def place(loads: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each cell (rows of ``loads``: shares of bytes, tokens, rows), largest cells first.

    Among shards that still have room for the cell in every dimension the
    highest dot product wins; where none has, those with room for its bytes
    (the first dimension) compete, and at last the one with most of it wins.
    Ties go to the lower shard.
    """
    room = np.full((shards, loads.shape[1]), 1.0 / shards)
    chosen = np.zeros(len(loads), int)
    for i in np.lexsort((np.arange(len(loads)), -loads.max(axis=1))):
        left = room - loads[i]
        for fits in ((left >= 0).all(axis=1), left[:, 0] >= 0):
            if fits.any():
                rank = np.where(fits, room @ loads[i], -np.inf)
                break
        else:
            rank = left[:, 0]
        chosen[i] = int(rank.argmax())
        room[chosen[i]] -= loads[i]
    return chosen


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS,
          cells_per_shard: int = CELLS_PER_SHARD) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row.

    A null text counts as an empty one; repeated rows are placed one by one,
    beside each other; an empty table gives no rows.
    """
    spark, n_cells = docs.sparkSession, shards * cells_per_shard
    rows = materialise(measured(docs, doc_id, text), "sharding")
    total = [x or 0 for x in rows.agg(*sums()).first()]
    if not total[2]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))

    # A group above a cell's share of any dimension: at most len(SUMS) * n_cells of them.
    large = F.greatest(*[F.col(s) * n_cells / max(1, t) for s, t in zip(SUMS, total)])
    parts = F.ceil(large * WHOLE / cells_per_shard).cast("int")
    groups = rows.groupBy("group").agg(*sums()).where((large > 1) & (F.col("rows") > 1)).select("group", parts.alias("parts"))
    # Bounded as above.
    parted = rows.join(F.broadcast(groups), "group", "left").select(
        "*",
        F.when(F.col("parts").isNull(), F.pmod("group", F.lit(n_cells))).otherwise(F.col("group")).alias("cell"),
        F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(-1)).cast("long").alias("part"),
    )
    cells = parted.groupBy("cell", "part").agg(*sums()).orderBy("cell", "part").collect()
    loads = np.array([[c[s] / max(1, t) for s, t in zip(SUMS, total)] for c in cells])
    before, placed = [0] * shards, []
    for c, s in zip(cells, place(loads, shards).tolist()):
        placed.append((c["cell"], c["part"], s, before[s]))
        before[s] += c["rows"]
    where = spark.createDataFrame(placed, "cell long, part long, shard int, first long")
    inside = Window.partitionBy("cell", "part").orderBy("doc_id", "text_crc32", "size")
    return parted.join(F.broadcast(where), ["cell", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.row_number().over(inside) - 1).alias("slot"),
    )


def balance(placed: DataFrame) -> DataFrame:
    """Rows and bytes of each shard."""
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def spread_of(values: list[int]) -> float:
    """Largest over smallest; 1 is even."""
    return max(values) / max(1, min(values)) if values else math.nan
