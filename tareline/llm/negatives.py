"""Hard negatives of anchors: exact integer scores by Strassen, best rows kept in mergeable heaps.

Vectors become whole numbers (``floor(scale * x)``), so every score is exact
whatever the tiling.  Anchors and rows are dealt into groups of bounded size;
each anchor group meets each row group once, in a task of its own, where the
score matrix of the two tiles is computed by Strassen's recursion with zero
padding.  A task keeps two kinds of heaps: per anchor the best rows of its own
label, and per anchor and positive the best rows of other labels inside the
positive's score window.  Heaps of strips merge inside the task, heaps of tasks
by a partial top-k before and after the shuffle, so nothing unbounded travels.

Windows depend on the positives' scores, so tiles are multiplied twice: once for
the positives, once for the windows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tareline.llm.batches import reach_library
from tareline.session import materialise

#: Vectors of an anchor group and of a row group, about: what a task holds (at 64 components 4 MB each).
ANCHOR_TILE, ROW_TILE = 8192, 8192
#: Columns of the score matrix held at a time, and the side at which the recursion stops.
STRIP, LEAF = 2048, 8


# -- exact products


def whole_tiles(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both tiles as they are if every product fits in 63 bits, else as Python's whole numbers."""
    most = [max(int(t.max()), -int(t.min())) if t.size else 0 for t in (a, b)]
    if most[0] * most[1] * max(1, a.shape[1]) < 1 << 63:
        return a, b
    return a.astype(object), b.astype(object)


def padded(a: np.ndarray, height: int, width: int) -> np.ndarray:
    out = np.zeros((height, width), a.dtype)
    out[: a.shape[0], : a.shape[1]] = a
    return out


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` by seven products of halves; odd sides are padded with zeros.

    In 64 bits sums may wrap on the way, which leaves a result that fits exact.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    r, s, t = (-(-side // 2) for side in (m, k, n))
    a, b = padded(a, 2 * r, 2 * s), padded(b, 2 * s, 2 * t)
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    c = np.empty((2 * r, 2 * t), p1.dtype)
    c[:r, :t], c[:r, t:] = p1 + p4 - p5 + p7, p3 + p5
    c[r:, :t], c[r:, t:] = p2 + p4, p1 - p2 + p3 + p6
    return c[:m, :n]


class Tile:
    """Rows of one group ordered by id, their vectors padded with zeros to ``width``."""

    def __init__(self, table: pa.Table, width: int) -> None:
        table = table.sort_by([("id", "ascending"), ("uid", "ascending")])
        self.table = table
        self.id, self.uid, self.label = (table.column(c).to_numpy() for c in ("id", "uid", "label"))
        vectors = table.column("vector").combine_chunks()
        sizes = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        self.matrix = np.zeros((len(sizes), width), np.int64)
        self.matrix[np.arange(width) < sizes[:, None]] = flat


def widest(*tables: pa.Table) -> int:
    return max(max((len(v) for v in t.column("vector")), default=0) for t in tables)


# -- heaps


class Heap:
    """The ``k`` best entries: highest score first, then smallest id, then row number."""

    def __init__(self, k: int) -> None:
        self.k, self.entries = k, []

    def merge(self, entries: list[tuple]) -> None:
        self.entries = sorted([*self.entries, *entries])[: self.k]

    def add(self, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        """Take in candidates that stand in order of id and row number."""
        best = np.argsort(-scores, kind="stable")[: self.k]
        self.merge([(-int(scores[i]), int(ids[i]), int(uids[i])) for i in best])


def strips(anchors: Tile, rows: Tile):
    """The score matrix a strip of rows at a time, with the slice of rows it is for."""
    a, b = whole_tiles(anchors.matrix, rows.matrix)
    for start in range(0, len(b), STRIP):
        part = slice(start, start + STRIP)
        yield part, strassen(a, b[part].T)


def positive_heaps(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Per anchor the best other rows of its label in one row group."""
    def run(anchor_rows: pa.Table, row_rows: pa.Table) -> pa.Table:
        width = widest(anchor_rows, row_rows)
        anchors, rows = Tile(anchor_rows, width), Tile(row_rows, width)
        heaps = [Heap(k) for _ in anchors.uid]
        for part, scores in strips(anchors, rows):
            for i, heap in enumerate(heaps):
                own = np.flatnonzero((rows.label[part] == anchors.label[i]) & (rows.uid[part] != anchors.uid[i]))
                heap.add(scores[i, own], rows.id[part][own], rows.uid[part][own])
        found = [(int(u), -s, r, o) for u, heap in zip(anchors.uid, heaps) for s, r, o in heap.entries]
        return columns(found, ["uid", "score", "other", "other_uid"])

    return run


def window_heaps(k: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Per anchor and positive the best rows of other labels whose score lies in the positive's window."""
    def run(anchor_rows: pa.Table, row_rows: pa.Table) -> pa.Table:
        width = widest(anchor_rows, row_rows)
        anchors, rows = Tile(anchor_rows, width), Tile(row_rows, width)
        windows = [[(p["uid"], -(-low * p["score"] // 100), high * p["score"] // 100, Heap(k)) for p in of]
                   for of in anchors.table.column("positives").to_pylist()]
        for part, scores in strips(anchors, rows):
            for i, of in enumerate(windows):
                other = np.flatnonzero(rows.label[part] != anchors.label[i])
                mine = scores[i, other]
                order = other[np.argsort(-mine, kind="stable")]
                falling = -scores[i, order]
                for _, least, most, heap in of:
                    first, end = (np.searchsorted(falling, x, side) for x, side in ((-most, "left"), (-least, "right")))
                    best = order[first : min(end, first + k)]
                    heap.add(scores[i, best], rows.id[part][best], rows.uid[part][best])
        found = [(int(u), p, -s, r, o) for u, of in zip(anchors.uid, windows) for p, _, _, heap in of for s, r, o in heap.entries]
        return columns(found, ["uid", "positive_uid", "score", "other", "other_uid"])

    return run


def columns(found: list[tuple], names: list[str]) -> pa.Table:
    """Rows of whole numbers as a table; a score beyond 64 bits ends the query here."""
    return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(names)})


# -- the grid of tiles


def whole_vector(vector: str, scale: int) -> Column:
    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**63, F.floor(y)).otherwise(F.raise_error(F.lit("a component does not fit in 64 bits")))

    return F.transform(vector, whole)


def groups_of(df: DataFrame, size: int) -> int:
    return max(1, -(-df.count() // size))


def dealt(groups: int) -> Column:
    """The group of a row: a function of its stored number, even whatever its id or label."""
    return F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int")


def grid(anchors: DataFrame, rows: DataFrame, anchor_groups: int, row_groups: int, run: Callable, schema: str) -> DataFrame:
    """``run`` on every pair of an anchor group and a row group, each pair in one task."""
    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = anchors.withColumn("a", dealt(anchor_groups)).withColumn("r", every(row_groups))
    # Both sides come from one stored table: columns of the right get names of their own.
    right = rows.toDF(*rows.columns).withColumn("r", dealt(row_groups)).withColumn("a", every(anchor_groups))
    return left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(run, schema)


def best(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The heaps of all tasks merged: the ``k`` best of each key, cut on both sides of the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other", "other_uid")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame,
    anchor: Column,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` says which rows are anchors; it sees the columns of ``df``.  The
    positives of an anchor are the ``positives`` other rows of its label of the
    highest score.  Its negatives for a positive are the ``negatives`` rows of
    other labels of the highest score ``n`` with ``low * p <= 100 * n <= high * p``
    (``p``: the positive's score).  Ties go to the smaller id.

    Rows without an id, label or vector, or with a component that is null or not
    finite, take no part.  Rows that repeat an id are rows of their own, also as
    anchors.  Shorter vectors count as padded with zeros.  Other columns play no
    part.  An empty table, an anchor without positives and a positive without
    rows in its window give no rows.  A component or a score that does not fit
    in 64 bits ends the query with an error.
    """
    reach_library(df.sparkSession)
    c, v = (label if isinstance(label, Column) else F.col(f"`{label}`")), f"`{vector}`"
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.select(
        F.monotonically_increasing_id().alias("uid"), F.col(f"`{id}`").cast("long").alias("id"), c.cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.when(usable, F.col(v)).alias("vector"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    # Stored, a row keeps its number, and with it its group, in every later pass.
    rows = materialise(rows.withColumn("vector", whole_vector("vector", scale)), "vectors")
    anchors, every = rows.where("anchor").drop("anchor"), rows.drop("anchor")
    shape = groups_of(anchors, ANCHOR_TILE), groups_of(every, ROW_TILE)

    found = grid(anchors, every, *shape, positive_heaps(positives), "uid long, score long, other long, other_uid long")
    top = materialise(best(found, ["uid"], positives), "positives")
    listed = top.groupBy("uid").agg(F.collect_list(F.struct(F.col("other_uid").alias("uid"), "score")).alias("positives"))
    paired = anchors.join(listed, "uid")
    inside = grid(paired, every, *shape, window_heaps(negatives, low, high),
                  "uid long, positive_uid long, score long, other long, other_uid long")
    kept = best(inside, ["uid", "positive_uid"], negatives)
    named = kept.select("uid", F.col("positive_uid"), "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    of = top.select("uid", F.col("other_uid").alias("positive_uid"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(of, ["uid", "positive_uid"]).join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
