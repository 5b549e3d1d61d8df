"""Labelled rows for the classifiers: folds, and a bounded sample to learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tareline.session import materialise

#: Classifiers learn from about this many labelled documents at most.
SAMPLE_ROWS = 20_000
UNITS = 1 << 20


def fold(doc_id: str, modulus: int) -> Column:
    """``crc32`` of the id as text, modulo ``modulus``; -1 where the id is missing."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(-1))


def learning_rows(labels: DataFrame, label: str, modulus: int, held_out: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, y`` of labelled documents outside the held-out fold, ``rows`` of them at most or nearly so.

    Missing labels are left out; a document labelled more than once has its
    majority label, and none at a draw.  The sample is taken by a hash of the id.
    """
    usable = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", modulus) != held_out))
        .groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
        .where("y != 0.5").select("doc_id", F.round("y").alias("y"))
    )
    share = min(UNITS, UNITS * rows // max(1, usable.count()))
    return usable.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(UNITS)) < share)


def learning_documents(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """``doc_id, text, y`` of the sampled documents, stored; equal texts count once."""
    # The sample is bounded by its row count, so it may be sent to every task.
    picked = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    stored = materialise(picked, name)
    once = stored.groupBy(F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id"))
    return stored.join(once.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])


def collect_features(features: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, feature matrix and labels of a bounded sample, in order of the ids."""
    rows = sorted(features.select("doc_id", "features", "y").collect())
    x = np.array([r[1] for r in rows], dtype=float) if rows else np.zeros((0, 0))
    return np.array([r[0] for r in rows]), x, np.array([r[2] for r in rows], dtype=float)
