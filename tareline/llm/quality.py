"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text has a lookup table over its bins, and a few pairs of
features have a table over both; the tables are learned by cyclic boosting of
shallow trees (`boosting.AdditiveModel`) on a bounded sample of labelled rows.
A batch of texts is scored by adding table entries.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tareline.llm.batches import with_text_columns
from tareline.llm.boosting import AdditiveModel, sigmoid
from tareline.llm.labelled import SAMPLE_ROWS, collect_features, fold, learning_documents, learning_rows

HELD_OUT_MODULUS, HELD_OUT = 4, 2
THRESHOLD = 0.7


def features(text: str | None) -> list[float]:
    text = text or ""
    raw = text.encode()
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    upper, lower, digits = int(c[65:91].sum()), int(c[97:123].sum()), int(c[48:58].sum())
    stops = int(c[33] + c[44] + c[46] + c[58] + c[59] + c[63])
    signs = int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()) - stops
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    m = max(1, len(lines))
    low = text.lower().split()
    pairs = set(zip(low, low[1:], low[2:]))
    lengths = np.fromiter(map(len, words), int, len(words)) if words else np.zeros(1, int)
    return [
        math.log1p(len(words)),
        float(lengths.mean()),
        float((lengths <= 3).mean()),
        float((lengths >= 20).mean()),
        signs / size,
        stops / size,
        int(c[33] + c[63]) / n,
        int(c[124]) / n,
        upper / max(1, upper + lower),
        digits / size,
        int(c[128:].sum()) / size,
        len(set(low)) / n,
        len(pairs) / max(1, len(low) - 2),
        len(set(lines)) / m,
        math.log1p(n / m),
        sum(x.endswith((".", "!", "?", ":", ";")) for x in lines) / m,
    ]


@dataclass
class QualityModel:
    tables: AdditiveModel

    def score(self, texts: list) -> np.ndarray:
        return sigmoid(self.tables.margin(np.array([features(t) for t in texts], dtype=float)))


def with_features(df: DataFrame) -> DataFrame:
    def make() -> Callable[[list], list[pa.Array]]:
        return lambda texts: [pa.array([features(t) for t in texts], pa.list_(pa.float64()))]

    return with_text_columns(df, "text", make, [T.StructField("features", T.ArrayType(T.DoubleType()))], ["doc_id", "y"])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on labelled documents outside the held-out fold, ``rows`` of them at most.

    With one kind of label, or none, all scores are that base rate.
    """
    sample = learning_documents(docs, learning_rows(labels, "quality", HELD_OUT_MODULUS, HELD_OUT, rows), "quality")
    _, x, y = collect_features(with_features(sample))
    if not len(y):
        x = np.zeros((0, len(features(""))))
    return QualityModel(AdditiveModel().fit(x, y))


def score(df: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None,
          column: str = "score") -> DataFrame:
    """Add the probability that a text is of quality 1; null texts score as empty ones."""
    def make() -> Callable[[list], list[pa.Array]]:
        return lambda texts: [pa.array(model.score(texts), pa.float64())]

    return with_text_columns(df, text, make, [T.StructField(column, T.DoubleType())], keep)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels), keep=["doc_id"])
    return scored.select(
        "doc_id", (fold("doc_id", HELD_OUT_MODULUS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score at or above the threshold, with the columns they came with."""
    column = "__quality"
    return score(docs, train(docs, labels), column=column).where(F.col(column) >= THRESHOLD).drop(column)
