"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

Features are lexicon densities (a fixed lexicon and one learned from labelled
documents), the share of lexicon words near a second person, rates of capitals
and punctuation, and rates of obfuscated spellings.  The learners see a bounded
sample of labelled rows; the lexicon is counted over one part of it, the trees
are fitted on the other, and calibration on margins that trees of the other
folds give to each row of that part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tareline.llm.batches import with_text_columns
from tareline.llm.boosting import BoostedTrees, Isotonic
from tareline.llm.labelled import SAMPLE_ROWS, collect_features, fold, learning_documents, learning_rows

HELD_OUT_MODULUS, HELD_OUT = 5, 0
THRESHOLD = 0.5
#: Folds of the rows that calibration is fitted on.
FOLDS = 5
#: Common insults, in English, German, French and Spanish.
LEXICON = frozenset(
    "idiot idiots moron morons stupid dumb loser losers clown scum trash garbage filth worthless pathetic disgusting"
    " imbecile fool jerk bastard bitch whore slut asshole shit fuck fucking retard vermin pig scumbag cretin"
    " dumm dummkopf idioten arschloch scheisse abschaum blöd widerlich wertlos"
    " idiote imbécile stupide connard salaud ordure débile minable"
    " idiota imbécil estúpido estúpida basura escoria asqueroso inútil patético".split()
)
#: Second persons in the same languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted tú ti vos".split()
)
#: Letters that digits and signs stand for.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
WORD = re.compile(r"[^\W\d_]+(?:[0-9@$*!._-]+[^\W\d_]+)+|[^\W_]+")
NOT_LETTERS = re.compile(r"[\W\d_]+")
REPEATS = re.compile(r"(.)\1{2,}")
NEAR = 5
#: The learned lexicon holds words and stems (first letters, with a star) of longer ones, since insults are inflected:
#: documents an entry must occur in, log ratio of its rates, number of entries at most.
STEM = 4
MIN_DOCS, MIN_LOG_RATIO, MAX_WORDS = 5, 2.5, 5000


def plain(word: str) -> str:
    """A word without signs inside, digits read as letters, and runs of a letter cut to one."""
    return REPEATS.sub(r"\1", NOT_LETTERS.sub("", word.translate(SIGNS)))


def features(text: str | None, learned: dict[str, float]) -> list[float]:
    text = text or ""
    words = WORD.findall(text.lower())
    n = max(1, len(words))
    fixed = masked = odd = total = 0
    weight = weights = 0.0
    hits = set()
    found = Counter(words)
    for w, k in found.items():
        clean = w
        if not w.isalpha():
            odd += k
            clean = plain(w)
        known = learned.get(clean, 0.0) or learned.get(clean[:STEM] + "*", 0.0) * (len(clean) > STEM)
        if known or clean in LEXICON:
            hits.add(w)
            total += k
            fixed += k * (clean in LEXICON)
            masked += k * (clean != w)
            weight = max(weight, known)
            weights += k * known
    people = SECOND_PERSON & found.keys()
    you = sum(found[w] for w in people)
    near = 0
    if hits and people:
        of_hits = np.array([i for i, w in enumerate(words) if w in hits])
        of_people = np.array([-n - NEAR - 1, *(i for i, w in enumerate(words) if w in people), 2 * n + NEAR + 1])
        at = np.searchsorted(of_people, of_hits)
        near = int(((of_people[at] - of_hits <= NEAR) | (of_hits - of_people[at - 1] <= NEAR)).sum())
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=128)
    size = max(1, int(counts.sum()))
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    marks = int(counts[33] + counts[63])
    signs = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    return [
        math.log1p(len(words)), 100 * fixed / n, math.log1p(fixed), 100 * total / n, math.log1p(total),
        weight, weights / n, near / max(1, total), 100 * you / n,
        float(counts[65:91].sum()) / letters, marks / size, (signs - marks) / size, odd / n, 100 * masked / n,
    ]


@dataclass
class ToxicityModel:
    learned: dict[str, float]
    trees: BoostedTrees
    steps: Isotonic

    def score(self, texts: list) -> np.ndarray:
        x = np.array([features(t, self.learned) for t in texts], dtype=float)
        return np.clip(self.steps(self.trees.margin(x)), 0.0, 1.0)


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words and stems that toxic documents hold far more often than others, with the log ratio of the rates."""
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1.0, 0), totals.get(0.0, 0)
    if not bad or not good:
        return {}
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})")))
    stems = F.transform(F.filter(words, lambda w: F.length(w) > STEM), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*")))
    words = sample.select("y", F.explode(F.array_union(words, stems)).alias("w"))
    ratio = F.log((F.col("a") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("a") + 0.5) / (good + 1))
    rows = (
        words.groupBy("w").agg(F.sum("y").alias("a"), F.count("*").alias("n")).where(F.col("a") >= MIN_DOCS)
        .select("w", ratio.alias("r")).where(F.col("r") >= MIN_LOG_RATIO)
        .orderBy(F.desc("r"), "w").limit(MAX_WORDS).collect()
    )
    return {r["w"]: r["r"] for r in rows}


def with_features(df: DataFrame, learned: dict[str, float]) -> DataFrame:
    def make() -> Callable[[list], list[pa.Array]]:
        return lambda texts: [pa.array([features(t, learned) for t in texts], pa.list_(pa.float64()))]

    return with_text_columns(df, "text", make, [T.StructField("features", T.ArrayType(T.DoubleType()))], ["doc_id", "y"])


def out_of_fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The margin of each row by trees fitted without its fold; folds hold like numbers of both labels."""
    folds = np.empty(len(y), int)
    by_label = np.argsort(y, kind="stable")
    folds[by_label] = np.arange(len(y)) % FOLDS
    margin = np.empty(len(y))
    for f in np.unique(folds):
        margin[folds == f] = BoostedTrees().fit(x[folds != f], y[folds != f]).margin(x[folds == f])
    return margin


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on labelled documents outside the held-out fold, ``rows`` of them at most.

    Without labels every score is 0; with one kind of label it is that label.
    """
    sample = learning_documents(docs, learning_rows(labels, "toxic", HELD_OUT_MODULUS, HELD_OUT, rows), "toxicity")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2))
    learned = learn_lexicon(sample.where(part == 0))
    # What the lexicon was counted over would show its words better than new rows do.
    _, x, y = collect_features(with_features(sample.where(part == 1), learned))
    if not len(y):
        x = np.zeros((0, len(features("", {}))))
    trees = BoostedTrees().fit(x, y)
    if len(np.unique(y)) < 2:
        # One kind of label, or none, to fit on: the share of toxic rows in both parts is all that is known.
        rate = sample.agg(F.avg("y")).first()[0] or 0.0
        return ToxicityModel(learned, trees, Isotonic().fit(np.zeros(1), np.array([rate])))
    return ToxicityModel(learned, trees, Isotonic().fit(out_of_fold(x, y), y))


def score(df: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None,
          column: str = "score") -> DataFrame:
    """Add the probability that a text is toxic; null texts score as empty ones."""
    def make() -> Callable[[list], list[pa.Array]]:
        return lambda texts: [pa.array(model.score(texts), pa.float64())]

    return with_text_columns(df, text, make, [T.StructField(column, T.DoubleType())], keep)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels), keep=["doc_id"])
    return scored.select(
        "doc_id", (fold("doc_id", HELD_OUT_MODULUS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with the columns they came with."""
    column = "__toxicity"
    return score(docs, train(docs, labels), column=column).where(F.col(column) < THRESHOLD).drop(column)
