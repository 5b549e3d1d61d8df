"""The chosen-path join against brute force, SQL, hot passages and odd rows."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import connect, differences  # noqa: E402
from tareline.llm import chosen_path, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n long, kept string"


def brute(rows, words=4):
    """Component by every pair of texts; ids are distinct."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if root(i) != root(j) and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in chosen_path.near_duplicates(df).collect()}


@pytest.mark.parametrize("name", ["op4_jaccard", "op12_near_dedup"])
def test_near_duplicates_equal_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) == []


def hot_documents():
    """Near copies of one text at every distance, a passage that a third of the rows share, exact copies, and others."""
    rng = np.random.default_rng(5)
    word = [f"w{i}" for i in range(4000)]
    base, passage = rng.choice(word, 120).tolist(), rng.choice(word, 40).tolist()
    texts = []
    for edits in rng.integers(0, 9, 300):
        copy = list(base)
        for at in rng.integers(0, len(base), edits):
            copy[at] = word[rng.integers(len(word))]
        texts.append(" ".join(copy))
    texts += [" ".join([*passage, *rng.choice(word, rng.integers(4, 30))]) for _ in range(300)]
    texts += [" ".join(rng.choice(word, 60)) for _ in range(200)]
    texts += [texts[700]] * 40
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [32, 4])
def test_hot_groups_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(chosen_path, "SMALL", small)
    rows = hot_documents()
    df = spark.createDataFrame([(i, t, None, "x") for i, t in rows], SCHEMA)
    assert found(df) == brute(rows)


def test_odd_rows(spark):
    long = "word " * 60_000
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE\ftwo"), (6, long), (7, long + "more"), (8, "a b c d"),
            (9, "a b c d a b c d"), (10, "É é"), (11, "é É")]
    df = spark.createDataFrame([(i, t, 0, None) for i, t in rows], SCHEMA)
    assert found(df) == brute(rows)
    assert found(spark.createDataFrame([], SCHEMA)) == {}


def test_repeated_and_missing_ids(spark):
    rows = [(5, "one two three four five"), (5, "one two three four five"), (5, "quite another text than that"), (None, "nobody else"),
            (None, "one two three four five"), (9, "one two three four five"), (8, "nobody else")]
    df = spark.createDataFrame([(i, t, 0, None) for i, t in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, str(r.kept)) for r in chosen_path.near_duplicates(df).collect())
    assert got == [("5", 2, 5, "True"), ("5", 2, 5, "True"), ("5", 2, 5, "True"), ("8", 1, 8, "True"), ("9", 2, 5, "False"),
                   ("None", 1, 8, "None"), ("None", 2, 5, "None")]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**62, 9000))
    b = np.unique(np.concatenate([a[:8000], rng.integers(0, 2**62, 1000)]))
    same = np.mean(chosen_path.signature(a) == chosen_path.signature(b))
    assert abs(same - 0.8) < 0.17
