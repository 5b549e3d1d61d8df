"""Hard negatives against brute force: exact products, ties, odd rows, several tiles."""

import os
import sys
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import connect, differences  # noqa: E402
from tareline.llm import negatives, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, id string, score string"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 40), st.integers(0, 2**32), st.sampled_from([5, 2**20, 2**40]))
def test_strassen_is_exact(m, k, n, seed, most):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-most, most, (m, k)), rng.integers(-most, most, (n, k))
    want = a.astype(object) @ b.astype(object).T
    assert (negatives.strassen(*(t if i == 0 else t.T for i, t in enumerate(negatives.whole_tiles(a, b)))) == want).all()


def brute(rows, k=5, top=10):
    """Results of the definition, whole numbers only."""
    usable = [(i, [int(np.floor(256 * float(x))) for x in v], l) for i, v, l, *_ in rows
              if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, v, l) in enumerate(usable):
        if i % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, m == l) for n, (j, w, m) in enumerate(usable) if n != at]
        for p, j, _ in sorted(s for s in scored if s[2])[:k]:
            inside = [s for s in scored if not s[2] and Fraction(30 * -p, 100) <= -s[0] <= Fraction(90 * -p, 100)]
            out += [(i, j, r + 1, m, -p, -s) for r, (s, m, _) in enumerate(sorted(inside)[:top])]
    return sorted(out)


def mined(df):
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)
    return sorted(tuple(r) for r in got.collect())


def test_op13_equals_sql(spark):
    got = queries.QUERIES["op13_negatives"](spark, SF)
    assert differences(got, connect(SF), queries.SQL["op13_negatives"]) == []


@pytest.mark.parametrize("tiles", [(8192, 8192, 2048), (2, 7, 3)])
def test_negatives_equal_brute_force_with_ties_and_a_hot_label(spark, monkeypatch, tiles):
    for name, size in zip(("ANCHOR_TILE", "ROW_TILE", "STRIP"), tiles):
        monkeypatch.setattr(negatives, name, size)
    rng = np.random.default_rng(3)
    few = rng.integers(-3, 4, (12, 3)) / 4
    rows = [(i, few[rng.integers(12)].tolist(), 0 if i % 3 else int(rng.integers(4)), "x", None) for i in range(0, 1000, 5)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_negatives_of_odd_rows(spark):
    good = [(i * 10, [0.5, i / 40], i % 2, None, "x") for i in range(30)]
    odd = [(None, [1.0, 1.0], 0, "a", "b"), (100, None, 0, None, None), (200, [1.0, None], 1, None, None),
           (300, [float("nan"), 1.0], 1, None, None), (400, [float("inf"), 1.0], 0, None, None), (500, [1.0, 1.0], None, None, None),
           (600, [], 0, None, None), (700, [0.5], 1, None, None), (800, [0.5, 0.25, 0.125], 0, None, None),
           (900, [0.5, 0.5], 0, None, None), (900, [0.5, 0.5], 0, None, None)]
    assert mined(spark.createDataFrame(good + odd, SCHEMA)) == brute(good + odd)
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame(odd[1:3], SCHEMA)) == []


def test_components_beyond_64_bits_end_the_query(spark):
    rows = [(0, [3e38], 0, None, None), (1, [1.0], 0, None, None)]
    with pytest.raises(Exception, match="64 bits"):
        mined(spark.createDataFrame(rows, SCHEMA))


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**22, 2.0**22], 0, None, None), (1, [2.0**22, 2.0**20], 0, None, None), (2, [2.0**21, 1.0], 1, None, None)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows) != []
