import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hazegrid.operators import trends


def pair_slopes(t, x):
    return [(x[j] - x[i]) / (t[j] - t[i]) for i, j in itertools.combinations(range(len(t)), 2)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=40), min_size=1, max_size=6))
def test_pairs_are_counted_by_merging(sequences):
    up, down = trends.rising_and_falling(np.array(sum(sequences, []), float), np.array([len(s) for s in sequences]))
    for s, u, d in zip(sequences, up, down, strict=True):
        pairs = list(itertools.combinations(s, 2))
        assert (u, d) == (sum(a < b for a, b in pairs), sum(a > b for a, b in pairs))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=2, max_size=60, unique=True).map(sorted), st.integers(0, 3), st.integers(0, 10**6))
def test_selected_slope_is_the_median_of_all(t, kind, seed):
    rng = np.random.default_rng(seed)
    t = np.array(t, float)
    x = [rng.normal(size=len(t)), rng.integers(0, 3, len(t)).astype(float), 0.1 * t, np.zeros(len(t))][kind]
    assert trends.median_slope(t, x, direct=2) == pytest.approx(np.median(pair_slopes(t, x)), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("kind", ["noise", "ties", "line", "constant", "step"])
def test_long_series(kind):
    rng = np.random.default_rng(3)
    t = np.sort(rng.choice(9000, 1500, replace=False)).astype(float)
    x = {"noise": rng.normal(size=1500) + t / 900, "ties": rng.integers(0, 4, 1500).astype(float), "line": 0.3 * t - 7, "constant": np.ones(1500), "step": (t > 4000) * 1.0}[kind]
    i, j = np.triu_indices(1500, 1)
    assert trends.median_slope(t, x) == pytest.approx(np.median((x[j] - x[i]) / (t[j] - t[i])), rel=1e-9, abs=1e-12)


def test_median_just_below_a_slope_that_many_pairs_share():
    # small whole values on whole days: a sixth of all pairs has slope 0, and the median may lie a few ranks off it
    rng = np.random.default_rng(11)
    for _ in range(6):
        t = np.sort(rng.choice(2500, 300, replace=False)).astype(float)
        x = rng.integers(0, 6, 300).astype(float)
        slopes = np.sort(pair_slopes(t, x))
        edge = int(np.searchsorted(slopes, 0.0))
        for k in range(edge - 3, edge + 3):
            assert trends._slope_of_rank(t, x, k, np.random.default_rng(k)) == pytest.approx(slopes[k - 1], rel=1e-9, abs=1e-12)


def test_inverted_pairs():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 12, 60).astype(float), rng.integers(0, 12, 60).astype(float)
    i, j = trends._inverted(a, b)
    assert set(zip(i.tolist(), j.tolist())) == {(p, q) for p in range(60) for q in range(60) if a[p] < a[q] and b[p] >= b[q]}


def test_operators_with_gaps_repeats_and_short_series(spark):
    rows = [("a", float(k), v) for k, v in enumerate([1.0, 2.0, 2.0, None, 5.0, 4.0, 7.0])] + [("a", 2.0, 4.0), ("b", 3.0, 1.5), ("c", 1.0, 2.0), ("c", 5.0, 2.0), ("d", None, 1.0), ("e", 1.0, None)]
    df = spark.createDataFrame(rows, "cell string, t double, v double")
    mk = {r["cell"]: r for r in trends.mann_kendall(df, ["cell"], F.col("t"), "v").collect()}
    # instant 2 holds the mean of 2 and 4
    x = [1.0, 2.0, 3.0, 5.0, 4.0, 7.0]
    assert set(mk) == {"a", "b", "c"} and (mk["a"]["n"], mk["a"]["s"]) == (6, 13)
    assert mk["a"]["variance"] == pytest.approx(6 * 5 * 17 / 18) and mk["a"]["z"] == pytest.approx(12 / (6 * 5 * 17 / 18) ** 0.5)
    assert mk["a"]["p"] == pytest.approx(0.0242, abs=2e-4) and mk["a"]["trend"] == 1
    assert (mk["b"]["n"], mk["b"]["s"], mk["b"]["z"], mk["b"]["trend"]) == (1, 0, 0.0, 0) and mk["b"]["p"] == pytest.approx(1.0, abs=1e-6)
    assert mk["c"]["variance"] == 0 and mk["c"]["trend"] == 0
    ts = {r["cell"]: r for r in trends.theil_sen(df, ["cell"], F.col("t"), "v").collect()}
    t = [0.0, 1.0, 2.0, 4.0, 5.0, 6.0]
    assert ts["a"]["slope"] == pytest.approx(np.median(pair_slopes(t, x))) and ts["b"]["slope"] is None and ts["b"]["intercept"] == 1.5
    assert ts["c"]["slope"] == 0.0
    assert trends.mann_kendall(df.limit(0), ["cell"], F.col("t"), "v").collect() == []


def test_no_object_is_made_for_each_point(spark):
    from hazegrid.operators import correlation

    df = spark.createDataFrame([("a", k, float(k % 5), 1.0) for k in range(40)], "cell string, t int, v double, w double")
    plans = [trends.mann_kendall(df, ["cell"], F.col("t"), "v"), trends.theil_sen(df, ["cell"], F.col("t"), "v"), correlation.lag_correlation(df, ["cell"], F.col("t"), "v", "w", 3, 8)]
    for out in plans:
        plan = out._jdf.queryExecution().executedPlan().toString()
        # the kind of function: 250 takes Arrow arrays, 200 a pandas series with a list of dictionaries for each series
        assert "ArrowEvalPython" in plan and "], 250" in plan and "], 200" not in plan
