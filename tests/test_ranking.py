import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hazegrid.operators.ranking import cumulative_counts, exact_quantiles, mid_ranks, shuffled_positions


def skewed(n=4000, seed=1):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=n) * 10, 2)
    v[: n // 3] = 1.25  # one value holds a third of the rows
    return v


@pytest.mark.parametrize("ranges", [None, 9])
def test_quantiles_match_numpy(spark, ranges):
    v = skewed()
    df = spark.createDataFrame([(float(x), None if i % 7 == 0 else float(x) ** 2) for i, x in enumerate(v)], "a double, b double")
    probs = [0.0, 0.02, 0.25, 0.5, 0.75, 0.95, 0.98, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs, ranges)
    assert got["a"] == pytest.approx(list(np.quantile(v, probs)))
    assert got["b"] == pytest.approx(list(np.quantile([x**2 for i, x in enumerate(v) if i % 7], probs)))


def test_quantiles_of_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0)] * 20, "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.0]}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-20, 20), min_size=3, max_size=120), st.floats(0, 1))
def test_quantile_property(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "a double")
    assert exact_quantiles(df, ["a"], [p], 3)["a"][0] == pytest.approx(float(np.quantile(values, p)), abs=1e-9)


@pytest.mark.parametrize("ranges", [None, 9])
def test_cumulative_counts(spark, ranges):
    v = skewed(900)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)] * 10, "a double")
    got = {r["a"]: r["n_le"] for r in cumulative_counts(df, "a", ranges=ranges).collect()}
    assert got == {x: int((v <= x).sum()) for x in set(v)}


@pytest.mark.parametrize("ranges", [None, 9])
def test_shuffled_positions_are_a_permutation(spark, ranges):
    df = spark.range(300).crossJoin(spark.createDataFrame([(1,), (2,)], "part int"))
    out = shuffled_positions(df, F.concat_ws(":", "part", "id"), "s", "pos", ["part"], ["id"], ranges)
    orders = {}
    for r in out.collect():
        orders.setdefault(r["part"], {})[r["id"]] = r["pos"]
    assert all(sorted(o.values()) == list(range(1, 301)) for o in orders.values())
    assert orders[1] != orders[2]


@pytest.mark.parametrize("ranges", [None, 6])
def test_mid_ranks_with_ties_and_groups(spark, ranges):
    rng = np.random.default_rng(4)
    rows = [(str(g), int(v)) for g, v in zip(rng.integers(0, 3, 400), rng.integers(0, 25, 400))] + [("0", None)]
    out = mid_ranks(spark.createDataFrame(rows, "g string, v int"), "v", ["g"], ranges=ranges).collect()
    assert len(out) == len(rows)
    for r in out:
        same = [v for g, v in rows if g == r["g"] and v is not None]
        want = None if r["v"] is None else sum(v < r["v"] for v in same) + (sum(v == r["v"] for v in same) + 1) / 2
        assert r["rank"] == want
