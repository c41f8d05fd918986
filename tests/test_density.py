import numpy as np
import pytest

from hazegrid.operators import density


def brute(points, eps, min_points):
    ids = [i for i, _, _ in points]
    x, y = np.array([p[1] for p in points]), np.array([p[2] for p in points])
    near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= eps * eps
    core = near.sum(1) >= min_points
    name = {}
    for k in sorted(np.flatnonzero(core), key=lambda k: ids[k]):
        if k in name:
            continue
        todo = [k]
        while todo:
            a = todo.pop()
            if a not in name:
                name[a] = ids[k]
                todo += [b for b in np.flatnonzero(near[a] & core) if b not in name]
    out = {}
    for k, i in enumerate(ids):
        owners = [b for b in np.flatnonzero(near[k] & core)]
        out[i] = (name[k] if core[k] else name[min(owners, key=lambda b: ids[b])] if owners else None, bool(core[k]))
    return out


def check(spark, points, eps, min_points):
    df = spark.createDataFrame([(int(i), float(x), float(y)) for i, x, y in points], "id long, x double, y double")
    got = {r["id"]: (r["cluster"], r["core"]) for r in density.density_clusters(df, eps, min_points).collect()}
    assert got == brute(points, eps, min_points)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_points_and_a_hot_square(spark, seed):
    rng = np.random.default_rng(seed)
    ids = rng.permutation(700)
    spread = rng.uniform(-3, 3, (350, 2))
    hot = rng.normal(0.5, 0.02, (350, 2))
    xy = np.concatenate([spread, hot])
    check(spark, list(zip(ids, xy[:, 0], xy[:, 1])), 0.25, 5)


def test_dense_squares_that_hardly_meet_or_hardly_miss(spark):
    rng = np.random.default_rng(7)
    left = np.column_stack([rng.uniform(-0.3, 0, 80), rng.uniform(0, 0.5, 80)])
    left[0] = (0.0, 0.25)
    for gap in (0.9999, 1.0, 1.0001):
        right = np.column_stack([rng.uniform(gap, gap + 0.2, 80), rng.uniform(0, 0.5, 80)])
        right[0] = (gap, 0.25)
        xy = np.concatenate([left, right])
        check(spark, [(k, x, y) for k, (x, y) in enumerate(xy)], 1.0, 4)


def test_repeated_places_borders_nulls_and_nothing(spark):
    points = [(k, 1.0, 1.0) for k in range(10, 30)] + [(1, 1.5, 1.0), (2, 2.1, 1.0), (3, 9.0, 9.0), (40, 1.9, 1.0)]
    check(spark, points, 0.55, 4)
    df = spark.createDataFrame([(1, None, 2.0), (2, float("nan"), 1.0), (3, 0.0, 0.0)], "id long, x double, y double")
    assert [tuple(r) for r in density.density_clusters(df, 1.0, 2).collect()] == [(3, None, False)]
    assert [tuple(r) for r in density.density_clusters(df, 1.0, 1).collect()] == [(3, 3, True)]
    assert density.density_clusters(df.limit(0), 1.0, 2).collect() == []
