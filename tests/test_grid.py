import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid import GridSpec
from hazegrid.operators import gridding as g


@pytest.mark.parametrize("res", [0.01, 0.1, 0.5, 3.0])
def test_counts_match_half_open_axis(res):
    grid = GridSpec(68.0, 6.5, 97.5, 37.5, res)
    assert grid.n_cols == len(np.arange(68.0 + res / 2, 97.5, res))
    assert grid.n_rows == len(np.arange(37.5 - res / 2, 6.5, -res))


def test_cells_and_empty(spark):
    grid = GridSpec(0.0, 0.0, 3.0, 2.0, 1.0)
    rows = grid.cells(spark).orderBy("row", "col").collect()
    assert [(r["row"], r["col"], r["lon"], r["lat"]) for r in rows][:4] == [(0, 0, 0.5, 1.5), (0, 1, 1.5, 1.5), (0, 2, 2.5, 1.5), (1, 0, 0.5, 0.5)]
    assert grid.empty(spark).where(F.col("value").isNotNull()).count() == 0


def test_cell_index_edges(spark):
    grid = GridSpec(0.0, 0.0, 1.0, 1.0, 0.1)
    pts = [(0.0, 0.95), (0.3, 0.5), (0.999, 0.0), (1.0, 0.5), (0.5, 1.0), (-0.1, 0.5)]
    row, col = grid.cell_index(F.col("x"), F.col("y"))
    got = spark.createDataFrame(pts, "x double, y double").select(row.alias("r"), col.alias("c")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (int((1.0 - 0.5) // 0.1), int(0.3 // 0.1)), (9, 9), (None, None), (None, None), (None, None)]


def test_nearest_index_clamps_and_breaks_ties_north_east(spark):
    grid = GridSpec(0.0, 0.0, 4.0, 4.0, 1.0)
    pts = [(1.0, 2.0), (-9.0, 99.0), (99.0, -9.0), (2.6, 2.4)]
    row, col = grid.nearest_index(F.col("x"), F.col("y"))
    got = [tuple(r) for r in spark.createDataFrame(pts, "x double, y double").select(row, col).collect()]
    assert got == [(1, 1), (0, 0), (3, 3), (1, 2)]


def field(spark, grid, fn, missing=()):
    rows = []
    for r in range(grid.n_rows):
        for c in range(grid.n_cols):
            lon, lat = grid.min_lon + (c + 0.5) * grid.resolution, grid.max_lat - (r + 0.5) * grid.resolution
            rows.append((r, c, None if (r, c) in missing else float(fn(lon, lat))))
    return spark.createDataFrame(rows, "row int, col int, v double")


def test_linear_regrid_reproduces_a_plane_and_respects_hull_and_gaps(spark):
    src, dst = GridSpec(0, 0, 10, 10, 1.0), GridSpec(0, 0, 10, 10, 0.7)
    plane = field(spark, src, lambda x, y: 3 * x - 2 * y, missing={(5, 5)})
    got = dst.with_coordinates(g.regrid_linear(plane, src, dst, ["v"])).collect()
    centres = [(0.35 + 0.7 * c, 10 - 0.35 - 0.7 * r) for r in range(dst.n_rows) for c in range(dst.n_cols)]
    assert len(got) == sum(0.5 - 1e-9 <= x <= 9.5 + 1e-9 and 0.5 - 1e-9 <= y <= 9.5 + 1e-9 for x, y in centres)
    holes = [r for r in got if r["v"] is None]
    assert holes and all(abs(r["lon"] - 5.5) < 1 and abs(r["lat"] - 4.5) < 1 for r in holes)
    for r in got:
        if r["v"] is not None:
            assert r["v"] == pytest.approx(3 * r["lon"] - 2 * r["lat"], abs=1e-9)


def test_linear_regrid_hits_last_source_centre(spark):
    src, dst = GridSpec(0, 0, 3, 3, 1.0), GridSpec(1.5, 1.5, 3.5, 3.5, 1.0)
    got = {(r["row"], r["col"]): r["v"] for r in g.regrid_linear(field(spark, src, lambda x, y: x * 10 + y), src, dst, ["v"]).collect()}
    assert got == {(1, 0): pytest.approx(22.0)}  # of the centres 2.0 and 3.0 only (2.0, 2.0) is inside 0.5..2.5
    dst = GridSpec(2.0, 2.0, 3.0, 3.0, 1.0)
    got = {(r["row"], r["col"]): r["v"] for r in g.regrid_linear(field(spark, src, lambda x, y: x * 10 + y), src, dst, ["v"]).collect()}
    assert got == {(0, 0): pytest.approx(27.5)}


def test_nearest_regrid_takes_south_west_on_ties(spark):
    src, dst = GridSpec(0, 0, 2, 2, 1.0), GridSpec(0.5, 0.5, 1.5, 1.5, 1.0)
    got = g.regrid_nearest(field(spark, src, lambda x, y: x * 10 + y), src, dst, ["v"]).collect()
    assert [r["v"] for r in got] == [pytest.approx(5.5)]


def test_moore_neighbourhood_and_smoothing(spark):
    grid = GridSpec(0, 0, 4, 4, 1.0)
    ones = field(spark, grid, lambda x, y: 1.0, missing={(1, 1)})
    near = {(r["row"], r["col"]): (r["neighbour_count"], r["neighbour_mean"]) for r in g.with_neighbours(ones, "v").collect()}
    assert near[(0, 0)] == (2, 1.0) and near[(3, 3)] == (3, 1.0) and near[(1, 1)] == (8, 1.0) and len(near) == 16
    smooth = {(r["row"], r["col"]): r["smoothed"] for r in g.smooth(ones, "v", 1).collect()}
    assert all(v == pytest.approx(1.0) for v in smooth.values())


def test_polygon_matches_even_odd_rule(spark):
    ring = [(1.2, 1.1), (8.7, 2.3), (7.1, 8.9), (5.0, 4.0), (2.2, 9.3)]
    grid = GridSpec(0, 0, 10, 10, 0.5)

    def inside(x, y):
        hit = False
        for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]]):
            if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
                hit = not hit
        return hit

    want = {(r["row"], r["col"]) for r in grid.cells(spark).collect() if inside(r["lon"], r["lat"])}
    got = {(r["row"], r["col"]) for r in g.polygon_cells(spark, grid, ring).collect()}
    assert got == want and len(want) > 50


def test_assemble_stack_broadcasts_statics_and_needs_dates(spark):
    layers = spark.createDataFrame(
        [("2021-10-01", "no2", 0, 0, 1.0), ("2021-10-02", "no2", 0, 0, 2.0), ("2021-10-02", "hcho", 0, 0, 3.0), (None, "no2", 0, 0, 9.0)],
        "date string, variable string, row int, col int, value double",
    ).withColumn("date", F.to_date("date"))
    static = spark.createDataFrame([("elevation", 0, 0, 7.0)], "variable string, row int, col int, value double")
    got = g.assemble_stack(layers, ["no2", "hcho"], static, ["elevation"]).orderBy("date").collect()
    assert [(str(r["date"]), r["no2"], r["hcho"], r["elevation"]) for r in got] == [("2021-10-01", 1.0, None, 7.0), ("2021-10-02", 2.0, 3.0, 7.0)]
    undated = g.assemble_stack(layers.where(F.col("date").isNull()), ["no2"]).collect()
    assert [str(r["date"]) for r in undated] == ["1970-01-01"]
    with pytest.raises(ValueError):
        g.assemble_stack(layers, [])


def test_infer_grid(spark):
    pts = spark.createDataFrame([(70.0 + 0.5 * i, 20.0 + 0.5 * j) for i in range(5) for j in range(3)], "lon double, lat double")
    r = g.infer_grid(pts).first()
    assert (r["resolution"], r["n_cols"], r["n_rows"]) == (0.5, 5, 3)
    single = g.infer_grid(pts.limit(1)).first()
    assert single["resolution"] == 0.5 and single["n_cols"] == 1


def test_patch_sequences_match_numpy(spark):
    rng = np.random.default_rng(3)
    nt, h, w, patch, steps = 4, 5, 6, 3, 3
    cube = rng.normal(size=(nt, 2, h, w))
    cube[2, 1, 2, 3] = np.nan
    grid = GridSpec(0, 0, w, h, 1.0)
    rows = [(t, r, c, float(cube[t, 0, r, c]), None if np.isnan(cube[t, 1, r, c]) else float(cube[t, 1, r, c])) for t in range(nt) for r in range(h) for c in range(w)]
    stack = spark.createDataFrame(rows, "t_idx int, row int, col int, a double, b double")
    samples = [(0, 0, 0, 0), (1, 3, 4, 5), (2, 2, 2, 3), (3, 1, 0, 5)]
    stats = {"a": (0.1, 2.0), "b": (-0.3, 0.5)}
    got = {r["sample_id"]: r for r in g.patch_sequences(spark.createDataFrame(samples, "sample_id int, t_idx int, row int, col int"), stack, ["a", "b"], stats, grid, patch, steps).collect()}
    for sid, t, r, c in samples:
        seq = cube[max(0, t - steps + 1) : t + 1]
        seq = np.concatenate([np.repeat(seq[:1], steps - len(seq), axis=0), seq])
        pad = np.pad(seq, ((0, 0), (0, 0), (1, 1), (1, 1)), mode="reflect")[:, :, r : r + patch, c : c + patch]
        want = (pad - np.array([0.1, -0.3])[None, :, None, None]) / np.array([2.0, 0.5])[None, :, None, None]
        assert got[sid]["shape"] == [steps, 2, patch, patch]
        assert np.allclose(np.array(got[sid]["patch"]).reshape(want.shape), np.nan_to_num(want), atol=1e-5)


@pytest.mark.parametrize(("w", "patch"), [(150, 15), (64, 5), (65, 7), (3, 7), (1, 3)])
def test_patches_over_strip_borders_and_mirrors(spark, w, patch):
    rng = np.random.default_rng(w)
    h, half = 4, patch // 2
    cube = rng.normal(size=(h, w))
    rows = [(0, r, c, float(cube[r, c])) for r in range(h) for c in range(w) if (r, c) != (1, 2)]
    cube[1, 2 if w > 2 else 0] = 0.0 if w > 2 else cube[1, 0]
    stack = spark.createDataFrame(rows, "t_idx int, row int, col int, a double")
    samples = [(k, 0, int(rng.integers(h)), c) for k, c in enumerate(sorted({0, w // 2, w - 1, min(w - 1, 63), min(w - 1, 64), min(w - 1, 60)}))]
    got = g.patch_sequences(spark.createDataFrame(samples, "sample_id int, t_idx int, row int, col int"), stack, ["a"], {"a": (0.0, 1.0)}, GridSpec(0, 0, w, h, 1.0), patch, 1)
    found = {r["sample_id"]: np.array(r["patch"]).reshape(patch, patch) for r in got.collect()}
    mirror = lambda i, n: 0 if n == 1 else (n - 1) - abs((i % (2 * (n - 1))) - (n - 1))
    for k, _, r, c in samples:
        want = [[cube[mirror(r - half + dy, h), mirror(c - half + dx, w)] for dx in range(patch)] for dy in range(patch)]
        assert np.allclose(found[k], want, atol=1e-6)


def test_haversine(spark):
    from hazegrid.functions.geo import haversine_km

    d = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert d == pytest.approx(math.pi * 6371.0088 / 180)


def test_patches_shuffle_grows_with_places_not_samples(spark):
    rows = [(0, r, c, float(10 * r + c)) for r in range(4) for c in range(6)]
    stack = spark.createDataFrame(rows, "t_idx int, row int, col int, a double")
    # 40 samples at two places of one strip, one at no place; rows outside the grid do not count
    samples = spark.range(40).select("id", F.lit(0).alias("t_idx"), F.lit(1).alias("row"), (F.col("id") % 2 * 3).cast("int").alias("col"))
    samples = samples.union(spark.sql("SELECT 40L, 0, 1, CAST(NULL AS INT)"))
    outside = spark.createDataFrame([(0, 9, 1, 5.0), (0, -1, 1, 5.0)], stack.schema)
    got = g.patch_sequences(samples, stack.union(outside), ["a"], {"a": (0.0, 1.0)}, GridSpec(0, 0, 6, 4, 1.0), 3, 1, "id")
    found = {r["id"]: r["patch"] for r in got.collect()}
    assert len(found) == 41 and found[40] == [0.0] * 9
    assert all(found[i] == [10.0 * y + abs(3 * (i % 2) + dx) for y in (0, 1, 2) for dx in (-1, 0, 1)] for i in range(40))
    # lines are collected per block, not per sample
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    gathers = [line for line in plan.splitlines() if "Aggregate [" in line and "collect_list" in line]
    assert gathers and not any("Aggregate [id#" in line for line in gathers)
