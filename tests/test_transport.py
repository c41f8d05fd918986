import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid import GridSpec
from hazegrid.constants import EARTH_RADIUS_KM as R
from hazegrid.functions.geo import haversine_km
from hazegrid.operators import transport as tr

GRID = GridSpec(70.0, 20.0, 80.0, 30.0, 1.0)


def winds(spark, u, v, frames=3, missing=()):
    rows = [(t, r, c, float(u), float(v)) for t in range(frames) for r in range(10) for c in range(10) if (r, c) not in missing]
    return spark.createDataFrame(rows, "t_idx int, row int, col int, u_wind double, v_wind double")


def parcels(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "parcel_id int, lon double, lat double, time bigint")


def run(spark, field, starts, hours=6, dt=1.0, **kw):
    out = tr.back_trajectories(parcels(spark, *starts), field, GRID, 0, 3600, 3, hours=hours, dt_hours=dt, **kw)
    return {k: sorted([(r["step"], r["time"], r["lon"], r["lat"]) for r in out.where(F.col("parcel_id") == k).collect()]) for k in range(len(starts))}


def test_constant_wind_matches_spherical_steps(spark):
    path = run(spark, winds(spark, 5.0, -3.0), [(75.0, 25.0, 7200)])[0]
    lon, lat = 75.0, 25.0
    want = [(0, 7200, lon, lat)]
    for k in range(1, 7):
        dlat = -(-3.0 * 3600) / (R * 1000) * (180 / math.pi)
        dlon = -(5.0 * 3600) / (R * 1000 * math.cos(math.radians(lat))) * (180 / math.pi)
        lon, lat = lon + dlon, lat + dlat
        want.append((k, 7200 - 3600 * k, lon, lat))
    assert len(path) == 7
    for a, b in zip(path, want):
        assert a == pytest.approx(b)


def test_parcel_stops_at_the_rim_and_keeps_the_clamped_node(spark):
    path = run(spark, winds(spark, 30.0, 0.0), [(71.2, 25.0, 0)], hours=12, dt=3.0)[0]
    assert path[-1][2] == 70.5 and len(path) < 5 and all(p[2] > 70.5 for p in path[:-1])


def test_missing_wind_stops_and_parcels_are_independent(spark):
    paths = run(spark, winds(spark, 0.0, 0.0, missing={(5, 5)}), [(75.5, 24.5, 0), (72.5, 24.5, 0)])
    assert len(paths[0]) == 1 and len(paths[1]) == 7


def test_nearest_frame_prefers_the_earlier(spark):
    t = spark.createDataFrame([(0,), (1800,), (1801,), (5400,), (99999,), (-5,)], "t bigint")
    assert [r[0] for r in t.select(tr._frame_index(F.col("t"), 0, 3600, 3)).collect()] == [0, 0, 1, 1, 2, 0]


def test_direction_and_rose(spark):
    df = spark.createDataFrame([(0.0, -5.0), (5.0, 0.0), (0.0, 5.0), (-5.0, 0.0), (None, 1.0)], "u_wind double, v_wind double")
    got = [r["wind_from"] for r in tr.add_wind(df).collect()]
    assert got[:4] == pytest.approx([0.0, 270.0, 180.0, 90.0]) and got[4] is None
    rose = tr.wind_rose(df).collect()
    assert sum(r["percent"] for r in rose) == pytest.approx(100.0) and {r["sector"] for r in rose} == {0, 4, 8, 12}


@pytest.mark.parametrize("lat0", [0.0, 60.0, 85.0])
def test_fires_at_known_distances_count_once(spark, lat0):
    deg = math.degrees(1 / R)
    east = deg / math.cos(math.radians(lat0))
    fires = [(0.0, lat0 + 49 * deg), (0.0, lat0 + 51 * deg), (0.0, lat0 - 149 * deg), (0.0, lat0 - 151 * deg), (40 * east, lat0), (40 * east, lat0)]
    f = spark.createDataFrame([(i, *p) for i, p in enumerate(fires)], "fire_id int, longitude double, latitude double")
    path = spark.createDataFrame([(1, 0, 0.0, lat0), (1, 1, 0.01, lat0), (2, 0, 50.0, -40.0)], "parcel_id int, step int, lon double, lat double")
    near = {r["parcel_id"]: r["fires_along_path"] for r in tr.fires_along_path(path, f, 50.0).collect()}
    wide = {r["parcel_id"]: r["fires_along_path"] for r in tr.fires_along_path(path, f, 150.0).collect()}
    assert near == {1: 3, 2: 0} and wide == {1: 5, 2: 0}


def test_fires_match_brute_force_with_a_hot_spot(spark):
    rng = np.random.default_rng(4)
    pts = np.round(np.column_stack([rng.uniform(70, 80, 300), rng.uniform(20, 30, 300)]), 1)
    pts[:100] = (75.0, 25.0)  # a third of all fires at one place
    nodes = np.column_stack([rng.uniform(70, 80, 12), rng.uniform(20, 30, 12)])
    f = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "fire_id int, longitude double, latitude double")
    path = spark.createDataFrame([(i % 3, i, float(a), float(b)) for i, (a, b) in enumerate(nodes)], "parcel_id int, step int, lon double, lat double")
    got = {r["parcel_id"]: r["fires_along_path"] for r in tr.fires_along_path(path, f, 120.0).collect()}

    def dist(a, b):
        x1, y1, x2, y2 = map(math.radians, (*a, *b))
        h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
        return 2 * R * math.asin(math.sqrt(h))

    want = {k: sum(min(dist(p, n) for i, n in enumerate(nodes) if i % 3 == k) <= 120.0 for p in pts) for k in range(3)}
    assert got == want


def test_density_edges(spark):
    f = spark.createDataFrame([(68.0, 6.5), (97.5, 37.5), (97.4999, 37.4999), (60.0, 10.0)], "longitude double, latitude double")
    got = {(r["x_bin"], r["y_bin"]): r["n"] for r in tr.fire_density(f).collect()}
    assert got == {(0, 0): 1, (119, 119): 2}


def test_fires_along_path_counts_pairs_where_they_arise(spark):
    rng = np.random.default_rng(5)
    path = spark.createDataFrame([(int(k // 6), float(x), float(y)) for k, (x, y) in enumerate(rng.uniform((70, 20), (76, 26), (60, 2)))] + [(99, 10.0, -40.0)], "parcel_id long, lon double, lat double")
    # over 1,000 coordinates in one bucket, some with several fires
    spots = np.round(rng.uniform((72, 22), (73, 23), (3000, 2)), 2).tolist() + rng.uniform((69, 19), (77, 27), (500, 2)).tolist()
    fires = spark.createDataFrame([(*s,) for s in spots], "longitude double, latitude double")
    seen = path.crossJoin(fires.withColumn("fire", F.monotonically_increasing_id())).where(haversine_km(F.col("longitude"), F.col("latitude"), F.col("lon"), F.col("lat")) <= 80.0)
    want = {r["parcel_id"]: r["n"] for r in seen.groupBy("parcel_id").agg(F.count_distinct("fire").alias("n")).collect()}
    out = tr.fires_along_path(path, fires, 80.0)
    got = {r["parcel_id"]: r["fires_along_path"] for r in out.collect()}
    assert got == {k: want.get(k, 0) for k in [*range(10), 99]} and sum(want.values()) > 3000
    # no row for each pair of path and coordinate is kept to be made distinct
    assert "Aggregate [parcel_id#" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and not any("_flon" in line and "parcel_id#" in line for line in plan.splitlines() if "Aggregate [parcel_id#" in line)
