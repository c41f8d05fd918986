from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid.operators import joining as j


def test_nearest_station_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    st = np.round(rng.uniform(-1, 1, (60, 2)), 3)
    pts = np.round(rng.uniform(-1, 1, (400, 2)), 3)
    s = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(st)], "station_id int, lon double, lat double")
    p = spark.createDataFrame([(date(2024, 1, 1), float(a), float(b), float(i)) for i, (a, b) in enumerate(pts)], "date date, lon double, lat double, v double")
    got = {(r["lon"], r["lat"]): r["station_id"] for r in j.map_to_nearest_station(p, s).collect()}
    d = np.sqrt(((pts[:, None] - st[None]) ** 2).sum(-1))
    want = {(float(pts[i, 0]), float(pts[i, 1])): int(d[i].argmin()) for i in range(len(pts)) if d[i].min() <= 0.12}
    assert got == want
    means = {r["station_id"]: r["v"] for r in j.points_to_stations(p, s, ["v"]).collect()}
    for k in set(want.values()):
        assert means[k] == pytest.approx(np.mean([i for i in range(len(pts)) if want.get((float(pts[i, 0]), float(pts[i, 1]))) == k]))


@pytest.mark.parametrize("ranges", [None, 7])
def test_nearest_time_matches_argmin(spark, ranges):
    rng = np.random.default_rng(1)
    base = datetime(2024, 1, 1)
    axis = sorted({base + timedelta(minutes=int(m)) for m in rng.choice(60 * 24 * 20, 25)})
    q = [base + timedelta(minutes=int(m) - 3000) for m in rng.integers(0, 60 * 24 * 25, 200)]
    q += [axis[0] + (axis[1] - axis[0]) / 2]  # a tie goes to the earlier instant
    a = spark.createDataFrame([(t,) for t in axis], "a timestamp")
    df = spark.createDataFrame(list(enumerate(q)), "id int, ts timestamp")
    got = {r["id"]: r["nearest_time"] for r in j.nearest_time(df, a, "ts", "a", ranges).collect()}
    want = {i: min(axis, key=lambda x: (abs(x - t), x)) for i, t in enumerate(q)}
    assert got == want


@pytest.mark.parametrize("ranges", [None, 9])
def test_nearest_time_of_a_hot_instant_and_odd_rows(spark, ranges):
    base = datetime(2024, 1, 1)
    axis = [base + timedelta(hours=h) for h in (0, 0, 5, 9)] + [None]
    q = [base + timedelta(hours=6)] * 60 + [base + timedelta(hours=5)] * 60 + [None] * 30 + [base - timedelta(days=3), base + timedelta(days=3), base + timedelta(hours=7)]
    a = spark.createDataFrame([(t,) for t in axis], "a timestamp")
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(q)], "id int, ts timestamp, range string")
    got = {r["id"]: r["nearest_time"] for r in j.nearest_time(df, a, "ts", "a", ranges).collect()}
    known = sorted({t for t in axis if t})
    assert got == {i: None if t is None else min(known, key=lambda x: (abs(x - t), x)) for i, t in enumerate(q)}
    assert j.nearest_time(df, a, "ts", "a").columns == ["id", "ts", "range", "nearest_time"]
    assert {r["nearest_time"] for r in j.nearest_time(df, a.limit(0), "ts", "a").collect()} == {None}


def test_nearest_time_has_no_frame_that_reaches_to_the_end_for_each_row(spark):
    df = spark.range(50).select("id", F.timestamp_seconds("id").alias("ts"))
    plan = j.nearest_time(df, df.select(F.col("ts").alias("a")), "ts", "a")._jdf.queryExecution().executedPlan().toString()
    # one such frame goes over the few rows of the table of ranges, none over rows or instants
    wide = [line for line in plan.splitlines() if "unboundedfollowing" in line and " t#" in line]
    assert "unboundedpreceding$(), currentrow$()" in plan and not wide


def test_within_box_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.uniform(-3, 3, (40, 2)), 1), np.round(rng.uniform(-3, 3, (90, 2)), 1)
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "id int, lon double, lat double")
    right = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "rid int, lon double, lat double")
    got = sorted((r["id"], r["r_rid"]) for r in j.within_box(left, right, 0.5).collect())
    want = sorted((i, k) for i in range(40) for k in range(90) if (abs(b[k] - a[i]) <= 0.5).all())
    assert got == want and len(got) == len(set(got))


def test_fuse_sources_is_a_full_outer_join(spark):
    d = date(2024, 1, 1)
    a = spark.createDataFrame([("x", d, 1.0), ("y", d, 2.0)], "station_id string, date date, no2 double")
    b = spark.createDataFrame([("y", d, 3.0), ("z", d, 4.0)], "station_id string, date date, aod double")
    got = {r["station_id"]: (r["no2"], r["aod"]) for r in j.fuse_sources([a, b]).collect()}
    assert got == {"x": (1.0, None), "y": (2.0, 3.0), "z": (None, 4.0)}


def test_first_coordinates_skip_missing_and_follow_the_order(spark):
    rows = [("a", 2, 9.0, 9.0), ("a", 1, None, 1.0), ("a", 3, 5.0, 5.0), ("b", 1, None, None)]
    df = spark.createDataFrame(rows, "station_id string, date int, lat double, lon double")
    got = {r["station_id"]: (r["lat"], r["lon"]) for r in j.first_coordinates(df).collect()}
    assert got == {"a": (9.0, 9.0), "b": (None, None)}


def test_in_set_splits_completely(spark):
    df = spark.range(20).withColumn("k", F.col("id") % 5)
    out, inside = j.in_set(df, spark.createDataFrame([(1,), (1,), (3,)], "k bigint"), ["k"])
    assert inside.count() == 8 and out.count() == 12


def test_dossier(spark):
    from hazegrid.operators.layers import cell_dossier

    places = spark.createDataFrame([(1, 75.0, 25.0), (2, 10.0, 10.0)], "place_id int, lon double, lat double")
    cells = spark.createDataFrame([(1, 1, 75.3, 25.1, 80.0, 0.4, 2, "Poor", 0.1), (0, 9, 74.8, 25.2, 90.0, 0.5, 1, "Good", 0.2)],
                                  "row int, col int, lon double, lat double, aqi double, hcho double, zone_id int, zone_label string, isolation_score double")
    fires = spark.createDataFrame([(76.9, 25.0, 5.0), (77.0, 27.0, None), (77.1, 25.0, 9.0)], "longitude double, latitude double, frp double")
    spots = spark.createDataFrame([(75.5, 25.0, "urban", 1), (76.9, 25.0, "other", 2), (77.0, 25.0, "far", 3)], "lon double, lat double, source string, hotspot_id int")
    got = {r["place_id"]: r for r in cell_dossier(places, cells, cells, cells, cells, fires, spots).collect()}
    r = got[1]
    assert (r["aqi"], r["zone_label"], r["nearby_fire_count"], r["nearby_frp"], r["source"]) == (90.0, "Good", 2, 5.0, "urban")
    assert got[2]["aqi"] is None and got[2]["nearby_fire_count"] == 0 and got[2]["source"] is None


def test_dossier_does_not_pair_repeated_coordinates(spark, monkeypatch):
    from hazegrid.operators import layers

    pairs = []

    def counted(*args, **kwargs):
        pairs.append(j.within_box(*args, **kwargs))
        return pairs[-1]

    monkeypatch.setattr(layers, "within_box", counted)
    at = [F.lit(75.0).alias("lon"), F.lit(25.0).alias("lat")]
    places = spark.range(300).select(F.col("id").alias("place_id"), *at)
    cells = spark.createDataFrame([(0, 9, 74.8, 25.2, 90.0, 0.5, 1, "Good", 0.2)], "row int, col int, lon double, lat double, aqi double, hcho double, zone_id int, zone_label string, isolation_score double")
    fires = spark.range(4).select(F.lit(75.5).alias("longitude"), F.lit(25.0).alias("latitude"), F.lit(2.0).alias("frp"))
    spots = spark.range(400).select(*at, F.concat(F.lit("s"), F.col("id")).alias("source"), (1000 - F.col("id")).alias("hotspot_id"))
    rows = layers.cell_dossier(places, cells, cells, cells, cells, fires, spots).collect()
    assert len(rows) == 300 and {(r["aqi"], r["nearby_fire_count"], r["nearby_frp"], r["source"]) for r in rows} == {(90.0, 4, 8.0, "s399")}
    assert [p.count() for p in pairs] == [1] * 6
