import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid.grid import GridSpec
from hazegrid.operators import zonal

GRID = GridSpec(10.0, 40.0, 16.0, 45.0, 0.5)  # 12 columns, 10 rows


def clip(poly, axis, at, keep_above):
    """Part of a polygon on one side of a line (Sutherland-Hodgman)."""
    out = []
    for p, q in zip(poly, poly[1:] + poly[:1]):
        ip, iq = ((p[axis] >= at) == keep_above or p[axis] == at), ((q[axis] >= at) == keep_above or q[axis] == at)
        if ip:
            out.append(p)
        if ip != iq:
            f = (at - p[axis]) / (q[axis] - p[axis])
            out.append(tuple(a + f * (b - a) for a, b in zip(p, q)))
    return out


def area(poly):
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(poly, poly[1:] + poly[:1]))) / 2 if len(poly) > 2 else 0.0


def brute(rings):
    """Covered share of each cell."""
    out = {}
    for r in range(GRID.n_rows):
        for c in range(GRID.n_cols):
            west, north = GRID.min_lon + c * 0.5, GRID.max_lat - r * 0.5
            total = 0.0
            for hole, ring in rings:
                part = ring
                for axis, at, above in ((0, west, True), (0, west + 0.5, False), (1, north - 0.5, True), (1, north, False)):
                    part = clip(part, axis, at, above) if part else []
                total += (-1 if hole else 1) * area(part) / 0.25
            if total > 1e-9:
                out[r, c] = total
    return out


ZONES = {
    "triangle with hole": [(False, [(10.3, 40.4), (15.7, 41.1), (12.2, 44.8)]), (True, [(12.0, 41.5), (12.4, 42.9), (13.3, 42.0)])],
    "on the lines": [(False, [(11.0, 41.0), (13.0, 41.0), (13.0, 43.0), (11.0, 43.0)]), (True, [(11.5, 41.5), (11.5, 42.5), (12.0, 42.5), (12.0, 41.5)])],
    "over all edges": [(False, [(8.0, 39.0), (18.0, 38.0), (17.0, 47.0), (9.0, 46.0)])],
    "over the west": [(False, [(7.1, 41.2), (10.9, 42.3), (9.2, 44.1)])],
    "far east": [(False, [(17.0, 41.0), (18.0, 42.0), (17.0, 43.0)])],
    "tiny": [(False, [(12.11, 42.07), (12.13, 42.07), (12.12, 42.09)])],
    "two parts, concave": [(False, [(10.2, 43.1), (12.2, 44.9), (11.1, 43.5), (12.4, 43.2)]), (False, [(14.1, 40.2), (15.9, 40.1), (15.0, 41.9)])],
}


def vertices(spark):
    rows = [(z, k, s, hole, *p) for z, rings in ZONES.items() for k, (hole, ring) in enumerate(rings) for s, p in enumerate(ring[::-1] if k % 2 else ring)]
    return spark.createDataFrame(rows, "zone string, ring int, seq int, hole boolean, lon double, lat double")


def test_shares_equal_clipping_cell_by_cell(spark):
    got = {z: {} for z in ZONES}
    for r in zonal.zone_spans(vertices(spark), GRID).collect():
        for c in range(r["first"], r["last"] + 1):
            assert (r["row"], c) not in got[r["zone"]]
            got[r["zone"]][r["row"], c] = r["share"]
    for z, rings in ZONES.items():
        want = brute(rings)
        assert {k for k, v in got[z].items() if v > 1e-9} == set(want)
        for k, v in want.items():
            assert got[z][k] == pytest.approx(v, abs=1e-9)
    assert len(got["over all edges"]) == GRID.n_rows * GRID.n_cols and got["far east"] == {}


def test_statistics_and_exposure(spark):
    rng = np.random.default_rng(6)
    values = {(r, c): (None if (r + c) % 7 == 0 else float(rng.integers(0, 9))) for r in range(10) for c in range(12)}
    people = {k: float(rng.integers(0, 100)) for k in values}
    cells = spark.createDataFrame([(r, c, v, people[r, c]) for (r, c), v in values.items()], "row int, col int, v double, people double")
    covered = zonal.zone_cells(zonal.zone_spans(vertices(spark), GRID), cells)
    stats = {r["zone"]: r for r in zonal.zonal_statistics(covered, "v", F.lit(2.0), [0.1, 0.5, 0.9]).collect()}
    shares = {(r["zone"], r["band"]): r for r in zonal.exposure_shares(covered, F.when(F.col("v") >= 4, "high").when(F.col("v") < 4, "low"), "people").collect()}
    for z, rings in ZONES.items():
        held = [(values[k], 2 * s) for k, s in brute(rings).items() if values[k] is not None]
        if not held:
            assert z not in stats
            continue
        v, w = np.array(held).T
        assert stats[z]["n_cells"] == len(v)
        assert stats[z]["mean"] == pytest.approx((v * w).sum() / w.sum()) and stats[z]["weight"] == pytest.approx(w.sum())
        for p, name in ((0.1, "q10"), (0.5, "q50"), (0.9, "q90")):
            assert stats[z][name] == min(x for x in set(v) if w[v <= x].sum() >= p * w.sum() * (1 - 1e-9))
        all_people = sum(s * people[k] for k, s in brute(rings).items())
        high = sum(s * people[k] for k, s in brute(rings).items() if values[k] is not None and values[k] >= 4)
        if high:
            assert shares[z, "high"]["share"] == pytest.approx(high / all_people)
    assert zonal.zone_spans(vertices(spark).limit(0), GRID).collect() == []


def test_cells_of_one_value_are_dealt_to_several_ranges(spark, monkeypatch):
    runs, sums = [], zonal.running_sums
    monkeypatch.setattr(zonal, "running_sums", lambda *a, **k: runs.append(sums(*a, **k)) or runs[-1])
    cells = spark.range(120).select((F.col("id") / 12).cast("int").alias("row"), (F.col("id") % 12).cast("int").alias("col"), F.when(F.col("id") < 2, 1.0).otherwise(5.0).alias("v"))
    whole = vertices(spark).where("zone = 'over all edges'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = zonal.zonal_statistics(zonal.zone_cells(zonal.zone_spans(whole, GRID), cells), "v", F.lit(1.0), [0.01, 0.5, 0.9]).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [(r["n_cells"], r["q1"], r["q50"], r["q90"]) for r in got] == [(120, 1.0, 5.0, 5.0)] and got[0]["weight"] == pytest.approx(120.0)
    assert runs[0].where("v = 5").select("range").distinct().count() > 1


def test_spans_are_stored_before_the_join(spark):
    cells = spark.range(120).select((F.col("id") / 12).cast("int").alias("row"), (F.col("id") % 12).cast("int").alias("col"))
    plan = zonal.zone_cells(zonal.zone_spans(vertices(spark), GRID), cells)._jdf.queryExecution().optimizedPlan().toString()
    # spans come from files of known size: nothing of the vertices is left to guess it from
    assert "parquet" in plan and "Window" not in plan
