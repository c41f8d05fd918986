from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid.models import fields, isolation, kriging, metrics, regression, splits, zones
from hazegrid.models.scaling import RobustScale
from hazegrid.operators.analysis import analysis_layers
from hazegrid.plans.catalogue import QUERIES

FOREST = regression.random_forest(trees=15, max_depth=8)


def station_panel(spark, n_stations=30, days=10, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(n_stations):
        lon, lat = float(rng.uniform(70, 90)), float(rng.uniform(10, 30))
        bias = 20 * np.sin(lon / 2) + 10 * np.cos(lat / 2)
        for d in range(days):
            x = float(rng.random())
            rows.append((f"s{s:02d}", date(2023, 1, 1) + timedelta(days=d), lon, lat, x, float(50 + 30 * x + bias + rng.normal())))
    return spark.createDataFrame(rows, "station_id string, date date, lon double, lat double, x double, pm25 double")


def test_scores_match_numpy(spark):
    t, p = np.array([1.0, 2.0, 4.0, 9.0]), np.array([1.5, 2.0, 3.0, 8.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, p)] + [(None, 5.0)], "t double, p double")
    r = metrics.score(df, {"k": ("t", "p")}).first()
    assert r["r2"] == pytest.approx(1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum())
    assert r["rmse"] == pytest.approx(np.sqrt(((t - p) ** 2).mean())) and r["mae"] == pytest.approx(np.abs(t - p).mean()) and r["n"] == 4
    assert metrics.score(df.where("t is null"), {"k": ("t", "p")}).first()["r2"] is None
    assert metrics.score(df.where("t = 1.0"), {"k": ("t", "t")}).first()["r2"] == 1.0


def test_targets_without_rows_are_skipped_and_inputs_survive(spark):
    df = spark.createDataFrame([(float(i), None if i % 3 else 2.0 * i, None) for i in range(60)], "x double, y double, z double")
    model = regression.TargetRegressors(["y", "z"], ["x", "absent"], regression.linear()).fit(df)
    assert list(model.models) == ["y"]
    out = model.predict(df.withColumn("x", F.when(F.col("x") != 5, F.col("x"))))
    assert out.columns == ["x", "y", "z", "pred_y"]
    assert out.where("x is null").first()["pred_y"] == pytest.approx(0.0, abs=1e-6)
    assert out.where("x = 40").first()["pred_y"] == pytest.approx(80.0)


def test_save_and_load(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(40)], "x double, y double")
    model = regression.TargetRegressors(["y"], ["x"], FOREST).fit(df)
    model.save(str(tmp_path / "m"), spark)
    again = regression.TargetRegressors.load(str(tmp_path / "m"), spark)
    assert sorted(map(tuple, again.predict(df).collect())) == sorted(map(tuple, model.predict(df).collect()))
    assert regression.importances(model, "y", spark).first()["feature"] == "x"


def test_pooled_boosting_equals_that_of_the_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float(3 * a - b + a * b + rng.normal())) for a, b in rng.integers(0, 6, (900, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y double").repartition(3)
    make = regression.boosted_trees(rounds=6, max_depth=3, rate=0.3, share=1.0)
    plain = regression.TargetRegressors(["y"], ["a", "b"], make).fit(df)
    pooled = regression.TargetRegressors(["y"], ["a", "b"], make, pooled=True).fit(df)
    asked = df.unionByName(spark.createDataFrame([(None, 2.0, 0.0), (7.5, 2.0, 0.0)], df.schema))
    want, got = (sorted((r["y"], r["b"], r["pred_y"]) for r in m.predict(asked).collect()) for m in (plain, pooled))
    assert len(got) == 902 and np.array(got) == pytest.approx(np.array(want))
    assert pooled.predict(asked).where("a is null").count() == 1
    # all rows are in: their number and sum, in fewer weighted ones
    blocks = regression.blocks(df.crossJoin(spark.range(5)).drop("id"), ["a", "b"], "y")
    r = blocks.agg(F.count("y").alias("n"), F.sum("_weight").alias("w"), F.sum(F.col("_weight") * F.col("y")).alias("s")).first()
    assert r["n"] <= 900 and r["w"] == 4500 and r["s"] == pytest.approx(5 * sum(y for *_, y in rows))


def test_ml_02_boosts_with_the_defaults(spark, monkeypatch):
    real, asked = regression.boosted_trees, []
    assert real.__defaults__[:2] == (600, 8)
    monkeypatch.setattr(regression, "boosted_trees", lambda *a, **kw: asked.append((a, kw)) or real(rounds=2, max_depth=2))
    assert QUERIES["ml_02_boosted_trees"](spark, "/root/testdata/sf0.001").count() > 5000
    assert asked == [((), {})]


def test_gap_fill_keeps_observed_and_fills_the_rest(spark):
    rng = np.random.default_rng(1)
    rows = []
    for d in range(6):
        for r in range(12):
            for c in range(12):
                blh, elev = float(rng.uniform(200, 2000)), float(r * 50)
                aod = 0.3 + 0.0003 * blh + 0.001 * elev
                rows.append((date(2023, 1, 1) + timedelta(days=d), r, c, 70 + c * 1.0, 20 + r * 1.0, None if rng.random() < 0.3 else aod, aod, blh, elev))
    df = spark.createDataFrame(rows, "date date, row int, col int, lon double, lat double, aod double, truth double, blh double, elevation double")
    out = fields.fill_gaps(df, "aod", factory=FOREST)
    assert out.count() == df.count() and out.where("aod is null").count() == 0
    assert out.where("not was_missing and aod <> truth").count() == 0
    assert out.where("was_missing").agg(F.corr("aod", "truth")).first()[0] > 0.7
    skill = fields.gap_skill(df, "aod", factory=FOREST).first()
    assert skill["cv_r2"] > 0.5 and skill["cv_n"] == df.where("aod is not null").count()
    assert fields.gap_skill(df.limit(30), "aod", factory=FOREST).first()["cv_r2"] is None
    assert fields.missing_share(df, "aod").first()[0] == pytest.approx(df.where("aod is null").count() / df.count())


def calibration_rows(spark, n=600):
    rng = np.random.default_rng(2)
    no2, blh, temp = rng.uniform(1, 10, n), rng.uniform(200, 2000, n), rng.uniform(280, 310, n)
    obs = 12 * no2 * (500 / blh) ** 0.5 + 0.2 * (temp - 290) + rng.normal(0, 1, n)
    return spark.createDataFrame([tuple(map(float, v)) for v in zip(no2, blh, temp, obs)], "no2 double, blh double, temperature double, no2_obs double")


def test_calibration_beats_the_raw_column_and_refuses_missing_covariates(spark):
    df = calibration_rows(spark)
    cal = fields.ColumnCalibrator(factory=FOREST).fit(df)
    rep = cal.report(df).first()
    assert rep["r2"] > 0.8 and rep["r2_gain_over_raw_column"] > 0 and rep["n"] == 600
    with pytest.raises(KeyError):
        cal.predict(df.drop("blh"))
    with pytest.raises(RuntimeError):
        fields.ColumnCalibrator().predict(df)
    cells, _ = fields.calibrate_cells(df.drop("no2_obs"), df, factory=FOREST)
    assert cells.where("no2_surface is null").count() == 0


def test_kriging_decays_and_ignores_missing_residuals(spark):
    st = spark.createDataFrame([(80.0, 25.0, 5.0, None), (80.5, 25.0, None, 2.0)], "lon double, lat double, a double, b double")
    q = spark.createDataFrame([(80.0, 25.0), (95.0, 10.0), (80.0, 25.0)], "lon double, lat double")
    got = {r["lon"]: r for r in kriging.krige_residuals(q, st, ["a", "b"]).collect()}
    assert len(got) == 2 and got[80.0]["a"] > 4 and abs(got[95.0]["a"]) < 0.1
    w = np.exp(-0.25 / 0.72)
    assert got[80.0]["b"] == pytest.approx(2 * w / (w + 0.01))


def test_kriging_matches_the_dense_product(spark):
    rng = np.random.default_rng(3)
    s, q = rng.uniform([68, 6], [98, 38], (40, 2)), rng.uniform([68, 6], [98, 38], (60, 2))
    r = rng.normal(size=40) * 30
    st = spark.createDataFrame([(float(a), float(b), float(v)) for (a, b), v in zip(s, r)], "lon double, lat double, v double")
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(q)], "id int, lon double, lat double")
    got = {x["id"]: x["v"] for x in kriging.krige_residuals(pts, st, ["v"], point_key=["id"]).collect()}
    w = np.exp(-((q[:, None] - s[None]) ** 2).sum(-1) / 0.72)
    want = w @ r / (w.sum(1) + 0.01)
    assert [got[i] for i in range(60)] == pytest.approx(list(want), abs=1e-9)


def test_hybrid_beats_the_trend_on_station_bias(spark):
    df = splits.last_dates(station_panel(spark), 0.3)
    out = kriging.trend_versus_hybrid(df.where(~F.col("is_test")), df.where("is_test"), ["pm25"], ["x"], regression.linear())
    r2 = {r["model"]: r["r2"] for r in out.collect()}
    assert r2["hybrid"] > r2["trend"] + 0.3 and out.first()["benchmark_r2"] == 0.86


def test_splits_never_share_blocks_groups_or_dates(spark):
    df = station_panel(spark)
    folded = splits.spatial_folds(df, 2.0, 5)
    per_block = folded.groupBy(F.floor(F.col("lon") / 2), F.floor(F.col("lat") / 2)).agg(F.count_distinct("fold").alias("n"))
    assert per_block.agg(F.max("n")).first()[0] == 1 and folded.count() == df.count()
    sizes = [r["n"] for r in folded.select(F.floor(F.col("lon") / 2).alias("a"), F.floor(F.col("lat") / 2).alias("b"), "fold").distinct().groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 1
    assert splits.group_folds(df).groupBy("station_id").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    dates = splits.last_dates(df, 0.2).groupBy("is_test").agg(F.min("date"), F.max("date"), F.count_distinct("date").alias("d")).orderBy("is_test").collect()
    assert [r["d"] for r in dates] == [8, 2]
    a = splits.random_folds(df, F.concat("station_id", "date"), 4).repartition(7).orderBy("station_id", "date").select("fold").collect()
    assert a == splits.random_folds(df, F.concat("station_id", "date"), 4).orderBy("station_id", "date").select("fold").collect()
    train, test = splits.held_out_years(df, [2023])
    assert train.count() == 0 and test.count() == df.count()


def test_validation_gates(spark):
    df = station_panel(spark, 14, 12)
    key = F.concat("station_id", F.col("date").cast("string"))
    out = fields.dual_validation(df, ["pm25"], ["x", "lon", "lat"], key, regression.linear())
    assert {r["scheme"] for r in out.collect()} == {"random_cv", "spatial_cv"} and out.first()["stations"] == 14
    assert fields.dual_validation(df.where("station_id < 's08'"), ["pm25"], ["x"], key, regression.linear()).count() == 0
    schemes = fields.compare_schemes(df, "pm25", ["x", "lon"], key, regression.linear())
    assert {r["scheme"] for r in schemes.collect()} == {"random", "spatial", "temporal"}


def test_robust_scale(spark):
    v = np.random.default_rng(5).normal(size=501)
    df = spark.createDataFrame([(float(x), 3.0) for x in v] + [(None, 3.0)], "a double, b double")
    s = RobustScale.fit(df, ["a", "b"])
    assert s.centre[0] == pytest.approx(np.median(v)) and s.spread == [pytest.approx(np.subtract(*np.quantile(v, [0.75, 0.25]))), 1.0]
    assert s.apply(df).where("a is null").first()["_s_a"] == 0.0


def zone_frame(spark):
    rows = []
    for i, (aqi, hcho, no2, co) in enumerate([(40, 0.1, 0.1, 0.1), (120, 0.3, 0.25, 0.2), (240, 0.6, 0.55, 0.45), (380, 0.9, 0.85, 0.8)]):
        for k in range(8):
            rows.append((i, k, float(k), float(i), aqi + k * 0.4, hcho + k * 0.001, no2 + k * 0.001, co + k * 0.001))
    return spark.createDataFrame(rows, "row int, col int, lon double, lat double, aqi double, hcho double, no2 double, co double")


def test_zones_are_ordered_and_keep_incomplete_rows(spark):
    df = zone_frame(spark).union(spark.createDataFrame([(9, 9, 9.0, 9.0, 50.0, None, 0.1, 0.1)], zone_frame(spark).schema))
    out, meta = zones.fit_zones(df, n_init=3)
    assert meta["selected_k"] == 4 and set(meta["candidate_silhouette"]) == {"3", "4", "5"}
    rows = out.collect()
    assert [r["zone_id"] for r in rows if r["row"] == 9] == [None]
    by_row = {r["row"]: r["zone_id"] for r in rows if r["row"] < 9}
    assert by_row == {0: 0, 1: 1, 2: 2, 3: 3}
    assert sum(r["zone_score"] for r in rows if r["row"] == 2) == pytest.approx(0.0, abs=1e-6)
    centres = [c["aqi"] for c in meta["cluster_centres"]]
    assert centres == sorted(centres) and centres[0] == pytest.approx(41.4) and meta["zone_counts"] == {str(i): 8 for i in range(4)}
    assert zones.zone_metadata_rows(spark, meta).count() == 4
    with pytest.raises(ValueError):
        zones.fit_zones(df.limit(3))


def test_silhouette_matches_definition_at_any_size(spark):
    out, meta = zones.fit_zones(zone_frame(spark), ["aqi"], (2,), n_init=2)
    rows = out.collect()
    x, g = np.array([r["aqi"] for r in rows]), np.array([r["zone_id"] for r in rows])
    d = (x[:, None] - x[None]) ** 2
    s = []
    for i in range(len(x)):
        same = (g == g[i]) & (np.arange(len(x)) != i)
        a, b = d[i][same].mean(), min(d[i][g == k].mean() for k in set(g) - {g[i]})
        s.append((b - a) / max(a, b))
    assert meta["candidate_silhouette"]["2"] == pytest.approx(np.mean(s), abs=1e-9)


def anomaly_frame(spark):
    rows = []
    for r in range(8):
        for c in range(8):
            odd = r in (5, 6) and c in (5, 6)
            rows.append((r, c, float(c), float(r), *((1.8, 1.2, 1.0) if odd else (0.2 + 0.001 * r, 0.2 + 0.001 * c, 0.2)), odd, None))
    return spark.createDataFrame(rows, "row int, col int, lon double, lat double, hcho double, no2 double, co double, odd boolean, aqi double")


def test_isolation_finds_and_groups_the_block(spark):
    out, meta = isolation.isolation_hotspots(anomaly_frame(spark), ["hcho", "no2", "co"], 0.0625, seed=1, n_trees=60)
    rows = out.collect()
    assert {(r["row"], r["col"]) for r in rows if r["isolation_anomaly"]} == {(5, 5), (5, 6), (6, 5), (6, 6)}
    assert all((r["isolation_cluster_id"], r["isolation_cluster_size"]) == ((0, 4) if r["isolation_anomaly"] else (-1, 0)) for r in rows)
    assert meta["n_anomalies"] == 4 and meta["n_clusters"] == 1
    again, _ = isolation.isolation_hotspots(anomaly_frame(spark).repartition(3), ["hcho", "no2", "co"], 0.0625, seed=1, n_trees=60)
    key = lambda r: (r["row"], r["col"])
    assert [r["isolation_score"] for r in sorted(rows, key=key)] == pytest.approx([r["isolation_score"] for r in sorted(again.collect(), key=key)])
    with pytest.raises(ValueError):
        isolation.isolation_hotspots(anomaly_frame(spark).limit(5), ["hcho"])


def test_isolation_keeps_scenes_apart(spark):
    one = anomaly_frame(spark)
    both = one.withColumn("date", F.lit("a")).union(one.withColumn("date", F.lit("b")))
    out, meta = isolation.isolation_hotspots(both, ["hcho", "no2", "co"], 0.0625, seed=1, n_trees=60, scene=("date",))
    rows = out.collect()
    assert len(rows) == 128 and meta["n_clusters"] == 2 and meta["n_anomalies"] == 8
    assert {(r["date"], r["isolation_cluster_id"], r["isolation_cluster_size"]) for r in rows if r["isolation_anomaly"]} == {("a", 0, 4), ("b", 1, 4)}
    with pytest.raises(ValueError, match="scenes"):
        isolation.isolation_hotspots(both, ["hcho", "no2", "co"])


def test_isolation_sample_is_bounded(spark):
    df = spark.range(5000).select(F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), F.rand(1).alias("_s_a"))
    drawn = isolation._draw(df, F.concat_ws(",", "row", "col"), 5000, 10, 0)
    sizes = {r["tree"]: r["n"] for r in drawn.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("row")).collect()}
    assert sizes == {i: 256 for i in range(10)}
    small = isolation._draw(df.limit(100), F.concat_ws(",", "row", "col"), 100, 7, 0)
    assert {r["n"] for r in small.groupBy("tree").agg(F.count_distinct("row").alias("n")).collect()} == {100}


def test_layer_contract(spark):
    import json

    cells = anomaly_frame(spark).withColumn("aqi", F.col("hcho") * 100).withColumn("frp_mean", F.lit(0.0))
    out = analysis_layers(cells, "2024-01-01", "odd", k_range=(2, 3), contamination=0.0625, n_init=1, n_trees=40).collect()
    meta = json.loads(next(r["json"] for r in out if r["layer"] == "analysis_metadata"))
    assert meta["isolation_forest"]["mask_comparison"]["jaccard"] == 1.0 and meta["data_status"] == "synthetic_demo"
    assert sum(r["layer"] == "zone_cells" for r in out) == 64 and sum(r["layer"] == "isolation_hotspots" for r in out) == 4
    with pytest.raises(ValueError):
        analysis_layers(cells.drop("lon"))


def test_kmeans_runs_advance_together_as_alone(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (3, 1), (1, 4))])
    points = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double").repartition(3)
    fits = zones.best_fits(points, ["a", "b"], [2, 3, 4], n_init=20, tol=1e-12)
    assert sorted(fits[3].counts) == [60, 60, 60]
    for k, f in fits.items():
        d = ((x[:, None] - f.centres) ** 2).sum(2)
        own = d.argmin(1)
        assert f.cost == pytest.approx(d.min(1).sum()) and f.counts.tolist() == np.bincount(own, minlength=k).tolist()
        # a fixed point: every centre is the mean of its points
        for c in range(k):
            assert f.centres[c] == pytest.approx(x[own == c].mean(0), abs=1e-3)
    scores = zones.silhouettes(points, ["a", "b"], [fits[k] for k in (2, 3, 4)])
    full = ((x[:, None] - x) ** 2).sum(2)
    for k, f in fits.items():
        own = ((x[:, None] - f.centres) ** 2).sum(2).argmin(1)
        s = []
        for i in range(len(x)):
            mean = [full[i][own == c].sum() / max(1, (own == c).sum() - (c == own[i])) for c in range(k)]
            inside, outside = mean[own[i]], min(m for c, m in enumerate(mean) if c != own[i])
            s.append((outside - inside) / max(inside, outside))
        assert scores[k] == pytest.approx(np.mean(s), abs=1e-6)
    assert max(scores, key=scores.get) == 3


def test_kmeans_of_equal_points_and_candidates(spark):
    points = spark.createDataFrame([(1.0,)] * 9, "a double")
    fits = zones.best_fits(points, ["a"], [2], n_init=2)
    assert fits[2].cost == 0 and sorted(fits[2].counts) == [0, 9]
    assert zones.silhouettes(points, ["a"], [fits[2]]) == {2: None}
    assert zones.candidate_counts((5, 3, 3, 1, 9), 6) == [3, 5]


def test_lloyd_step_far_from_zero(spark):
    from hazegrid.models import zones

    # squares of 1e8 leave no digit for a distance of 1; halfway points go to the first centre
    df = spark.createDataFrame([(1e8 + i, 0.5) for i in range(5)], "a double, b double")
    got = {r["cluster"]: (r["n"], r["cost"]) for r in zones.lloyd_step(df, ["a", "b"], [np.array([[1e8 + 1, 0.5], [1e8 + 3, 0.5]])]).collect()}
    assert got == {0: (3, 2.0), 1: (2, 1.0)}


def test_nearest_centre_column_by_column():
    import tracemalloc

    rng = np.random.default_rng(5)
    x, centres = rng.integers(0, 6, (20_000, 4)).astype(float) + 1e8, rng.integers(0, 6, (40, 4)).astype(float) + 1e8
    gaps = ((x[:, None] - centres) ** 2).sum(2)
    columns = list(np.ascontiguousarray(x.T))
    tracemalloc.start()
    nearest, least = zones._nearest(columns, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the first of equally near centres; a few columns of memory, whatever the number of centres
    assert nearest.tolist() == gaps.argmin(1).tolist() and least.tolist() == gaps.min(1).tolist()
    assert peak < 8 * x[:, 0].nbytes


def test_rows_walk_whole_levels(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(500, 2)), [[np.inf, 0.0], [np.nan, 1.0], [-np.inf, np.nan]]])
    sample = spark.createDataFrame([(t, *map(float, r)) for t in range(3) for r in rng.normal(size=(60, 2))], "tree int, a double, b double")
    table = isolation.grow_trees(sample, ["a", "b"], 60, 1).toPandas().sort_values(["tree", "node"])
    want = np.zeros(len(x))
    for _, g in table.groupby("tree"):
        nodes = g.set_index("node")
        for i, row in enumerate(x):
            n = nodes.loc[0]
            while n["feature"] >= 0:
                n = nodes.loc[n["left"] if row[int(n["feature"])] < n["cut"] else n["right"]]
            want[i] += n["depth"]
    trees = [isolation._levels(g) for _, g in table.groupby("tree")]
    assert isolation._walk(x, trees).tolist() == want.tolist()


def test_layers_read_their_cells_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    cells = anomaly_frame(spark).withColumn("aqi", counted(F.col("hcho").cast("double"))).withColumn("frp_mean", F.lit(0.0))
    analysis_layers(cells, "2024-01-01", "odd", k_range=(2,), contamination=0.0625, n_init=1, n_trees=10)
    assert seen.value == 64


def test_trees_get_bounded_partitions(spark, monkeypatch):
    monkeypatch.setattr(regression, "TREE_ROWS", 50)
    rows = spark.range(0, 400, 1, 2).select(F.col("id").cast("double").alias("x"))
    assert regression.tree_partitions(rows).rdd.getNumPartitions() == 8
    assert max(regression.tree_partitions(rows).rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) <= 60
    assert regression.tree_partitions(rows.limit(40)).rdd.getNumPartitions() == 1


def test_dual_validation_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    raw = spark.range(0, 300, 1, 2).selectExpr("id % 30 AS station_id", "id AS k", "double(id % 30) AS lon", "double(id % 7) AS lat", "double(id % 11) AS x", "double(id % 11) * 2 + id % 3 AS y")
    out = fields.dual_validation(raw.mapInArrow(pass_on, raw.schema), ["y"], ["x"], F.col("k").cast("string"), regression.linear())
    assert {r["scheme"]: r["n"] for r in out.collect()} == {"random_cv": 300, "spatial_cv": 300}
    assert seen.value == 300
