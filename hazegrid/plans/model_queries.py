"""Model, validation, source and sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hazegrid.models import fields, kriging, metrics, regression, splits
from hazegrid.operators import layers
from hazegrid.plans.registry import query, rounded
from hazegrid.plans.views import Tables
from hazegrid.session import materialize, scratch_root
from hazegrid.sources import documents, stations, tables

LINEAR = regression.linear()
SMALL_FOREST = regression.random_forest(trees=8, max_depth=5)


def _key():
    return F.concat_ws("|", "station_id", F.col("date").cast("string"))


_ROWKEY = "CAST(station_id AS VARCHAR) || '|' || CAST(date AS VARCHAR)"


def _hash(key: str, seed: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT)"


# --- splits ---------------------------------------------------------------------------------
@query("ml_14_held_out_years", "SELECT station_id, date, year(date) IN (1997, 2000) AS is_test FROM panel", ["panel"], text=["date"])
def _(t: Tables):
    train, test = splits.held_out_years(t.panel().select("station_id", "date"), [1997, 2000])
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


_LAST = """, dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM panel)),
    cut AS (SELECT min(date) AS c FROM dd WHERE i = (SELECT floor(CAST(count(*) AS DOUBLE) * 0.8e0) FROM dd))"""


@query("ml_15_last_dates", _LAST + " SELECT station_id, date, date >= c AS is_test FROM panel, cut", ["panel"], text=["date"])
def _(t: Tables):
    return splits.last_dates(t.panel().select("station_id", "date"), 0.2)


def _blocks(source: str, deg: str, k: int, seed: int) -> str:
    return f"""blk AS (SELECT DISTINCT CAST(floor(lon / {deg}) AS BIGINT) AS bx, CAST(floor(lat / {deg}) AS BIGINT) AS byy FROM {source}),
    dealt AS (SELECT bx, byy, CAST(ntile({k}) OVER (ORDER BY {_hash("CAST(bx AS VARCHAR) || '_' || CAST(byy AS VARCHAR)", str(seed))}, bx, byy) - 1 AS INT) AS fold FROM blk),
    folded AS (SELECT s.*, fold FROM {source} s JOIN dealt ON CAST(floor(lon / {deg}) AS BIGINT) = bx AND CAST(floor(lat / {deg}) AS BIGINT) = byy)"""


@query("ml_16_spatial_folds", f", {_blocks('panel', '2e0', 10, 42)} SELECT station_id, date, fold FROM folded", ["panel"], text=["date"])
def _(t: Tables):
    return splits.spatial_folds(t.panel().select("station_id", "date", "lon", "lat"), 2.0, 10).drop("lon", "lat")


@query("ml_17_random_folds", f"SELECT station_id, date, CAST({_hash(_ROWKEY, '0')} % 5 AS INT) AS fold FROM panel", ["panel"], text=["date"])
def _(t: Tables):
    return splits.random_folds(t.panel().select("station_id", "date"), _key(), 5)


@query("ml_18_group_folds", f"SELECT station_id, date, CAST({_hash('CAST(station_id AS VARCHAR)', '0')} % 5 AS INT) AS fold FROM panel", ["panel"], text=["date"])
def _(t: Tables):
    return splits.group_folds(t.panel().select("station_id", "date"))


# --- skill ----------------------------------------------------------------------------------
def _skill(name: str, t: str, p: str) -> str:
    return f"""SELECT '{name}' AS target, round(1 - sum(({t} - {p}) * ({t} - {p})) / (var_pop({t}) * count({t})), 5) AS r2, round(sqrt(avg(({t} - {p}) * ({t} - {p}))), 4) AS rmse,
    round(avg(abs({t} - {p})), 4) AS mae, count({t}) AS n"""


def _skill_rounded(df):
    return rounded(rounded(df, 5, "r2"), 4, "rmse", "mae")


@query(
    "ml_04_skill_scores",
    f"{_skill('pm25', 'pm25', 'no2_obs')} FROM panel UNION ALL {_skill('pm10', 'pm10', '(pm25 * 1.5e0)')} FROM panel",
    ["panel"],
)
def _(t: Tables):
    df = t.panel().withColumn("p2", F.col("pm25") * 1.5)
    return _skill_rounded(metrics.score(df, {"pm25": ("pm25", "no2_obs"), "pm10": ("pm10", "p2")}))


@query("ml_01_random_forest")
def _(t: Tables):
    model = regression.TargetRegressors(["pm25", "pm10"], ["no2", "aod", "hcho"], SMALL_FOREST).fit(t.panel())
    return model.predict(t.panel()).select("station_id", F.col("date").cast("string").alias("date"), "pred_pm25", "pred_pm10")


@query("ml_02_boosted_trees")
def _(t: Tables):
    # stored for the fit, its vectors and the predictions; boosted with the operator's own 600 rounds of depth 8
    panel = materialize(t.panel().select("station_id", "date", "no2", "aod", "pm25"), "panel", keep_shuffles=False)
    model = regression.TargetRegressors(["pm25"], ["no2", "aod"], regression.boosted_trees(), stored=True, pooled=True).fit(panel)
    return model.predict(panel).select("station_id", F.col("date").cast("string").alias("date"), "pred_pm25")


# one split on a feature with few values: the cut with the least squared error and the mean on either side
_SPLIT = """, m AS (SELECT CAST(pm25 AS DOUBLE) AS y, month(date) AS x FROM panel WHERE pm25 IS NOT NULL),
    s AS (SELECT t.x AS c, sum(y) FILTER (WHERE m.x <= t.x) AS sl, count(*) FILTER (WHERE m.x <= t.x) AS nl, sum(y) FILTER (WHERE m.x > t.x) AS sr, count(*) FILTER (WHERE m.x > t.x) AS nr
        FROM m, (SELECT DISTINCT x FROM m) t GROUP BY 1),
    b AS (SELECT * FROM s WHERE nr > 0 ORDER BY sl * sl / nl + sr * sr / nr DESC, c LIMIT 1)
    SELECT station_id, date, round(CASE WHEN month(date) <= c THEN sl / nl ELSE sr / nr END, 4) AS pred_pm25 FROM panel, b"""


def _one_split(t: Tables, make, pooled: bool = False):
    panel = t.panel().withColumn("month", F.month("date").cast("double"))
    model = regression.TargetRegressors(["pm25"], ["month"], make, pooled=pooled).fit(panel)
    return rounded(model.predict(panel).select("station_id", "date", "pred_pm25"), 4, "pred_pm25")


@query("ml_01_single_split", _SPLIT, ["panel"], text=["date"])
def _(t: Tables):
    return _one_split(t, regression.random_forest(trees=1, max_depth=1, bootstrap=False))


@query("ml_02_single_split", _SPLIT, ["panel"], text=["date"])
def _(t: Tables):
    return _one_split(t, regression.boosted_trees(rounds=1, max_depth=1, share=1.0), pooled=True)


_LINE = "SELECT regr_slope(pm25, no2) AS b, regr_intercept(pm25, no2) AS a, regr_slope(pm10, no2) AS b2, regr_intercept(pm10, no2) AS a2 FROM panel"


@query(
    "ml_03_linear_regression",
    f", f AS ({_LINE}) SELECT station_id, date, round(a + b * no2, 4) AS pred_pm25, round(a2 + b2 * no2, 4) AS pred_pm10 FROM panel, f",
    ["panel"],
    text=["date"],
)
def _(t: Tables):
    model = regression.TargetRegressors(["pm25", "pm10"], ["no2"], LINEAR).fit(t.panel())
    return rounded(model.predict(t.panel()).select("station_id", "date", "pred_pm25", "pred_pm10"), 4, "pred_pm25", "pred_pm10")


# --- gap filling and calibration -----------------------------------------------------------------
@query(
    "ml_05_fill_gaps",
    """, f AS (SELECT regr_slope(aod, temperature) AS b, regr_intercept(aod, temperature) AS a FROM stack)
    SELECT date, row, col, aod IS NULL AS was_missing, round(coalesce(aod, a + b * temperature), 5) AS aod FROM stack, f""",
    ["stack"],
    text=["date"],
)
def _(t: Tables):
    out = fields.fill_gaps(t.stack(), "aod", ["temperature"], LINEAR)
    return rounded(out.select("date", "row", "col", "was_missing", "aod"), 5, "aod")


@query("ml_05_missing_share", "SELECT round(count(*) FILTER (WHERE aod IS NULL) / CAST(count(*) AS DOUBLE), 8) AS missing_frac FROM stack", ["stack"])
def _(t: Tables):
    return rounded(fields.missing_share(t.stack(), "aod"), 8, "missing_frac")


def _fold_lines(rows: str, t: str, x: str, k: int) -> str:
    """Leave-one-fold-out straight lines: ``held`` has truth t and prediction p."""
    return f"""ln AS (SELECT f, regr_slope({t}, {x}) AS b, regr_intercept({t}, {x}) AS a FROM {rows}, range(0, {k}) r(f) WHERE fold <> f GROUP BY 1),
    held AS (SELECT {rows}.*, {t} AS t, a + b * {x} AS p FROM {rows} JOIN ln ON fold = f)"""


@query(
    "ml_06_gap_skill",
    f""", seen AS (SELECT * FROM stack WHERE aod IS NOT NULL), {_blocks('seen', '2e0', 5, 42)}, {_fold_lines('folded', 'aod', 'temperature', 5)}
    SELECT round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(t)), 5) AS cv_r2, round(sqrt(avg((t - p) * (t - p))), 5) AS cv_rmse, count(*) AS cv_n FROM held""",
    ["stack"],
)
def _(t: Tables):
    return rounded(fields.gap_skill(t.stack(), "aod", ["temperature"], LINEAR), 5, "cv_r2", "cv_rmse")


@query(
    "ml_07_column_calibration",
    """, f AS (SELECT regr_slope(no2_obs, no2) AS b, regr_intercept(no2_obs, no2) AS a FROM panel)
    SELECT date, row, col, round(a + b * no2, 4) AS no2_surface FROM stack, f""",
    ["panel", "stack"],
    text=["date"],
)
def _(t: Tables):
    cal = fields.ColumnCalibrator(["no2"], "linear").fit(t.panel())
    return rounded(cal.predict(t.stack()).select("date", "row", "col", "no2_surface"), 4, "no2_surface")


@query(
    "ml_08_calibration_report",
    """, f AS (SELECT regr_slope(no2_obs, temperature) AS b, regr_intercept(no2_obs, temperature) AS a FROM panel), p AS (SELECT no2_obs AS t, no2, a + b * temperature AS p FROM panel, f),
    r AS (SELECT 1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)) AS r2, sqrt(avg((t - p) * (t - p))) AS rmse, count(*) AS n, regr_slope(t, no2) AS s, regr_r2(t, no2) AS rr FROM p)
    SELECT round(r2, 6) AS r2, round(rmse, 5) AS rmse, n, 'linear' AS method, round(s, 6) AS raw_column_slope, round(rr, 6) AS raw_column_r2, round(r2 - rr, 4) AS r2_gain_over_raw_column FROM r""",
    ["panel"],
)
def _(t: Tables):
    rep = fields.ColumnCalibrator(["temperature"], "linear").fit(t.panel()).report(t.panel())
    rep = rounded(rounded(rep, 6, "r2", "raw_column_slope", "raw_column_r2"), 5, "rmse")
    return rounded(rep, 4, "r2_gain_over_raw_column")


@query("ml_09_calibrated_cells")
def _(t: Tables):
    cells, _report = fields.calibrate_cells(t.stack(), t.panel(), covariates=["no2", "blh", "temperature"], factory=SMALL_FOREST)
    return cells.select(F.col("date").cast("string").alias("date"), "row", "col", "no2_surface")


# --- kriging and hybrid ---------------------------------------------------------------------------
def _krige(points: str, st: str, cols: list[str]) -> str:
    w = "exp(-((q.lon - s.lon) * (q.lon - s.lon) + (q.lat - s.lat) * (q.lat - s.lat)) / 0.72e0)"
    return ", ".join(f"sum({w} * s.{c}) / (sum(CASE WHEN s.{c} IS NOT NULL THEN {w} END) + 0.01e0) AS {c}" for c in cols)


@query(
    "ml_10_krige_residuals",
    f""", st AS (SELECT lon, lat, pm25 - 20e0 AS pm25, CASE WHEN station_id % 3 <> 0 THEN o3 END AS o3 FROM
        (SELECT station_id, lon, lat, avg(pm25) AS pm25, avg(o3_obs) AS o3 FROM panel GROUP BY 1, 2, 3)),
    q AS (SELECT DISTINCT row, col, lon, lat FROM stack),
    k AS (SELECT q.row, q.col, {_krige('q', 'st', ['pm25', 'o3'])} FROM q, st s GROUP BY 1, 2)
    SELECT row, col, round(pm25, 4) AS pm25, round(o3, 4) AS o3 FROM k""",
    ["panel", "stack"],
)
def _(t: Tables):
    st = t.panel().groupBy("station_id", "lon", "lat").agg(F.avg("pm25").alias("pm25"), F.avg("o3_obs").alias("o3")).select(
        "lon", "lat", (F.col("pm25") - 20.0).alias("pm25"), F.when(F.col("station_id") % 3 != 0, F.col("o3")).alias("o3")
    )
    out = kriging.krige_residuals(t.stack(), st, ["pm25", "o3"], point_key=["row", "col"])
    return rounded(out, 4, "pm25", "o3")


@query(
    "ml_11_station_residuals",
    "SELECT station_id, round(lon, 4) AS lon, round(lat, 4) AS lat, round(avg(pm25 - no2_obs * 3e0), 4) AS pm25, round(avg(pm10 - hcho), 4) AS pm10 FROM panel GROUP BY station_id, lon, lat",
    ["panel"],
)
def _(t: Tables):
    predicted = t.panel().withColumns({"pred_pm25": F.col("no2_obs") * 3.0, "pred_pm10": F.col("hcho")})
    return rounded(kriging.station_residuals(predicted, ["pm25", "pm10"]), 4, "lon", "lat", "pm25", "pm10")


_HYBRID = f"""f AS (SELECT regr_slope(pm25, no2) AS b, regr_intercept(pm25, no2) AS a FROM train),
    st AS (SELECT station_id, lon, lat, avg(pm25 - (a + b * no2)) AS pm25 FROM train, f GROUP BY 1, 2, 3),
    q AS (SELECT DISTINCT lon, lat FROM target), k AS (SELECT q.lon, q.lat, {_krige('q', 'st', ['pm25'])} FROM q, st s GROUP BY 1, 2)"""


@query(
    "ml_12_hybrid_model",
    f""", train AS (SELECT * FROM panel), target AS (SELECT * FROM stack), {_HYBRID}
    SELECT date, row, col, round(a + b * no2 + k.pm25, 4) AS pred_pm25 FROM target JOIN k USING (lon, lat), f""",
    ["panel", "stack"],
    text=["date"],
)
def _(t: Tables):
    model = kriging.HybridModel(["pm25"], ["no2"], LINEAR).fit(t.panel())
    return rounded(model.predict(t.stack()).select("date", "row", "col", "pred_pm25"), 4, "pred_pm25")


@query(
    "ml_13_trend_versus_hybrid",
    _LAST + f""", train AS (SELECT panel.* FROM panel, cut WHERE date < c), target AS (SELECT panel.* FROM panel, cut WHERE date >= c), {_HYBRID},
    e AS (SELECT target.pm25 AS t, a + b * no2 AS p, a + b * no2 + k.pm25 AS h FROM target JOIN k USING (lon, lat), f),
    s AS ({_skill('pm25', 't', 'p')}, 'trend' AS model FROM e UNION ALL {_skill('pm25', 't', 'h')}, 'hybrid' AS model FROM e)
    SELECT target, model, r2, rmse, mae, n, 0.86e0 AS benchmark_r2 FROM s""",
    ["panel"],
)
def _(t: Tables):
    flagged = splits.last_dates(t.panel(), 0.2)
    out = kriging.trend_versus_hybrid(flagged.where(~F.col("is_test")), flagged.where("is_test"), ["pm25"], ["no2"], LINEAR)
    return _skill_rounded(out)


# --- validation schemes -----------------------------------------------------------------------------
def _one_line(name: str, where_train: str, where_test: str, source: str) -> str:
    return f"""{name}_f AS (SELECT regr_slope(pm25, no2) AS b, regr_intercept(pm25, no2) AS a FROM {source} WHERE {where_train}),
    {name}_h AS (SELECT pm25 AS t, a + b * no2 AS p FROM {source}, {name}_f WHERE {where_test})"""


@query(
    "ml_19_compare_schemes",
    _LAST + f""", {_blocks('panel', '2e0', 5, 42)}, rnd AS (SELECT *, {_hash(_ROWKEY, '0')} % 1000000 < 200000 AS test FROM panel), tmp AS (SELECT *, date >= c AS test FROM panel, cut),
    {_one_line('random', 'NOT test', 'test', 'rnd')}, {_one_line('spatial', 'fold <> 0', 'fold = 0', 'folded')}, {_one_line('temporal', 'NOT test', 'test', 'tmp')}
    {' UNION ALL '.join(f"{_skill('pm25', 't', 'p')}, '{n}' AS scheme FROM {n}_h" for n in ('random', 'spatial', 'temporal'))}""",
    ["panel"],
)
def _(t: Tables):
    return _skill_rounded(fields.compare_schemes(t.panel(), "pm25", ["no2"], _key(), LINEAR))


@query(
    "ml_20_dual_validation",
    f""", rf AS (SELECT *, CAST({_hash(_ROWKEY, '0')} % 5 AS INT) AS fold FROM panel WHERE pm25 IS NOT NULL), {_fold_lines('rf', 'pm25', 'no2', 5)}, {_blocks('panel', '2e0', 5, 42)},
    ln2 AS (SELECT f, regr_slope(pm25, no2) AS b, regr_intercept(pm25, no2) AS a FROM folded, range(0, 5) r(f) WHERE fold <> f GROUP BY 1), held2 AS (SELECT pm25 AS t, a + b * no2 AS p FROM folded JOIN ln2 ON fold = f),
    st AS (SELECT count(DISTINCT station_id) AS stations FROM panel WHERE pm25 IS NOT NULL)
    SELECT *, (SELECT stations FROM st) AS stations FROM ({_skill('pm25', 't', 'p')}, 'random_cv' AS scheme FROM held UNION ALL {_skill('pm25', 't', 'p')}, 'spatial_cv' AS scheme FROM held2) WHERE (SELECT stations FROM st) >= 12""",
    ["panel"],
)
def _(t: Tables):
    return _skill_rounded(fields.dual_validation(t.panel(), ["pm25"], ["no2"], _key(), LINEAR))


@query(
    "ml_18_group_validation",
    f""", gf AS (SELECT *, CAST({_hash('CAST(station_id AS VARCHAR)', '0')} % 5 AS INT) AS fold FROM panel), {_fold_lines('gf', 'pm25', 'no2', 5)}
    {_skill('pm25', 't', 'p')}, fold FROM held GROUP BY fold""",
    ["panel"],
)
def _(t: Tables):
    return _skill_rounded(fields.group_validation(t.panel(), "pm25", ["no2"], LINEAR))


@query(
    "ml_21_predict_cells",
    """, f AS (SELECT regr_slope(pm25, r) AS b, regr_intercept(pm25, r) AS a FROM (SELECT pm25, hcho / (no2 + 1e-30) AS r FROM panel))
    SELECT date, row, col, round(a + b * (hcho / (no2 + 1e-30)), 4) AS pred_pm25 FROM stack, f""",
    ["panel", "stack"],
    text=["date"],
)
def _(t: Tables):
    from hazegrid.operators.features import engineer

    model = regression.TargetRegressors(["pm25"], ["fnr"], LINEAR).fit(engineer(t.panel()))
    return rounded(fields.predict_cells(t.stack(), model).select("date", "row", "col", "pred_pm25"), 4, "pred_pm25")


@query("ml_22_importances")
def _(t: Tables):
    model = regression.TargetRegressors(["pm25"], ["no2", "aod", "hcho", "blh"], SMALL_FOREST).fit(t.panel())
    return regression.importances(model, "pm25", t.spark, top=3)


# --- sources and sinks --------------------------------------------------------------------------------
def _folder(t: Tables, label: str) -> str:
    return f"{scratch_root(t.spark)}/{t.spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@query("src_01_station_metadata", "SELECT station_id, name, lat, lon FROM stations", ["stations"])
def _(t: Tables):
    path = _folder(t, "meta")
    raw = t.stations().select(F.col("station_id").alias(" Station ID "), F.col("name").alias("Name"), F.col("lat").alias("LAT"), F.col("lon").alias(" Lon"))
    tables.write_csv(raw, path)
    return stations.station_metadata(t.spark, path).select(F.col("station_id").cast("bigint").alias("station_id"), "name", "lat", "lon")


@query(
    "src_02_raw_measurements",
    "SELECT event_id, ts AS datetime, CASE WHEN event_type = 'click' THEN value END AS pm25, CASE WHEN event_type = 'view' THEN value WHEN event_type = 'error' THEN value + 1 END AS o3 FROM events",
    text=["datetime"],
)
def _(t: Tables):
    path = _folder(t, "raw")

    def when(kind: str, add: float = 0.0):
        return F.when(F.col("event_type") == kind, F.col("value") + add)

    ev = t.table("events").select("event_id", F.col("ts").cast("string").alias(" datetime"), when("click").alias(" PM2.5 "), when("view").alias("Ozone"), when("error", 1.0).alias("O3"))
    tables.write_csv(ev, path)
    return stations.raw_measurements(t.spark, path).select(F.col("event_id").cast("bigint").alias("event_id"), "datetime", "pm25", "o3")


@query(
    "src_03_station_folder",
    """SELECT CAST(m.station_id AS VARCHAR) AS station_id, datetime, pm25, no2, o3, co, pm10, lat FROM (SELECT user_id % 4 AS station_id, ts AS datetime, CASE WHEN event_type = 'click' THEN value END AS pm25, CASE WHEN event_type = 'error' THEN value END AS no2,
        CASE WHEN event_type = 'view' THEN value END AS o3, CASE WHEN event_type = 'purchase' THEN value END AS co, CASE WHEN event_type = 'signup' THEN value END AS pm10 FROM events) m LEFT JOIN stations s ON m.station_id = s.station_id""",
    ["stations"],
    text=["datetime"],
)
def _(t: Tables):
    root = _folder(t, "folder")
    ev = t.table("events").withColumn("station_id", F.col("user_id") % 4)
    for kind, header in (("click", "PM2.5"), ("error", "NO2"), ("view", "Ozone"), ("purchase", "CO"), ("signup", "PM10")):
        part = ev.where(F.col("event_type") == kind).select("station_id", F.col("ts").cast("string").alias("datetime"), F.col("value").alias(header))
        part.write.option("header", True).csv(f"{root}/{kind}")
    t.stations().coalesce(1).write.option("header", True).csv(f"{root}/meta_raw")
    t.fires().write.option("header", True).csv(f"{root}/firms_raw")
    _rename_parts(t.spark, f"{root}/meta_raw", f"{root}/station_list.csv")
    _rename_parts(t.spark, f"{root}/firms_raw", f"{root}/FIRMS_points.csv")
    meta, measured = stations.station_folder(t.spark, root)
    out = measured.join(meta.select("station_id", "lat"), "station_id", "left")
    return out.select("station_id", "datetime", "pm25", "no2", "o3", "co", "pm10", "lat")


def _rename_parts(spark, folder: str, target: str) -> None:
    """Give the files of a CSV folder names of their own: ``target``, with a number before its ending from the second on."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for i, status in enumerate(fs.globStatus(path(f"{folder}/part-*"))):
        fs.rename(status.getPath(), path(target.replace(".csv", f"_{i}.csv") if i else target))
    fs.delete(path(folder), True)


@query("src_04_fire_points", "SELECT round(latitude, 4) AS latitude, round(longitude, 4) AS longitude, frp, 'n' AS confidence, acq_date FROM fires", ["fires"], text=["acq_date"])
def _(t: Tables):
    path = _folder(t, "fires")
    tables.write_csv(t.fires().select("acq_date", "latitude", "longitude", "frp", F.lit("n").alias("confidence"), F.lit(7).alias("scan")), path)
    out = stations.fire_points(t.spark, path).select("latitude", "longitude", "frp", "confidence", "acq_date")
    return rounded(out, 4, "latitude", "longitude")


@query(
    "src_05_archive_measurements",
    """WITH e AS (SELECT user_id % 3 AS loc, CAST(ts AS DATE) AS d, ts, event_type AS parameter, value FROM events),
    n AS (SELECT loc, d, row_number() OVER (PARTITION BY loc ORDER BY d) - 1 AS i FROM (SELECT DISTINCT loc, d FROM e))
    SELECT CAST(e.loc AS VARCHAR) AS location_id, ts AS datetime, parameter, value FROM e JOIN n ON e.loc = n.loc AND e.d = n.d WHERE i % 3 = 0""",
    text=["datetime"],
)
def _(t: Tables):
    root = _folder(t, "archive")
    ev = t.table("events").select(
        (F.col("user_id") % 3).alias("locationid"), F.date_format("ts", "yyyy").alias("year"), F.date_format("ts", "MM").alias("month"), F.date_format("ts", "dd").alias("day"),
        F.col("ts").cast("string").alias("datetime"), F.col("event_type").alias("parameter"), "value",
    )
    # one file per location and day, as the archive has
    ev.repartition("locationid", "day").write.partitionBy("locationid", "year", "month", "day").option("header", True).option("compression", "gzip").csv(root)
    return stations.archive_measurements(t.spark, root, 2024, [1], 3)


@query(
    "src_05_whole_archive",
    "SELECT CAST(user_id % 3 AS VARCHAR) AS location_id, ts AS datetime, event_type AS parameter, value FROM events WHERE year(ts) = 2024 AND month(ts) = 1",
    text=["datetime"],
)
def _(t: Tables):
    root = _folder(t, "archive")
    ev = t.table("events").select(
        (F.col("user_id") % 3).alias("locationid"), F.date_format("ts", "yyyy").alias("year"), F.date_format("ts", "MM").alias("month"),
        F.col("ts").cast("string").alias("datetime"), F.col("event_type").alias("parameter"), "value",
    )
    ev.repartition("locationid", "month").write.partitionBy("locationid", "year", "month").option("header", True).option("compression", "gzip").csv(root)
    return stations.archive_measurements(t.spark, root, 2024, [1])


@query("src_06_column_subset", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(t: Tables):
    return tables.read_table(t.spark, f"{t.sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query(
    "src_07_layer_catalogue",
    """WITH n AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 6 AS k FROM orders)
    SELECT o_orderkey, CASE WHEN k IN (0, 1, 2, 3) THEN d END AS start_date, CASE k WHEN 0 THEN 's5p' WHEN 1 THEN 'era5' WHEN 2 THEN 'modis_burned' WHEN 3 THEN 'insat' WHEN 4 THEN 'srtm' END AS family,
    CASE k WHEN 0 THEN 'no2' WHEN 2 THEN 'burned' WHEN 3 THEN 'aod' END AS variable, k = 4 AS is_static FROM n""",
    text=["start_date"],
)
def _(t: Tables):
    d, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 6
    tail = F.concat(d, F.lit("_2030-01-01.tif"))
    name = (
        F.when(k == 0, F.concat(F.lit("s5p_no2_"), tail)).when(k == 1, F.concat(F.lit("era5_"), tail)).when(k == 2, F.concat(F.lit("modis_burned_"), tail))
        .when(k == 3, F.concat(F.lit("insat_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".h5"))).when(k == 4, F.lit("srtm_terrain.tif")).otherwise(F.concat(F.lit("other_"), tail))
    )
    out = stations.layer_catalogue(t.table("orders").select("o_orderkey", name.alias("name")))
    out = out.withColumn("start_date", F.when(F.col("family").isNotNull(), F.col("start_date")))
    return out.select("o_orderkey", "start_date", "family", "variable", "is_static")


@query(
    "src_08_extraction_table",
    """SELECT round(lon, 3) AS lon, round(lat, 3) AS lat, date, round(avg(frp), 4) AS frp FROM (SELECT round(longitude, 3) AS lon, round(latitude, 3) AS lat, acq_date AS date, frp FROM fires) GROUP BY 1, 2, 3""",
    ["fires"],
    text=["date"],
)
def _(t: Tables):
    rows = t.fires().select("longitude", "latitude", (F.unix_millis(F.col("acq_date").cast("timestamp")) + 3_600_000).alias("time"), F.col("frp").cast("string").alias("frp"))
    return rounded(rounded(stations.extraction_table(rows, ["frp"]), 4, "frp"), 3, "lon", "lat")


@query("snk_01_partitioned_table", "SELECT station_id, date, round(pm25, 3) AS pm25, CAST(month(date) AS INT) AS month FROM panel WHERE date >= DATE '1996-03-05' AND date < DATE '1996-06-20'", ["panel"], text=["date"])
def _(t: Tables):
    path = _folder(t, "table")
    tables.write_partitioned(tables.add_partition_columns(t.panel()), path)
    out = tables.read_months(t.spark, path, "1996-03-05", "1996-06-20", ["station_id", "date", "pm25", "month"])
    return rounded(out, 3, "pm25")


@query("snk_02_csv_table", "SELECT place_id, round(lon, 4) AS lon, n_cells FROM places", ["places"])
def _(t: Tables):
    path = _folder(t, "csv")
    tables.write_csv(t.places(), path)
    out = t.spark.read.schema(t.places().schema).option("header", True).csv(path)
    return rounded(out.select("place_id", "lon", "n_cells"), 4, "lon")


@query(
    "snk_03_frames_json",
    """SELECT date, CAST(count(*) AS BIGINT) AS cells, CAST(sum(CAST(floor(no2) AS BIGINT)) AS BIGINT) AS total FROM stack GROUP BY 1""",
    ["stack"],
    text=["date"],
)
def _(t: Tables):
    path = _folder(t, "json")
    cells = t.stack().select("date", "lon", "lat", F.floor("no2").cast("int").alias("aqi"), F.floor("hcho").cast("int").alias("rapi"))
    documents.write_json_lines(layers.frames_json(cells), path)
    parsed = t.spark.read.schema("date string, key array<string>, cells array<array<double>>").json(path)
    return parsed.groupBy("date").agg(
        F.sum(F.size("cells")).cast("bigint").alias("cells"),
        F.sum(F.aggregate("cells", F.lit(0.0), lambda a, c: a + c[2])).cast("bigint").alias("total"),
    )


@query(
    "snk_04_report_json",
    f"""SELECT json_extract_string(CAST(j AS VARCHAR), '$.n') AS n, k AS target FROM (SELECT 'pm25' AS k, json_object('n', count(pm25)) AS j FROM panel UNION ALL SELECT 'pm10', json_object('n', count(pm10)) FROM panel)""",
    ["panel"],
)
def _(t: Tables):
    path = _folder(t, "report")
    scores = metrics.score(t.panel(), {"pm25": ("pm25", "no2_obs"), "pm10": ("pm10", "pm25")})
    documents.write_json_lines(layers.metrics_json(scores), path)
    doc = t.spark.read.text(path)
    report = F.from_json("value", "map<string, struct<r2: double, rmse: double, mae: double, n: bigint>>")
    return doc.select(F.explode(report).alias("target", "s")).select("target", F.col("s.n").cast("string").alias("n"))


@query(
    "snk_04_report_by_scheme",
    """, p AS (SELECT 'station' AS scheme, pm25 AS t, no2_obs AS p FROM panel UNION ALL SELECT 'gas', pm25, pm10 FROM panel)
    SELECT scheme, count(*) AS n, round(avg(abs(p - t)), 4) AS mae, round(sqrt(avg((p - t) * (p - t))), 4) AS rmse FROM p WHERE p IS NOT NULL AND t IS NOT NULL GROUP BY 1""",
    ["panel"],
)
def _(t: Tables):
    path = _folder(t, "schemes")
    parts = [metrics.score(t.panel(), {"pm25": ("pm25", other)}).withColumn("scheme", F.lit(name)) for name, other in (("station", "no2_obs"), ("gas", "pm10"))]
    scores = parts[0].unionByName(parts[1]).withColumnRenamed("n", "n_pairs")
    documents.write_json_lines(layers.metrics_json(scores, scheme_col="scheme"), path)
    kinds = "map<string, struct<schemes: map<string, struct<rmse: double, mae: double, n_pairs: bigint>>>>"
    found = t.spark.read.text(path).select(F.explode(F.from_json("value", kinds)).alias("target", "v")).select(F.explode("v.schemes").alias("scheme", "s"))
    return rounded(found.select("scheme", F.col("s.n_pairs").alias("n"), F.col("s.mae").alias("mae"), F.col("s.rmse").alias("rmse")), 4, "mae", "rmse")


@query(
    "snk_05_saved_model",
    f", f AS ({_LINE}) SELECT station_id, date, round(a + b * no2, 4) AS pred_pm25 FROM panel, f",
    ["panel"],
    text=["date"],
)
def _(t: Tables):
    path = _folder(t, "model")
    regression.TargetRegressors(["pm25"], ["no2"], LINEAR).fit(t.panel()).save(path, t.spark)
    model = regression.TargetRegressors.load(path, t.spark)
    return rounded(model.predict(t.panel()).select("station_id", "date", "pred_pm25"), 4, "pred_pm25")


@query(
    "snk_06_inference_table",
    "SELECT date, row, col, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, round(CAST(CAST(aod AS REAL) AS DOUBLE), 4) AS aod, CAST(frp_mean AS DOUBLE) AS frp_mean FROM stack WHERE aod IS NOT NULL OR frp_mean IS NOT NULL",
    ["stack"],
    text=["date"],
)
def _(t: Tables):
    out = tables.inference_table(t.stack().select("date", "row", "col", "lat", "lon", "aod", "frp_mean"))
    return rounded(out.select("date", "row", "col", "year", "month", F.col("aod").cast("double").alias("aod"), F.col("frp_mean").cast("double").alias("frp_mean")), 4, "aod")


@query(
    "snk_07_stored_types",
    "SELECT station_id, date, CAST(CAST(pm25 AS REAL) AS DOUBLE) AS pm25, CAST(CAST(aod AS REAL) AS DOUBLE) AS aod, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month FROM panel",
    ["panel"],
    text=["date"],
)
def _(t: Tables):
    out = tables.training_table(t.panel())
    return out.select("station_id", "date", F.col("pm25").cast("double").alias("pm25"), F.col("aod").cast("double").alias("aod"), "year", "month")
