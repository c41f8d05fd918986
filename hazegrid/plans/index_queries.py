"""Index, calendar, screening and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid import constants as K
from hazegrid.functions import index as ix
from hazegrid.operators import features, layers, qa, temporal
from hazegrid.plans import sqltext as S
from hazegrid.plans.registry import query, rnd, rounded
from hazegrid.plans.views import PARAMETERS, Tables

FIVE = ("pm25", "pm10", "no2", "o3", "co")
SIX = K.DEFAULT_POLLUTANTS
_SIX_SI = S.si_select({p: p for p in SIX})
_ALL = {p: p for p in SIX}


# --- flagship and daily values --------------------------------------------------------------
@query(
    "flagship_station_index",
    f""", {S.daily('obs_wide')}, si AS (SELECT *, {S.si_select({p: p for p in FIVE})} FROM daily),
    idx AS (SELECT *, {S.aqi(FIVE)} AS aqi, {S.dominant(FIVE)} AS aqi_dominant FROM si)
    SELECT station_id, date, round(pm25, 4) AS pm25, round(o3, 4) AS o3, round(co, 4) AS co, round(aqi, 4) AS aqi,
    aqi_dominant, {S.category('aqi')} AS aqi_category FROM idx""",
    ["obs_long", "obs_wide"],
    text=["date"],
)
def _(t: Tables):
    wide = temporal.pivot_measurements(t.obs_long(), PARAMETERS)
    daily = temporal.daily_values(wide, unique_times=True)
    out = layers.add_index(daily, FIVE)
    return rounded(
        out.select("station_id", "date", "pm25", "o3", "co", "aqi", "aqi_dominant", "aqi_category"), 4, "pm25", "o3", "co", "aqi"
    )


@query(
    "tm_07_pivot_measurements",
    "SELECT station_id, datetime, round(pm25, 6) AS pm25, round(pm10, 6) AS pm10, round(no2, 6) AS no2, round(o3, 6) AS o3, "
    "round(co, 6) AS co FROM obs_many_wide",
    ["obs_many_long", "obs_many_wide"],
    text=["datetime"],
)
def _(t: Tables):
    return rounded(temporal.pivot_measurements(t.obs_long(2**40), PARAMETERS), 6, *PARAMETERS)


_DAILY_OUT = ", ".join(f"round({c}, 4) AS {c}" for c in FIVE)


_TWICE = ", twice AS (" + " UNION ALL ".join(f"SELECT station_id, datetime, {', '.join(f'{c} {d} AS {c}' for c in PARAMETERS)} FROM obs12_wide" for d in ("- 0.5e0", "+ 0.5e0")) + ")"


@query("tm_05_daily_values_gate", f"{_TWICE}, {S.daily('twice')} SELECT station_id, date, {_DAILY_OUT} FROM daily", ["obs12_long", "obs12_wide"], text=["date"])
def _(t: Tables):
    # every instant comes twice, once higher and once lower
    wide = temporal.pivot_measurements(t.obs_long(12), PARAMETERS)
    moved = [wide.withColumns({c: F.col(c) + F.lit(d) for c in PARAMETERS}) for d in (-0.5, 0.5)]
    return rounded(temporal.daily_values(moved[0].union(moved[1])), 4, *FIVE)


@query("tm_05_daily_values_pass_through", f", {S.daily('obs_many_wide')} SELECT station_id, date, {_DAILY_OUT} FROM daily", ["obs_many_long", "obs_many_wide"], text=["date"])
def _(t: Tables):
    wide = temporal.pivot_measurements(t.obs_long(2**40), PARAMETERS)
    return rounded(temporal.daily_values(wide, unique_times=True), 4, *FIVE)


@query(
    "tm_06_eight_hour_peak",
    f", {S.daily('obs_wide')} SELECT station_id, date, round(o3, 4) AS o3, round(co, 4) AS co FROM daily",
    ["obs_long", "obs_wide"],
    text=["date"],
)
def _(t: Tables):
    wide = temporal.pivot_measurements(t.obs_long(), PARAMETERS)
    return rounded(temporal.daily_values(wide, unique_times=True).select("station_id", "date", "o3", "co"), 4, "o3", "co")


@query(
    "tm_08_station_season_mean",
    f""", {S.daily('obs_many_wide')} SELECT station_id, round(avg(pm25), 4) AS pm25, round(avg(pm10), 4) AS pm10,
    round(avg(no2), 4) AS no2_obs, round(avg(o3), 4) AS o3_obs, round(avg(co), 4) AS co_obs FROM daily GROUP BY 1""",
    ["obs_many_long", "obs_many_wide"],
)
def _(t: Tables):
    wide = temporal.pivot_measurements(t.obs_long(2**40), PARAMETERS)
    out = temporal.station_season_mean(temporal.daily_values(wide, unique_times=True))
    return rounded(out, 4, "pm25", "pm10", "no2_obs", "o3_obs", "co_obs")


@query("tm_12_calendar_day", "SELECT event_id, CAST(ts AS DATE) AS date FROM events", text=["date"])
def _(t: Tables):
    return t.table("events").select("event_id", temporal.as_day(F.col("ts")).alias("date"))


# --- composites ---------------------------------------------------------------------------
_COMP = "round(avg(aod), 6) AS aod, round(avg(no2), 4) AS no2, round(avg(hcho), 4) AS hcho"
_V = ("aod", "no2", "hcho")


def _round_stack(df):
    return rounded(rounded(df, 6, "aod"), 4, "no2", "hcho")


@query(
    "tm_01_daily_mean",
    "SELECT CAST(ts AS DATE) AS date, row, col, round(avg(value), 4) AS value FROM pix GROUP BY 1, 2, 3",
    ["pix"],
    text=["date"],
)
def _(t: Tables):
    return rounded(temporal.daily_mean(t.pix(), ["value"], "ts"), 4, "value")


@query(
    "tm_02_monthly_mean",
    "SELECT CAST(date_trunc('month', date) AS DATE) AS date, row, col, round(avg(value), 4) AS value FROM pix GROUP BY 1, 2, 3",
    ["pix"],
    text=["date"],
)
def _(t: Tables):
    return rounded(temporal.monthly_mean(t.pix(), ["value"]), 4, "value")


@query("tm_03_annual_mean", f"SELECT CAST(date_trunc('year', date) AS DATE) AS date, row, col, {_COMP} FROM stack GROUP BY 1, 2, 3", ["stack"], text=["date"])
def _(t: Tables):
    return _round_stack(temporal.annual_mean(t.stack(), _V))


@query("tm_04_seasonal_mean", f"SELECT {S.season('date')} AS season, row, col, {_COMP} FROM stack GROUP BY 1, 2, 3", ["stack"])
def _(t: Tables):
    return _round_stack(temporal.seasonal_mean(t.stack(), _V))


@query(
    "tm_04_seasonal_mean_by_year",
    f"SELECT {S.season('date')} AS season, CAST(year(date) AS INT) AS season_year, row, col, {_COMP} FROM stack GROUP BY 1, 2, 3, 4",
    ["stack"],
)
def _(t: Tables):
    return _round_stack(temporal.seasonal_mean(t.stack(), _V, by_year=True))


_BURN = """, axis AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t_idx, p FROM (SELECT date, avg(frp_mean) AS p FROM stack GROUP BY 1)),
    peak AS (SELECT t_idx AS pk FROM axis ORDER BY p DESC NULLS LAST, t_idx LIMIT 1),
    burn AS (SELECT date, CAST(t_idx AS INT) AS t_idx, CAST(pk AS INT) AS peak_idx FROM axis, peak WHERE t_idx BETWEEN pk - 5 AND pk + 5)"""


@query("tm_09_burning_window", _BURN + " SELECT * FROM burn", ["stack"], text=["date"])
def _(t: Tables):
    return temporal.burning_window(t.stack())


@query(
    "tm_10_burning_composite",
    _BURN + """ SELECT row, col, round(avg(CASE WHEN burn.date IS NOT NULL THEN hcho END), 4) AS hcho_burning,
    max(CASE WHEN burn.date IS NOT NULL THEN frp_mean END) AS frp_burning, round(avg(hcho), 4) AS hcho_season
    FROM stack LEFT JOIN burn ON stack.date = burn.date GROUP BY 1, 2""",
    ["stack"],
)
def _(t: Tables):
    return rounded(temporal.burning_composite(t.stack()), 4, "hcho_burning", "hcho_season")


_FRAMES = """, days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t_idx FROM (SELECT DISTINCT date FROM stack)),
    last AS (SELECT max(t_idx) AS n FROM days),
    picks AS (SELECT DISTINCT CASE WHEN i = 7 THEN n ELSE CAST(floor(i * (CAST(n AS DOUBLE) / 7e0)) AS BIGINT) END AS t_idx
              FROM last, range(0, 8) r(i)),
    frames AS (SELECT date, CAST(t_idx AS INT) AS t_idx FROM days WHERE t_idx IN (SELECT t_idx FROM picks))"""


@query("tm_11_frame_selection", _FRAMES + " SELECT * FROM frames", ["stack"], text=["date"])
def _(t: Tables):
    return temporal.evenly_spaced_frames(t.stack())


# --- index --------------------------------------------------------------------------------
@query(
    "aq_01_sub_index",
    f"SELECT l_orderkey, l_linenumber, {', '.join(f'round({S.sub_index(p, p)}, 4) AS si_{p}' for p in SIX)} FROM conc",
    ["conc"],
)
def _(t: Tables):
    si = layers.sub_indices(SIX)
    return t.conc().select("l_orderkey", "l_linenumber", *[rnd(e, 4).alias(f"si_{p}") for p, e in si.items()])


_EIGHT = {"pm25": "pm25", "pm10": "pm10", "no2": "no2", "so2": "so2", "co": "co", "o3": "o3", "nh3": "no2", "pb": "co / 9e0"}


@query(
    "aq_02_sub_index_map",
    f""", si AS (SELECT l_orderkey, l_linenumber, {', '.join(f'{S.sub_index(f"({c})", p)} AS si_{p}' for p, c in _EIGHT.items())} FROM conc)
    SELECT l_orderkey, l_linenumber, {' + '.join(f'CAST(si_{p} IS NOT NULL AS INT)' for p in _EIGHT)} AS n_valid,
    round(si_nh3, 4) AS nh3, round(si_pb, 4) AS pb, round(si_so2, 4) AS so2 FROM si""",
    ["conc"],
)
def _(t: Tables):
    conc = {p: F.col(p) for p in SIX} | {"nh3": F.col("no2"), "pb": F.col("co") / 9.0}
    made = t.conc().withColumn("m", ix.sub_index_map(conc))
    pick = {p: rnd(F.try_element_at("m", F.lit(p)), 4).alias(p) for p in ("nh3", "pb", "so2")}
    return made.select("l_orderkey", "l_linenumber", F.size("m").alias("n_valid"), *pick.values())


@query(
    "aq_03_overall_index",
    f""", si AS (SELECT l_orderkey, l_linenumber, {_SIX_SI} FROM conc)
    SELECT l_orderkey, l_linenumber, round({S.aqi(SIX)}, 4) AS aqi, {S.dominant(SIX)} AS dominant FROM si""",
    ["conc"],
)
def _(t: Tables):
    si = layers.sub_indices(SIX)
    return t.conc().select(
        "l_orderkey", "l_linenumber", rnd(ix.overall_index(si), 4).alias("aqi"), ix.dominant_pollutant(si).alias("dominant")
    )


@query(
    "aq_04_category_colour",
    f""", si AS (SELECT l_orderkey, l_linenumber, {S.sub_index('pm25', 'pm25')} AS v FROM conc)
    SELECT l_orderkey, l_linenumber, {S.category('v')} AS category, {S.category('v', pick=3)} AS colour,
    {S.category('v', strict=True)} AS strict_category FROM si""",
    ["conc"],
)
def _(t: Tables):
    v = ix.sub_index(F.col("pm25"), "pm25")
    return t.conc().withColumn("v", v).select(
        "l_orderkey", "l_linenumber", ix.category(F.col("v")).alias("category"), ix.colour(F.col("v")).alias("colour"),
        ix.category(F.col("v"), strict_bands=True).alias("strict_category"),
    )


@query(
    "aq_05_index_frame",
    f""", si AS (SELECT l_orderkey, l_linenumber, {_SIX_SI} FROM conc),
    a AS (SELECT l_orderkey, l_linenumber, {S.aqi(SIX)} AS aqi, {S.dominant(SIX)} AS aqi_dominant FROM si)
    SELECT l_orderkey, l_linenumber, round(aqi, 4) AS aqi, aqi_dominant, {S.category('aqi')} AS aqi_category FROM a""",
    ["conc"],
)
def _(t: Tables):
    renamed = t.conc().withColumnsRenamed({p: f"{p}_ugm3" for p in SIX})
    out = layers.add_index(renamed, {p: f"{p}_ugm3" for p in SIX})
    return rounded(out.select("l_orderkey", "l_linenumber", "aqi", "aqi_dominant", "aqi_category"), 4, "aqi")


_LIST = """, si AS (SELECT l_orderkey, l_linenumber, list_filter([{vals}], lambda x: x IS NOT NULL AND x > 0) AS v FROM conc),
    s AS (SELECT *, list_sum(v) AS total, len(v) AS n, list_max(v) AS top FROM si),
    e AS (SELECT *, list_sum([-(x / total) * ln(x / total + 1e-12) FOR x IN v]) AS ent FROM s)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN n > 0 THEN top * (1e0 + (total / n / top) *
    (CASE WHEN n > 1 THEN ent / ln(CAST(n AS DOUBLE)) ELSE 0e0 END)) END, 4) AS rapi FROM e"""


@query("aq_06_entropy_index_list", _LIST.format(vals=", ".join(S.sub_index(p, p) for p in SIX)), ["conc"])
def _(t: Tables):
    values = F.array(*layers.sub_indices(SIX).values())
    return t.conc().withColumn("v", values).select(
        "l_orderkey", "l_linenumber", rnd(ix.entropy_index(F.col("v")), 4).alias("rapi")
    )


@query(
    "aq_07_entropy_index_cells",
    f""", si AS (SELECT l_orderkey, l_linenumber, {_SIX_SI} FROM conc)
    SELECT l_orderkey, l_linenumber, round({S.rapi(SIX)}, 4) AS rapi FROM si""",
    ["conc"],
)
def _(t: Tables):
    return rounded(layers.add_dual_index(t.conc(), SIX).select("l_orderkey", "l_linenumber", "rapi"), 4, "rapi")


_DUAL = f"""si AS (SELECT *, {_SIX_SI} FROM conc),
    dual AS (SELECT *, {S.aqi(SIX)} AS cpcb, {S.rapi(SIX)} AS rapi, {S.dominant(SIX)} AS dominant FROM si)"""


@query(
    "aq_08_dual_index",
    f", {_DUAL} SELECT l_orderkey, l_linenumber, round(cpcb, 4) AS cpcb, round(rapi, 4) AS rapi, dominant, round(rapi - cpcb, 4) AS divergence FROM dual",
    ["conc"],
)
def _(t: Tables):
    out = layers.add_dual_index(t.conc(), SIX)
    return rounded(out.select("l_orderkey", "l_linenumber", "cpcb", "rapi", "dominant", "divergence"), 4, "cpcb", "rapi", "divergence")


@query(
    "aq_09_category_histogram",
    f", {_DUAL} SELECT {S.category('cpcb')} AS category, count(*) AS cells FROM dual WHERE cpcb IS NOT NULL GROUP BY 1",
    ["conc"],
)
def _(t: Tables):
    return layers.category_histogram(layers.add_dual_index(t.conc(), SIX))


@query(
    "aq_09_index_summary",
    f""", {_DUAL} SELECT round(avg(cpcb), 4) AS cpcb_mean, round(max(cpcb), 4) AS cpcb_max, round(avg(rapi), 4) AS rapi_mean,
    round(max(rapi), 4) AS rapi_max, round(avg(rapi - cpcb), 4) AS divergence_mean, count(cpcb) AS valid_cells FROM dual""",
    ["conc"],
)
def _(t: Tables):
    out = layers.index_summary(layers.add_dual_index(t.conc(), SIX))
    return rounded(out, 4, "cpcb_mean", "cpcb_max", "rapi_mean", "rapi_max", "divergence_mean")


@query(
    "aq_10_seasonal_index",
    f""", m AS (SELECT l_partkey, {', '.join(f'avg({p}) AS {p}' for p in SIX)} FROM conc GROUP BY 1),
    si AS (SELECT *, {_SIX_SI} FROM m)
    SELECT l_partkey, round({S.aqi(SIX)}, 4) AS cpcb, round({S.rapi(SIX)}, 4) AS rapi FROM si""",
    ["conc"],
)
def _(t: Tables):
    out = layers.seasonal_index(t.conc().drop("l_orderkey", "l_linenumber"), _ALL, keys=["l_partkey"])
    return rounded(out.select("l_partkey", "cpcb", "rapi"), 4, "cpcb", "rapi")


# --- screening ------------------------------------------------------------------------------
_RANGE_STACK = "stack"


@query(
    "qa_01_range_clip",
    """SELECT date, row, col, CASE WHEN t - 20e0 BETWEEN 220 AND 330 THEN t - 20e0 END AS temperature,
    CASE WHEN a BETWEEN 0 AND 5 THEN a END AS aod, CASE WHEN pm BETWEEN 0 AND 1000 THEN pm END AS pm25
    FROM (SELECT date, row, col, temperature * 1.25e0 - 30e0 AS t, aod * 8e0 AS a, hcho * 30e0 - 100e0 AS pm FROM stack)""",
    ["stack"],
    text=["date"],
)
def _(t: Tables):
    raw = t.stack().select(
        "date", "row", "col", (F.col("temperature") * 1.25 - 30.0 - 20.0).alias("temperature"), (F.col("aod") * 8.0).alias("aod"),
        (F.col("hcho") * 30.0 - 100.0).alias("pm25"),
    )
    return qa.clip_to_range(raw)


@query(
    "qa_02_unit_plausibility",
    """, g AS (SELECT date, row, col, no2 * 1e-4 - 1e-3 AS no2, no2 * 1e15 - 5e15 AS co, hcho * 1e15 - 2e16 AS hcho, aod - 0.3e0 AS o3 FROM stack),
    m AS (SELECT quantile_cont(abs(no2), 0.5) AS no2, quantile_cont(abs(co), 0.5) AS co, quantile_cont(abs(hcho), 0.5) AS hcho,
          quantile_cont(abs(o3), 0.5) AS o3 FROM g)
    SELECT date, row, col,
    CASE WHEN m.no2 <= 5e-3 * 100 THEN CASE WHEN g.no2 BETWEEN 0 AND 5e-3 THEN g.no2 END ELSE CASE WHEN g.no2 >= 0 THEN g.no2 END END AS no2,
    CASE WHEN m.co <= 100 THEN CASE WHEN g.co BETWEEN 0 AND 1 THEN g.co END ELSE CASE WHEN g.co >= 0 THEN g.co END END AS co,
    CASE WHEN m.hcho <= 5e-3 * 100 THEN CASE WHEN g.hcho BETWEEN -1e-4 AND 5e-3 THEN g.hcho END ELSE g.hcho END AS hcho,
    CASE WHEN m.o3 <= 100 THEN CASE WHEN g.o3 BETWEEN 0 AND 1 THEN g.o3 END ELSE CASE WHEN g.o3 >= 0 THEN g.o3 END END AS o3
    FROM g, m""",
    ["stack"],
    text=["date"],
)
def _(t: Tables):
    raw = t.stack().select(
        "date", "row", "col", (F.col("no2") * 1e-4 - 1e-3).alias("no2"), (F.col("no2") * 1e15 - 5e15).alias("co"),
        (F.col("hcho") * 1e15 - 2e16).alias("hcho"), (F.col("aod") - 0.3).alias("o3"),
    )
    return qa.clip_to_range(raw)


@query(
    "qa_03_sigma_screen",
    """, s AS (SELECT avg(hcho) AS mh, stddev_pop(hcho) AS sh, avg(no2) AS mn, stddev_pop(no2) AS sn FROM stack)
    SELECT date, row, col, CASE WHEN abs(hcho - mh) <= 1.5e0 * sh THEN hcho END AS hcho,
    CASE WHEN abs(no2 - mn) <= 1.5e0 * sn THEN no2 END AS no2 FROM stack, s""",
    ["stack"],
    text=["date"],
)
def _(t: Tables):
    return qa.within_sigma(t.stack().select("date", "row", "col", "hcho", "no2"), ["hcho", "no2"], 1.5)


@query(
    "qa_04_screen",
    """, c AS (SELECT date, row, col, CASE WHEN aod BETWEEN 0 AND 0.8e0 * 6.25e0 THEN aod END AS aod,
        CASE WHEN t BETWEEN 220 AND 330 THEN t END AS temperature, blh
        FROM (SELECT date, row, col, aod * 8e0 AS aod, temperature * 1.25e0 - 50e0 AS t, blh FROM stack)),
    s AS (SELECT avg(aod) AS ma, stddev_pop(aod) AS sa, avg(temperature) AS mt, stddev_pop(temperature) AS st, avg(blh) AS mb, stddev_pop(blh) AS sb FROM c)
    SELECT date, row, col, CASE WHEN abs(aod - ma) <= 2e0 * sa THEN aod END AS aod,
    CASE WHEN abs(temperature - mt) <= 2e0 * st THEN temperature END AS temperature, CASE WHEN abs(blh - mb) <= 2e0 * sb THEN blh END AS blh FROM c, s""",
    ["stack"],
    text=["date"],
)
def _(t: Tables):
    raw = t.stack().select(
        "date", "row", "col", (F.col("aod") * 8.0).alias("aod"), (F.col("temperature") * 1.25 - 50.0).alias("temperature"), "blh"
    )
    return qa.screen(raw, ["aod", "temperature", "blh"], 2.0)


@query(
    "qa_05_target_caps",
    """SELECT station_id, date, CASE WHEN pm25 BETWEEN 1 AND 1000 THEN pm25 END AS pm25, CASE WHEN pm10 BETWEEN 1 AND 2000 THEN pm10 END AS pm10,
    CASE WHEN no2_obs * 4e0 BETWEEN 0 AND 400 THEN no2_obs * 4e0 END AS no2_obs, CASE WHEN o3_obs BETWEEN 1 AND 400 THEN o3_obs END AS o3_obs FROM panel""",
    ["panel"],
    text=["date"],
)
def _(t: Tables):
    raw = t.panel().select("station_id", "date", "pm25", "pm10", (F.col("no2_obs") * 4.0).alias("no2_obs"), "o3_obs")
    return qa.cap_targets(raw)


@query("qa_06_strong_fires", "SELECT fire_id, longitude, latitude, frp FROM fires WHERE frp > 20", ["fires"])
def _(t: Tables):
    return qa.strong_fires(t.fires(), 20.0).select("fire_id", "longitude", "latitude", "frp")


@query("qa_07_required_columns", "SELECT date, row, col, aod, frp_mean FROM stack WHERE aod IS NOT NULL AND frp_mean IS NOT NULL", ["stack"], text=["date"])
def _(t: Tables):
    return qa.require(t.stack(), ["aod", "frp_mean", "absent"]).select("date", "row", "col", "aod", "frp_mean")


@query("qa_08_model_inputs", "SELECT date, row, col, coalesce(aod, 0e0) AS aod, coalesce(frp_mean, 0e0) AS frp_mean, 0e0 AS evi FROM stack", ["stack"], text=["date"])
def _(t: Tables):
    return qa.model_inputs(t.stack().select("date", "row", "col", "aod", "frp_mean"), ["aod", "frp_mean", "evi"])


# --- features -------------------------------------------------------------------------------
@query("fe_01_hcho_no2_ratio", "SELECT date, row, col, round(hcho / (no2 + 1e-30), 6) AS fnr FROM stack", ["stack"], text=["date"])
def _(t: Tables):
    return rounded(features.add_hcho_no2_ratio(t.stack()).select("date", "row", "col", "fnr"), 6, "fnr")


@query(
    "fe_02_cyclic_day",
    """SELECT l_orderkey, l_linenumber, round(sin(2e0 * pi() * dayofyear(l_shipdate) / 365.25e0), 6) AS doy_sin,
    round(cos(2e0 * pi() * dayofyear(l_shipdate) / 365.25e0), 6) AS doy_cos FROM lineitem""",
)
def _(t: Tables):
    out = features.add_cyclic_day(t.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_shipdate")
    return rounded(out.drop("l_shipdate"), 6, "doy_sin", "doy_cos")


@query(
    "fe_03_interactions",
    "SELECT date, row, col, round(aod * blh, 4) AS aod_blh, round(temperature * solar_radiation, 4) AS photo_index FROM stack",
    ["stack"],
    text=["date"],
)
def _(t: Tables):
    out = features.add_interactions(t.stack()).select("date", "row", "col", "aod_blh", "photo_index")
    return rounded(out, 4, "aod_blh", "photo_index")


_LAG = "PARTITION BY {k} ORDER BY date"
_LAGS = ", ".join(f"lag({c}, {k}) OVER w AS {c}_lag{k}" for c in ("aod", "no2") for k in (1, 2, 3))
_ROLL = ", ".join(f"round(avg({c}) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS {c}_roll3" for c in ("aod", "no2"))


@query(
    "fe_04_lags_by_cell",
    f"SELECT date, row, col, {_LAGS}, {_ROLL} FROM stack WINDOW w AS (PARTITION BY row, col ORDER BY date)",
    ["stack"],
    text=["date"],
)
def _(t: Tables):
    out = features.add_lags(t.stack().select("date", "row", "col", "aod", "no2"), ["aod", "no2"], chunk="year")
    return rounded(out.drop("aod", "no2"), 6, "aod_roll3", "no2_roll3")


@query(
    "fe_05_rolling_by_station",
    "SELECT station_id, date, round(avg(pm25) OVER w, 6) AS pm25_roll3, round(avg(aod) OVER w, 6) AS aod_roll3, lag(pm25, 1) OVER (PARTITION BY station_id ORDER BY date) AS pm25_lag1 "
    "FROM panel WINDOW w AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)",
    ["panel"],
    text=["date"],
)
def _(t: Tables):
    out = features.add_lags(t.panel().select("station_id", "date", "pm25", "aod"), ["pm25", "aod"], lags=(1,))
    return rounded(out.select("station_id", "date", "pm25_roll3", "aod_roll3", "pm25_lag1"), 6, "pm25_roll3", "aod_roll3")


@query(
    "fe_06_feature_chain",
    """SELECT station_id, date, round(hcho / (no2 + 1e-30), 6) AS fnr, round(sin(2e0 * pi() * dayofyear(date) / 365.25e0), 6) AS doy_sin,
    round(aod * blh, 4) AS aod_blh, round(temperature * solar_radiation, 4) AS photo_index,
    lag(hcho, 2) OVER w AS hcho_lag2, round(avg(hcho) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS hcho_roll3
    FROM panel WINDOW w AS (PARTITION BY station_id ORDER BY date)""",
    ["panel"],
    text=["date"],
)
def _(t: Tables):
    out = features.engineer(t.panel(), ["hcho"])
    out = out.select("station_id", "date", "fnr", "doy_sin", "aod_blh", "photo_index", "hcho_lag2", "hcho_roll3")
    return rounded(rounded(out, 6, "fnr", "doy_sin", "hcho_roll3"), 4, "aod_blh", "photo_index")


@query(
    "fe_07_standardize",
    """, s AS (SELECT avg(no2) AS mn, stddev_pop(no2) AS sn, avg(aod) AS ma, stddev_pop(aod) AS sa FROM stack)
    SELECT date, row, col, round((no2 - mn) / sn, 6) AS no2, round((aod - ma) / sa, 6) AS aod, (flat - 7e0) / 1e0 AS flat
    FROM (SELECT *, 7e0 AS flat FROM stack), s""",
    ["stack"],
    text=["date"],
)
def _(t: Tables):
    raw = t.stack().select("date", "row", "col", "no2", "aod", F.lit(7.0).alias("flat"))
    return rounded(features.standardize(raw, ["no2", "aod", "flat"]), 6, "no2", "aod")


@query(
    "fe_08_target_scaling",
    """, s AS (SELECT avg(pm25) AS m, stddev_pop(pm25) AS d FROM panel)
    SELECT station_id, date, round((pm25 - m) / d, 6) AS scaled, round(pm25, 6) AS restored FROM panel, s""",
    ["panel"],
    text=["date"],
)
def _(t: Tables):
    raw = t.panel().select("station_id", "date", "pm25")
    stats = features.channel_statistics(raw, ["pm25"])
    scaled = features.standardize(raw, ["pm25"], stats)
    both = features.destandardize(scaled.withColumn("scaled", F.col("pm25")), ["pm25"], stats)
    return rounded(both.withColumnRenamed("pm25", "restored"), 6, "scaled", "restored")
