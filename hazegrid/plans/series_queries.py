"""Trend, correlation, density and zonal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.operators import correlation, density, temporal, trends, zonal
from hazegrid.plans import sqltext as S
from hazegrid.plans.hotspot_queries import _TAIL
from hazegrid.plans.registry import query, rounded
from hazegrid.plans.views import SCENE_GRID, Tables

# --- trends ---------------------------------------------------------------------------------
_PAIRS = f"""JOIN points b ON a.station_id = b.station_id AND a.season = b.season AND a.t < b.t"""
_MK = f""", points AS (SELECT station_id, {S.season("date")} AS season, date_diff('day', DATE '1970-01-01', date) AS t, aod AS x FROM panel WHERE aod IS NOT NULL),
    s AS (SELECT a.station_id, a.season, sum(CAST(sign(b.x - a.x) AS BIGINT)) AS s FROM points a {_PAIRS} GROUP BY 1, 2),
    ties AS (SELECT station_id, season, sum(k) AS n, sum(k * (k - 1) * (2 * k + 5)) AS term
        FROM (SELECT station_id, season, x, count(*) AS k FROM points GROUP BY 1, 2, 3) GROUP BY 1, 2),
    v AS (SELECT ties.station_id, ties.season, CAST(n AS BIGINT) AS n, CAST(coalesce(s, 0) AS BIGINT) AS s,
        CAST(n * (n - 1) * (2 * n + 5) - term AS DOUBLE) / 18e0 AS variance FROM ties LEFT JOIN s USING (station_id, season)),
    z AS (SELECT *, CASE WHEN variance > 0 THEN (s - sign(s)) / sqrt(variance) ELSE 0e0 END AS z FROM v),
    p AS (SELECT *, least(1e0, 2e0 * ({_TAIL})) AS p FROM (SELECT *, abs(z) AS x, 1e0 / (1e0 + 0.2316419e0 * abs(z)) AS k FROM z))
    SELECT station_id, season, n, s, round(variance, 4) AS variance, round(z, 6) AS z, round(p, 6) AS p,
        CASE WHEN p < 0.05e0 THEN CAST(sign(z) AS INT) ELSE 0 END AS trend FROM p"""


@query("ts_01_mann_kendall", _MK, ["panel"])
def _(t: Tables):
    out = trends.mann_kendall(t.panel().withColumn("season", temporal.season_of(F.col("date"))), ["station_id", "season"], F.unix_date("date"), "aod")
    return rounded(rounded(out, 4, "variance"), 6, "z", "p")


@query(
    "ts_02_theil_sen",
    """, points AS (SELECT station_id, date_diff('day', DATE '1970-01-01', date) AS t, aod AS x FROM panel WHERE aod IS NOT NULL),
    zero AS (SELECT station_id, min(t) AS t0, count(*) AS n, median(x) AS mx, median(t) AS mt FROM points GROUP BY 1),
    slopes AS (SELECT a.station_id, median((b.x - a.x) / CAST(b.t - a.t AS DOUBLE)) AS slope
        FROM points a JOIN points b ON a.station_id = b.station_id AND a.t < b.t GROUP BY 1)
    SELECT station_id, n, round(slope, 10) AS slope, round(CASE WHEN n > 1 THEN mx - slope * mt ELSE mx END, 7) AS intercept
    FROM zero LEFT JOIN slopes USING (station_id)""",
    ["panel"],
)
def _(t: Tables):
    return rounded(rounded(trends.theil_sen(t.panel(), ["station_id"], F.unix_date("date"), "aod"), 10, "slope"), 7, "intercept")


# --- density --------------------------------------------------------------------------------
EPS, MIN_POINTS = 0.45, 4
_WITHIN = f"(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS!r}e0 * {EPS!r}e0"


@query(
    "ts_05_density_clusters",
    f""", RECURSIVE pts AS (SELECT fire_id AS id, longitude AS x, latitude AS y FROM fires),
    near AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON {_WITHIN}),
    core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {MIN_POINTS}),
    owned AS (SELECT a, b FROM near WHERE b IN (SELECT id FROM core)),
    links AS (SELECT a, b FROM owned WHERE a IN (SELECT id FROM core)),
    reach AS (SELECT id, id AS root FROM core UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id),
    named AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id),
    border AS (SELECT a AS id, min(b) AS owner FROM owned GROUP BY a)
    SELECT pts.id AS fire_id, coalesce(named.cluster, own.cluster) AS cluster, named.id IS NOT NULL AS core
    FROM pts LEFT JOIN named ON pts.id = named.id LEFT JOIN border ON pts.id = border.id LEFT JOIN named own ON border.owner = own.id""",
    ["fires"],
)
def _(t: Tables):
    return density.density_clusters(t.fires(), EPS, MIN_POINTS, "fire_id", "longitude", "latitude")


# --- correlation ----------------------------------------------------------------------------
@query(
    "ts_03_season_correlation",
    f""", pairs AS (SELECT {S.season("date")} AS season, hcho AS x, o3_obs AS y FROM panel WHERE hcho IS NOT NULL AND o3_obs IS NOT NULL),
    ranked AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY x) + (count(*) OVER (PARTITION BY season, x) - 1) / 2e0 AS rx,
        rank() OVER (PARTITION BY season ORDER BY y) + (count(*) OVER (PARTITION BY season, y) - 1) / 2e0 AS ry FROM pairs)
    SELECT season, count(*) AS n, round(corr(x, y), 8) AS pearson, round(corr(rx, ry), 8) AS spearman FROM ranked GROUP BY season""",
    ["panel"],
)
def _(t: Tables):
    out = correlation.correlation_by(t.panel().withColumn("season", temporal.season_of(F.col("date"))), "hcho", "o3_obs", ["season"])
    return rounded(out, 8, "pearson", "spearman")


_LAGS = """, days AS (SELECT station_id, date_diff('day', DATE '1970-01-01', date) AS t, hcho AS h, o3_obs AS o FROM panel),
    m AS (SELECT station_id, avg(h) AS mh, avg(o) AS mo FROM days GROUP BY 1),
    c AS (SELECT station_id, t, h - mh AS h, o - mo AS o FROM days JOIN m USING (station_id)),
    d AS (SELECT station_id, sqrt(sum(h * h) * sum(o * o)) AS below FROM c GROUP BY 1),
    pairs AS (SELECT station_id, lag, count(*) AS n, sum(a.h * b.o) AS above FROM c a JOIN c b USING (station_id)
        JOIN (SELECT CAST(unnest(range(31)) AS INT) AS lag) k ON b.t = a.t + k.lag WHERE a.h IS NOT NULL AND b.o IS NOT NULL GROUP BY 1, 2),
    lags AS (SELECT station_id, lag, coalesce(n, 0) AS n, coalesce(above, 0e0) / nullif(below, 0e0) AS r
        FROM (SELECT station_id, below, CAST(unnest(range(31)) AS INT) AS lag FROM d) LEFT JOIN pairs USING (station_id, lag))"""


def _lagged(t: Tables):
    return correlation.lag_correlation(t.panel(), ["station_id"], F.unix_date("date"), "hcho", "o3_obs")


@query("ts_04_lag_correlation", _LAGS + " SELECT station_id, lag, n, round(r, 7) AS r FROM lags", ["panel"])
def _(t: Tables):
    return rounded(_lagged(t), 7, "r")


@query(
    "ts_04_best_lag",
    _LAGS + """ SELECT station_id, lag, n, round(r, 7) AS r FROM lags WHERE r IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY r DESC, lag) = 1""",
    ["panel"],
)
def _(t: Tables):
    return rounded(correlation.best_lag(_lagged(t), ["station_id"]), 7, "r")


# --- zones ----------------------------------------------------------------------------------
# a five-sided zone with a three-sided hole around every supplier, in degrees from its centre
OUTER = ((-1.03, -0.62), (0.87, -0.91), (1.21, 0.33), (0.14, 1.07), (-0.94, 0.71))
HOLE = ((-0.31, -0.22), (0.05, 0.41), (0.37, -0.13))
_RING_POINTS = [(k, s, bool(k), x, y) for k, ring in enumerate((OUTER, HOLE)) for s, (x, y) in enumerate(ring)]


def _zones(t: Tables):
    k = F.col("s_suppkey")
    points = F.array(*[F.struct(F.lit(a).alias("ring"), F.lit(b).alias("seq"), F.lit(c).alias("hole"), F.lit(d).alias("dx"), F.lit(e).alias("dy")) for a, b, c, d, e in _RING_POINTS])
    placed = t.table("supplier").select(k.alias("zone"), F.explode(points).alias("p")).select("zone", "p.*")
    z = F.col("zone")
    return placed.withColumns({"lon": F.lit(75.0) + (z * 7 % 50) / F.lit(10.0) + F.col("dx"), "lat": F.lit(32.0) - (z * 13 % 50) / F.lit(10.0) + F.col("dy")})


def _covered(t: Tables):
    return zonal.zone_cells(zonal.zone_spans(_zones(t), SCENE_GRID), t.scene())


_POINT_ROWS = ", ".join(f"({a}, {b}, {str(c).lower()}, {S.num(d)}, {S.num(e)})" for a, b, c, d, e in _RING_POINTS)
_FULL = "CASE WHEN {x} <= col THEN {x} - col WHEN {x} >= col + 1 THEN 0.5e0 ELSE ({x} - col) - ({x} - col) * ({x} - col) / 2e0 END"
#: The share of a cell is the integral of what lies right of each edge, in closed form; every edge meets every cell.
_ZONES = f""", v AS (SELECT s_suppkey AS zone, p.ring, p.seq, p.hole,
        (75e0 + CAST(s_suppkey * 7 % 50 AS DOUBLE) / 10e0 + p.dx - 75e0) / 0.1e0 AS x0,
        (32e0 - (32e0 - CAST(s_suppkey * 13 % 50 AS DOUBLE) / 10e0 + p.dy)) / 0.1e0 AS y0
        FROM supplier, (VALUES {_POINT_ROWS}) p(ring, seq, hole, dx, dy)),
    ed AS (SELECT *, coalesce(lead(x0) OVER w, first_value(x0) OVER w) AS x1, coalesce(lead(y0) OVER w, first_value(y0) OVER w) AS y1
        FROM v WINDOW w AS (PARTITION BY zone, ring ORDER BY seq)),
    turned AS (SELECT *, -sign(sum(x0 * y1 - x1 * y0) OVER (PARTITION BY zone, ring)) * CASE WHEN hole THEN -1 ELSE 1 END
        * CASE WHEN y1 > y0 THEN 1 ELSE -1 END AS up FROM ed),
    met AS (SELECT zone, row, col, up, greatest(least(y0, y1), row) AS lo, least(greatest(y0, y1), row + 1) AS hi, x0, y0, x1, y1
        FROM turned JOIN scene ON least(y0, y1) < row + 1 AND greatest(y0, y1) > row AND y0 <> y1),
    cut AS (SELECT zone, row, col, up * (hi - lo) AS dy, x0 + (lo - y0) * (x1 - x0) / (y1 - y0) AS xa, x0 + (hi - y0) * (x1 - x0) / (y1 - y0) AS xb FROM met),
    shares AS (SELECT zone, row, col, sum(dy * CASE WHEN abs(xb - xa) < 1e-12 THEN greatest(0e0, least(1e0, col + 1 - xa))
        ELSE (({_FULL.format(x="xb")}) - ({_FULL.format(x="xa")})) / (xb - xa) END) AS share FROM cut GROUP BY 1, 2, 3),
    covered AS (SELECT zone, share, scene.* FROM shares JOIN scene USING (row, col) WHERE share > 1e-9)"""


@query("ts_06_zone_shares", _ZONES + " SELECT zone, row, col, round(share, 7) AS share FROM covered", ["scene"])
def _(t: Tables):
    return rounded(_covered(t).select("zone", "row", "col", "share"), 7, "share")


@query(
    "ts_06_zonal_statistics",
    _ZONES + """, w AS (SELECT zone, hcho AS v, share * cos(radians(lat)) AS w FROM covered WHERE hcho IS NOT NULL),
    c AS (SELECT *, sum(w) OVER (PARTITION BY zone ORDER BY v) AS upto, sum(w) OVER (PARTITION BY zone) AS total FROM w)
    SELECT zone, count(*) AS n_cells, round(sum(w), 6) AS weight, round(sum(v * w) / sum(w), 4) AS mean,
        round(min(v) FILTER (upto >= total * 0.1e0 * (1 - 1e-12)), 4) AS q10, round(min(v) FILTER (upto >= total * 0.5e0 * (1 - 1e-12)), 4) AS q50,
        round(min(v) FILTER (upto >= total * 0.9e0 * (1 - 1e-12)), 4) AS q90 FROM c GROUP BY zone""",
    ["scene"],
)
def _(t: Tables):
    out = zonal.zonal_statistics(_covered(t), "hcho", F.cos(F.radians("lat")), [0.1, 0.5, 0.9])
    return rounded(rounded(out, 6, "weight"), 4, "mean", "q10", "q50", "q90")


@query(
    "ts_06_exposure_share",
    _ZONES + """, b AS (SELECT zone, CASE WHEN hcho < 40000 THEN 'low' WHEN hcho < 60000 THEN 'middle' WHEN hcho >= 60000 THEN 'high' END AS band,
        sum(share * no2) AS people FROM covered WHERE no2 IS NOT NULL GROUP BY 1, 2)
    SELECT zone, band, round(people, 5) AS people, round(people / sum(people) OVER (PARTITION BY zone), 7) AS share FROM b""",
    ["scene"],
)
def _(t: Tables):
    h = F.col("hcho")
    band = F.when(h < 40000, "low").when(h < 60000, "middle").when(h >= 60000, "high")
    return rounded(rounded(zonal.exposure_shares(_covered(t), band, "no2"), 5, "people"), 7, "share")
