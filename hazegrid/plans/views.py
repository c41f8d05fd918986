"""Adapter views: the shared tables reshaped into measurements, grids and panels.

Each view exists twice, as DataFrame code for the queries and as SQL for the oracle. Means
inside a view are exact (integer sums), so thresholds behave the same in both engines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.grid import GridSpec

PARAMETERS = ("pm25", "pm10", "no2", "o3", "co")
FIRST_SECOND_WIND = 1_704_067_200  # 2024-01-01T00:00:00Z
WIND_STEP = 21_600
WIND_FRAMES = 8

SCENE_GRID = GridSpec(75.0, -18.0, 80.0, 32.0, 0.1)
STACK_GRID = GridSpec(72.0, -68.0, 82.0, 32.0, 0.5)
WIND_GRID = GridSpec(68.0, 5.5, 98.0, 37.5, 2.0)


def mean(x: Column) -> Column:
    return F.sum(F.floor(x * 10000.0 + 0.5)).cast("double") / 10000.0 / F.count(x)


def _mean(x: str) -> str:
    return f"(CAST(sum(CAST(floor(({x}) * 10000e0 + 0.5e0) AS BIGINT)) AS DOUBLE) / 10000e0 / count({x}))"


def div(x: str, n: int) -> Column:
    return F.floor(F.col(x) / F.lit(n)).cast("int")


class Tables:
    """The shared tables of one scale and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def obs_long(self, stations: int = 4) -> DataFrame:
        kind = F.create_map(
            *[F.lit(x) for x in ("click", "pm25", "view", "pm10", "error", "no2", "purchase", "o3", "signup", "co")]
        )
        return self.table("events").select(
            (F.col("user_id") % stations).alias("station_id"),
            F.date_trunc("second", "ts").alias("datetime"),
            kind[F.col("event_type")].alias("parameter"),
            F.when(F.col("event_type") == "signup", F.col("value") / 20.0).otherwise(F.col("value")).alias("value"),
        )

    def stations(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("station_id"),
            F.col("s_name").alias("name"),
            (F.lit(68.0) + (k * 7 % 295).cast("double") / 10.0).alias("lon"),
            (F.lit(6.5) + (k * 13 % 310).cast("double") / 10.0).alias("lat"),
        )

    def places(self) -> DataFrame:
        """Customers as candidate hotspots with fire power and greenness."""
        k, bal = F.col("c_custkey"), F.col("c_acctbal")
        return self.table("customer").select(
            k.alias("place_id"),
            (F.lit(68.0) + (k * 7 % 295).cast("double") / 10.0).alias("lon"),
            (F.lit(6.5) + (k * 13 % 310).cast("double") / 10.0).alias("lat"),
            F.when(k % 3 != 0, F.abs(bal) / 40.0).alias("frp_mean"),
            ((k * 31 % 100).cast("double") / 100.0).alias("evi"),
            (k % 17 + 1).alias("n_cells"),
        )

    def scene(self) -> DataFrame:
        q, price = F.col("l_quantity"), F.col("l_extendedprice")
        cells = self.table("lineitem").groupBy(
            div("l_partkey", 40).alias("row"), (F.col("l_suppkey") % 50).cast("int").alias("col")
        ).agg(
            mean(F.when(F.col("l_linenumber") == 1, price)).alias("hcho"),
            mean(q).alias("no2"),
            mean(F.col("l_discount")).alias("co"),
            F.max(F.when(F.col("l_returnflag") == "R", q)).alias("frp_mean"),
            mean(F.when(F.col("l_linenumber") == 2, price)).alias("hcho_before"),
        )
        return SCENE_GRID.with_coordinates(cells)

    def stack(self) -> DataFrame:
        q, disc, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
        cells = self.table("lineitem").groupBy(
            F.trunc(F.to_date("l_shipdate"), "month").alias("date"),
            div("l_partkey", 100).alias("row"),
            (F.col("l_suppkey") % 20).cast("int").alias("col"),
        ).agg(
            (mean(F.when(F.col("l_linenumber") <= 5, disc)) * 10.0).alias("aod"),
            mean(q).alias("no2"),
            (mean(F.col("l_extendedprice")) / 1000.0).alias("hcho"),
            (mean(tax) * 10.0).alias("co"),
            (mean(tax) * 10000.0 + 100.0).alias("blh"),
            (mean(q) * 0.5 + 280.0).alias("temperature"),
            (mean(disc) * 1000.0).alias("solar_radiation"),
            F.max(F.when(F.col("l_returnflag") == "R", q)).alias("frp_mean"),
        )
        return STACK_GRID.with_coordinates(cells)

    def panel(self) -> DataFrame:
        q, disc, tax, price = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice")
        days = self.table("lineitem").groupBy(
            F.col("l_suppkey").alias("station_id"), F.to_date("l_shipdate").alias("date")
        ).agg(
            mean(q).alias("no2"),
            (mean(tax) * 10000.0 + 100.0).alias("blh"),
            (mean(F.when(F.col("l_linenumber") <= 5, disc)) * 10.0).alias("aod"),
            (mean(price) / 1000.0).alias("hcho"),
            (mean(disc) * 50.0 + 280.0).alias("temperature"),
            (mean(tax) * 800.0).alias("solar_radiation"),
            (mean(price) / 200.0).alias("pm25"),
            mean(F.when(F.col("l_returnflag") != "N", price / 100.0 + q)).alias("pm10"),
            (mean(q) * 3.0 + mean(disc) * 100.0).alias("no2_obs"),
            (mean(price) / 500.0 - mean(q)).alias("o3_obs"),
        )
        k = F.col("station_id")
        return days.withColumns(
            {
                "lon": F.lit(68.0) + (k * 7 % 295).cast("double") / 10.0,
                "lat": F.lit(6.5) + (k * 13 % 310).cast("double") / 10.0,
            }
        )

    def conc(self) -> DataFrame:
        q, price = F.col("l_quantity"), F.col("l_extendedprice")
        return self.table("lineitem").select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            (q * 11.0).alias("pm25"),
            F.when(F.col("l_linenumber") != 3, price / 160.0).alias("pm10"),
            (F.col("l_discount") * 4500.0).alias("no2"),
            F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax") * 20000.0).alias("so2"),
            (q * 0.9).alias("co"),
            F.when(F.col("l_returnflag") != "N", price / 100.0).alias("o3"),
        )

    def pix(self) -> DataFrame:
        gases = F.array(*[F.lit(g) for g in ("no2", "so2", "co", "o3", "hcho")])
        line = F.col("l_linenumber").cast("int")
        return self.table("lineitem").select(
            F.to_date("l_shipdate").alias("date"),
            F.col("l_shipdate").alias("ts"),
            div("l_partkey", 100).alias("row"),
            (F.col("l_suppkey") % 20).cast("int").alias("col"),
            F.get(gases, line % 5).alias("gas"),
            (F.col("l_extendedprice") / 1000.0).alias("value"),
            (F.col("l_discount") * 8.0).alias("cloud_fraction"),
            F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * 10.0).alias("max_frp"),
            (line + 2).alias("fire_mask"),
            F.when(F.col("l_returnflag") == "A", F.col("l_quantity") - 20.0).alias("burn_date"),
            (F.col("l_quantity") * 150.0).alias("evi"),
            (F.col("l_quantity") + 290.0).alias("t21"),
            (F.col("l_quantity") * 0.5 + 280.0).alias("temperature_2m"),
            (F.col("l_quantity") * 0.5 + 279.0 - F.col("l_discount") * 100.0).alias("dewpoint_temperature_2m"),
            (F.col("l_quantity") - 25.0).alias("u_component_of_wind_10m"),
            (F.col("l_tax") * 300.0 - 12.0).alias("v_component_of_wind_10m"),
            (F.col("l_extendedprice") / 10.0 + 90000.0).alias("surface_pressure"),
            F.col("l_tax").alias("total_precipitation_sum"),
            (F.col("l_discount") * 1000.0).alias("surface_solar_radiation_downwards_sum"),
        )

    def fires(self) -> DataFrame:
        return self.table("events").where(F.col("event_type") == "purchase").select(
            F.col("event_id").alias("fire_id"),
            (F.lit(68.0) + (F.col("user_id") * 37 % 295).cast("double") / 10.0).alias("longitude"),
            (F.lit(6.5) + (F.col("event_id") * 17 % 310).cast("double") / 10.0).alias("latitude"),
            F.col("value").alias("frp"),
            F.to_date("ts").alias("acq_date"),
        )

    def wind(self) -> DataFrame:
        return self.table("lineitem").groupBy(
            F.pmod(F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")), F.lit(WIND_FRAMES)).cast("int").alias("t_idx"),
            (F.col("l_partkey") % WIND_GRID.n_rows).cast("int").alias("row"),
            (F.col("l_suppkey") % WIND_GRID.n_cols).cast("int").alias("col"),
        ).agg(
            ((mean(F.col("l_quantity")) - 25.5) * 3.0).alias("u_wind"),
            ((mean(F.col("l_discount")) - 0.05) * 1500.0).alias("v_wind"),
        )

    def parcels(self) -> DataFrame:
        """Suppliers as receptors, one start in the last wind frames each."""
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("parcel_id"),
            (F.lit(70.0) + (k * 7 % 260).cast("double") / 10.0).alias("lon"),
            (F.lit(8.0) + (k * 13 % 270).cast("double") / 10.0).alias("lat"),
            (F.lit(FIRST_SECOND_WIND + WIND_STEP * (WIND_FRAMES - 1)) - (k % 5) * 5400).alias("time"),
        )


# ------------------------------------------------------------------------------------------
_LON = "68e0 + CAST({k} * 7 % 295 AS DOUBLE) / 10e0"
_LAT = "6.5e0 + CAST({k} * 13 % 310 AS DOUBLE) / 10e0"
_GRID = "{lon0}e0 + CAST({col} AS DOUBLE) * {res}e0 AS lon, {lat0}e0 - CAST({row} AS DOUBLE) * {res}e0 AS lat"


def _coords(g: GridSpec, row: str = "row", col: str = "col") -> str:
    return _GRID.format(
        lon0=repr(g.min_lon + g.resolution / 2), lat0=repr(g.max_lat - g.resolution / 2), res=repr(g.resolution), row=row, col=col
    )


VIEW_SQL = {
    "obs_long": """SELECT user_id % 4 AS station_id, date_trunc('second', ts) AS datetime,
        CASE event_type WHEN 'click' THEN 'pm25' WHEN 'view' THEN 'pm10' WHEN 'error' THEN 'no2'
             WHEN 'purchase' THEN 'o3' WHEN 'signup' THEN 'co' END AS parameter,
        CASE WHEN event_type = 'signup' THEN value / 20e0 ELSE value END AS value FROM events""",
    "obs12_long": """SELECT user_id % 12 AS station_id, date_trunc('second', ts) AS datetime,
        CASE event_type WHEN 'click' THEN 'pm25' WHEN 'view' THEN 'pm10' WHEN 'error' THEN 'no2'
             WHEN 'purchase' THEN 'o3' WHEN 'signup' THEN 'co' END AS parameter,
        CASE WHEN event_type = 'signup' THEN value / 20e0 ELSE value END AS value FROM events""",
    "obs_many_long": """SELECT user_id AS station_id, date_trunc('second', ts) AS datetime,
        CASE event_type WHEN 'click' THEN 'pm25' WHEN 'view' THEN 'pm10' WHEN 'error' THEN 'no2'
             WHEN 'purchase' THEN 'o3' WHEN 'signup' THEN 'co' END AS parameter,
        CASE WHEN event_type = 'signup' THEN value / 20e0 ELSE value END AS value FROM events""",
    "stations": f"""SELECT s_suppkey AS station_id, s_name AS name, {_LON.format(k='s_suppkey')} AS lon,
        {_LAT.format(k='s_suppkey')} AS lat FROM supplier""",
    "places": f"""SELECT c_custkey AS place_id, {_LON.format(k='c_custkey')} AS lon, {_LAT.format(k='c_custkey')} AS lat,
        CASE WHEN c_custkey % 3 <> 0 THEN abs(c_acctbal) / 40e0 END AS frp_mean,
        CAST(c_custkey * 31 % 100 AS DOUBLE) / 100e0 AS evi, c_custkey % 17 + 1 AS n_cells FROM customer""",
    "scene": f"""SELECT *, {_coords(SCENE_GRID)} FROM (
        SELECT CAST(floor(l_partkey / 40) AS INT) AS row, CAST(l_suppkey % 50 AS INT) AS col,
        {_mean("CASE WHEN l_linenumber = 1 THEN l_extendedprice END")} AS hcho, {_mean("l_quantity")} AS no2,
        {_mean("l_discount")} AS co, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS frp_mean,
        {_mean("CASE WHEN l_linenumber = 2 THEN l_extendedprice END")} AS hcho_before
        FROM lineitem GROUP BY 1, 2)""",
    "stack": f"""SELECT *, {_coords(STACK_GRID)} FROM (
        SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(floor(l_partkey / 100) AS INT) AS row,
        CAST(l_suppkey % 20 AS INT) AS col,
        {_mean("CASE WHEN l_linenumber <= 5 THEN l_discount END")} * 10e0 AS aod, {_mean("l_quantity")} AS no2,
        {_mean("l_extendedprice")} / 1000e0 AS hcho, {_mean("l_tax")} * 10e0 AS co,
        {_mean("l_tax")} * 10000e0 + 100e0 AS blh, {_mean("l_quantity")} * 0.5e0 + 280e0 AS temperature,
        {_mean("l_discount")} * 1000e0 AS solar_radiation,
        max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS frp_mean
        FROM lineitem GROUP BY 1, 2, 3)""",
    "panel": f"""SELECT *, {_LON.format(k='station_id')} AS lon, {_LAT.format(k='station_id')} AS lat FROM (
        SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS date, {_mean("l_quantity")} AS no2,
        {_mean("l_tax")} * 10000e0 + 100e0 AS blh, {_mean("CASE WHEN l_linenumber <= 5 THEN l_discount END")} * 10e0 AS aod,
        {_mean("l_extendedprice")} / 1000e0 AS hcho, {_mean("l_discount")} * 50e0 + 280e0 AS temperature,
        {_mean("l_tax")} * 800e0 AS solar_radiation, {_mean("l_extendedprice")} / 200e0 AS pm25,
        {_mean("CASE WHEN l_returnflag <> 'N' THEN l_extendedprice / 100e0 + l_quantity END")} AS pm10,
        {_mean("l_quantity")} * 3e0 + {_mean("l_discount")} * 100e0 AS no2_obs,
        {_mean("l_extendedprice")} / 500e0 - {_mean("l_quantity")} AS o3_obs
        FROM lineitem GROUP BY 1, 2)""",
    "conc": """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 11e0 AS pm25,
        CASE WHEN l_linenumber <> 3 THEN l_extendedprice / 160e0 END AS pm10, l_discount * 4500e0 AS no2,
        CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 20000e0 END AS so2, l_quantity * 0.9e0 AS co,
        CASE WHEN l_returnflag <> 'N' THEN l_extendedprice / 100e0 END AS o3 FROM lineitem""",
    "pix": """SELECT CAST(l_shipdate AS DATE) AS date, l_shipdate AS ts, CAST(floor(l_partkey / 100) AS INT) AS row,
        CAST(l_suppkey % 20 AS INT) AS col,
        CASE l_linenumber % 5 WHEN 0 THEN 'no2' WHEN 1 THEN 'so2' WHEN 2 THEN 'co' WHEN 3 THEN 'o3' ELSE 'hcho' END AS gas,
        l_extendedprice / 1000e0 AS value, l_discount * 8e0 AS cloud_fraction,
        CASE WHEN l_returnflag = 'R' THEN l_quantity * 10e0 END AS max_frp, l_linenumber + 2 AS fire_mask,
        CASE WHEN l_returnflag = 'A' THEN l_quantity - 20e0 END AS burn_date, l_quantity * 150e0 AS evi,
        l_quantity + 290e0 AS t21, l_quantity * 0.5e0 + 280e0 AS temperature_2m,
        l_quantity * 0.5e0 + 279e0 - l_discount * 100e0 AS dewpoint_temperature_2m,
        l_quantity - 25e0 AS u_component_of_wind_10m, l_tax * 300e0 - 12e0 AS v_component_of_wind_10m,
        l_extendedprice / 10e0 + 90000e0 AS surface_pressure, l_tax AS total_precipitation_sum,
        l_discount * 1000e0 AS surface_solar_radiation_downwards_sum FROM lineitem""",
    "fires": """SELECT event_id AS fire_id, 68e0 + CAST(user_id * 37 % 295 AS DOUBLE) / 10e0 AS longitude,
        6.5e0 + CAST(event_id * 17 % 310 AS DOUBLE) / 10e0 AS latitude, value AS frp, CAST(ts AS DATE) AS acq_date
        FROM events WHERE event_type = 'purchase'""",
    "wind": f"""SELECT CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % {WIND_FRAMES} AS INT) AS t_idx,
        CAST(l_partkey % {WIND_GRID.n_rows} AS INT) AS row, CAST(l_suppkey % {WIND_GRID.n_cols} AS INT) AS col,
        ({_mean("l_quantity")} - 25.5e0) * 3e0 AS u_wind, ({_mean("l_discount")} - 0.05e0) * 1500e0 AS v_wind
        FROM lineitem GROUP BY 1, 2, 3""",
    "parcels": f"""SELECT s_suppkey AS parcel_id, 70e0 + CAST(s_suppkey * 7 % 260 AS DOUBLE) / 10e0 AS lon,
        8e0 + CAST(s_suppkey * 13 % 270 AS DOUBLE) / 10e0 AS lat,
        {FIRST_SECOND_WIND + WIND_STEP * (WIND_FRAMES - 1)} - (s_suppkey % 5) * 5400 AS time FROM supplier""",
}
_WIDE = ", ".join(f"avg(CASE WHEN parameter = '{p}' THEN value END) AS {p}" for p in PARAMETERS)
for _name in ("obs", "obs12", "obs_many"):
    VIEW_SQL[f"{_name}_wide"] = f"SELECT station_id, datetime, {_WIDE} FROM {_name}_long GROUP BY 1, 2"


def with_views(sql: str, views: Sequence[str]) -> str:
    """Prefix a query with the CTEs it names. A trailing WITH list in ``sql`` may start with a comma."""
    if not views:
        return sql
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v]})" for v in views)
    body = sql.strip()
    recursive = "RECURSIVE " if body.upper().startswith(", RECURSIVE ") else ""
    if recursive:
        body = ", " + body[len(", RECURSIVE "):]
    return f"WITH {recursive}{ctes}\n{body}"
