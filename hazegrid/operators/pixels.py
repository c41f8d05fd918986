"""Reductions over pixel collections: long tables of (date, row, col, band values)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.constants import LAND_COVER_CLASSES
from hazegrid.functions.geo import relative_humidity, wind_speed

CELL = ("row", "col")


def in_period(pixels: DataFrame, start: str, end: str, date_col: str = "date", bounds: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Half-open period ``[start, end)`` and an optional inclusive row/col window (r0, r1, c0, c1)."""
    day = F.col(date_col)
    out = pixels.where((day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date")))
    if bounds:
        r0, r1, c0, c1 = bounds
        out = out.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    return out


def period_mean(pixels: DataFrame, bands: Sequence[str], start: str, end: str, keys: Sequence[str] = CELL, **where) -> DataFrame:
    return in_period(pixels, start, end, **where).groupBy(*keys).agg(*[F.avg(b).alias(b) for b in bands])


def cloud_free_mean(
    pixels: DataFrame, band: str, start: str, end: str, max_cloud: float = 0.4, cloud: str = "cloud_fraction",
    keys: Sequence[str] = CELL,
) -> DataFrame:
    """Period mean over pixels below the cloud limit. A cell without clear pixels keeps a NULL."""
    clear = F.when(F.col(cloud) < F.lit(max_cloud), F.col(band))
    return in_period(pixels, start, end).groupBy(*keys).agg(F.avg(clear).alias(band))


def gas_stack(
    pixels: DataFrame, gases: Sequence[str], start: str, end: str, gas_col: str = "gas", value_col: str = "value",
    screened: Sequence[str] = ("hcho",), max_cloud: float = 0.4, cloud: str = "cloud_fraction", keys: Sequence[str] = CELL,
) -> DataFrame:
    """One mean column per gas in a single aggregation; screened gases need a clear sky."""

    def band(gas: str) -> Column:
        hit = F.col(gas_col) == gas
        if gas in screened and cloud in pixels.columns:
            hit = hit & (F.col(cloud) < F.lit(max_cloud))
        return F.avg(F.when(hit, F.col(value_col))).alias(gas)

    return in_period(pixels, start, end).groupBy(*keys).agg(*[band(g) for g in gases])


def weather_stack(pixels: DataFrame, start: str, end: str, keys: Sequence[str] = CELL) -> DataFrame:
    """Period-mean weather with humidity and wind speed derived from the means."""
    renames = {
        "temperature_2m": "temperature",
        "u_component_of_wind_10m": "u_wind",
        "v_component_of_wind_10m": "v_wind",
        "surface_pressure": "pressure",
        "total_precipitation_sum": "precipitation",
        "surface_solar_radiation_downwards_sum": "solar_radiation",
    }
    raw = [c for c in (*renames, "dewpoint_temperature_2m") if c in pixels.columns]
    mean = period_mean(pixels, raw, start, end, keys).withColumnsRenamed(renames)
    return mean.select(
        *keys,
        "temperature",
        relative_humidity(F.col("temperature"), F.col("dewpoint_temperature_2m")).alias("rh"),
        "u_wind",
        "v_wind",
        wind_speed(F.col("u_wind"), F.col("v_wind")).alias("wind_speed"),
        *[c for c in ("pressure", "precipitation", "solar_radiation") if c in mean.columns],
    )


def fire_power(pixels: DataFrame, start: str, end: str, keys: Sequence[str] = CELL, max_frp: str = "max_frp", mask: str = "fire_mask") -> DataFrame:
    """Mean and peak fire power in MW with no detection as 0, and days with a confident fire."""
    mw = F.coalesce(F.col(max_frp) / F.lit(10.0), F.lit(0.0))
    return in_period(pixels, start, end).groupBy(*keys).agg(
        F.avg(mw).alias("frp_mean"),
        F.max(mw).alias("frp_max"),
        F.sum(F.coalesce(F.col(mask) >= 7, F.lit(False)).cast("bigint")).alias("fire_count"),
    )


def burned_mask(pixels: DataFrame, start: str, end: str, keys: Sequence[str] = CELL, burn_date: str = "burn_date") -> DataFrame:
    latest = F.coalesce(F.max(burn_date) > 0, F.lit(False))
    return in_period(pixels, start, end).groupBy(*keys).agg(latest.cast("int").alias("burned"))


def vegetation_index(pixels: DataFrame, start: str, end: str, keys: Sequence[str] = CELL, evi: str = "evi") -> DataFrame:
    return in_period(pixels, start, end).groupBy(*keys).agg((F.avg(evi) * F.lit(0.0001)).alias("evi"))


def cover_fractions(fine: DataFrame, factor: int, class_col: str = "land_class", row: str = "row", col: str = "col") -> DataFrame:
    """Share of each land-cover class among the fine pixels of every coarse cell."""
    size = F.lit(factor)
    coarse = fine.withColumns(
        {"_r": F.floor(F.col(row) / size).cast("int"), "_c": F.floor(F.col(col) / size).cast("int")}
    )
    shares = [F.avg((F.col(class_col) == code).cast("double")).alias(f"lc_{name}") for code, name in LAND_COVER_CLASSES.items()]
    return coarse.groupBy(F.col("_r").alias("row"), F.col("_c").alias("col")).agg(*shares)


METRES_PER_DEGREE = 111_320.0


def terrain(cells: DataFrame, elevation: str = "elevation", spacing: float = 0.01, lat: str = "lat", scene: Sequence[str] = ()) -> DataFrame:
    """Slope and aspect of a dense elevation grid (metres) in degrees.

    Central differences inside, one-sided at the rim, over the ground distance of ``spacing`` degrees; a column of the
    grid is narrower by the cosine of its latitude. Slope is the angle of the steepest gradient, aspect the angle of
    the (down-row, along-row) gradients in [0, 360). Each window holds one grid row or one grid column.
    """

    def gradient(part: str, order: str) -> Column:
        w = Window.partitionBy(*scene, part).orderBy(order)
        here, ahead, behind = F.col(elevation), F.lead(elevation).over(w), F.lag(elevation).over(w)
        adjacent_ahead = F.lead(order).over(w) == F.col(order) + 1
        adjacent_behind = F.lag(order).over(w) == F.col(order) - 1
        up, down = F.when(adjacent_ahead, ahead), F.when(adjacent_behind, behind)
        return (
            F.when(adjacent_ahead & adjacent_behind, (up - down) / F.lit(2.0))
            .when(adjacent_ahead, up - here)
            .when(adjacent_behind, here - down)
        )

    ground = F.lit(spacing * METRES_PER_DEGREE)
    graded = cells.withColumn("_down", gradient("col", "row") / ground).withColumn("_along", gradient("row", "col") / (ground * F.cos(F.radians(F.col(lat)))))
    return graded.withColumns(
        {
            "slope": F.degrees(F.atan(F.hypot("_down", "_along"))),
            "aspect": F.pmod(F.degrees(F.atan2(F.col("_down"), F.col("_along"))), F.lit(360.0)),
        }
    ).drop("_down", "_along")


def scaled_daily_mean(granules: DataFrame, band: str, time_col: str, scale: float = 0.001, keys: Sequence[str] = CELL, out: str = "aod") -> DataFrame:
    """Granules of a day averaged per cell and scaled to physical units."""
    return granules.groupBy(F.to_date(time_col).alias("date"), *keys).agg((F.avg(band) * F.lit(scale)).alias(out))


def brightness_mean(pixels: DataFrame, start: str, end: str, band: str = "t21", keys: Sequence[str] = CELL) -> DataFrame:
    return period_mean(pixels, [band], start, end, keys).withColumnRenamed(band, "fire_t21")
