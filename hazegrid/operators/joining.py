"""Collocation joins: nearest cell, nearest point in a radius, nearest time, box and disc tests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.functions.geo import haversine_km
from hazegrid.grid import GridSpec
from hazegrid.session import materialize


def sample_at_stations(stack: DataFrame, stations: DataFrame, grid: GridSpec, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Every date of the nearest grid cell for each station, however far the station is.

    The nearest cell is arithmetic, so this is an equi-join on (row, col); the optimiser
    broadcasts the stations while they are small. Grid coordinates keep ``lon``/``lat``, the
    station's own become ``lon_meta``/``lat_meta``.
    """
    row, col = grid.nearest_index(F.col(lon), F.col(lat))
    placed = stations.withColumns({"row": row, "col": col}).withColumnsRenamed({lon: f"{lon}_meta", lat: f"{lat}_meta"})
    return stack.join(placed, ["row", "col"])


def nearest_cell_values(points: DataFrame, cells: DataFrame, grid: GridSpec, values: Sequence[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points with field values of their nearest cell (NULL where the field has none)."""
    row, col = grid.nearest_index(F.col(lon), F.col(lat))
    placed = points.withColumns({"_row": row, "_col": col})
    field = cells.select(F.col("row").alias("_row"), F.col("col").alias("_col"), *values)
    return placed.join(field, ["_row", "_col"], "left").drop("_row", "_col")


def join_targets(predictors: DataFrame, daily: DataFrame, time_col: str = "time") -> DataFrame:
    """Station-days that have both predictors and observations."""
    left = predictors.withColumn("date", F.to_date(time_col)) if time_col != "date" else predictors
    return left.join(daily, ["station_id", "date"])


def map_to_nearest_station(points: DataFrame, stations: DataFrame, radius_deg: float = 0.12, station_key: str = "station_id") -> DataFrame:
    """(lon, lat) of distinct points with the closest station within a planar radius.

    Only distinct coordinates are matched, so a coordinate repeated on many dates is matched
    once. Stations (the small side) are copied to the 3 x 3 buckets around them; a point
    looks into its own bucket. The smaller station key wins a tie.
    """
    step = F.lit(radius_deg)

    def bucket(c: Column) -> Column:
        return F.floor(c / step).cast("bigint")

    spots = points.select("lon", "lat").distinct().withColumns({"_bx": bucket(F.col("lon")), "_by": bucket(F.col("lat"))})
    around = F.array(*[F.struct(F.lit(dx).alias("x"), F.lit(dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    spread = stations.select(
        F.col(station_key), F.col("lon").alias("_slon"), F.col("lat").alias("_slat"), F.explode(around).alias("_o")
    ).select(
        station_key,
        "_slon",
        "_slat",
        (bucket(F.col("_slon")) + F.col("_o.x")).alias("_bx"),
        (bucket(F.col("_slat")) + F.col("_o.y")).alias("_by"),
    )
    dx, dy = F.col("lon") - F.col("_slon"), F.col("lat") - F.col("_slat")
    dist = F.sqrt(dx * dx + dy * dy)
    near = spots.join(spread, ["_bx", "_by"]).where(dist <= F.lit(radius_deg))
    return near.groupBy("lon", "lat").agg(F.min(F.struct(dist.alias("d"), F.col(station_key).alias("k"))).alias("_m")).select(
        "lon", "lat", F.col("_m.k").alias(station_key), F.col("_m.d").alias("distance_deg")
    )


def points_to_stations(points: DataFrame, stations: DataFrame, bands: Sequence[str], radius_deg: float = 0.12) -> DataFrame:
    """Mean of every band over the points of each station and date."""
    mapping = map_to_nearest_station(points, stations, radius_deg).drop("distance_deg")
    return points.join(mapping, ["lon", "lat"]).groupBy("station_id", "date").agg(*[F.avg(b).alias(b) for b in bands])


def fuse_sources(sources: Sequence[DataFrame], keys: Sequence[str] = ("station_id", "date")) -> DataFrame:
    """Full outer join of sources that are unique per key, as one union and one aggregation.

    One shuffle regardless of the number of sources; each source must own its columns.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def attach_stations(df: DataFrame, stations: DataFrame, how: str = "left") -> DataFrame:
    return df.join(stations, "station_id", how)


def first_coordinates(df: DataFrame, order: str = "date", key: str = "station_id") -> DataFrame:
    """First non-missing coordinates per station in a stated order."""
    place = F.struct("lat", "lon")
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    first = F.min_by(F.when(known, place), F.when(known, F.struct(F.col(order), F.col("lat"), F.col("lon"))))
    return df.groupBy(key).agg(first.alias("_p")).select(key, "_p.lat", "_p.lon")


def in_box(lon: Column, lat: Column, box: Sequence[float]) -> Column:
    """Inclusive bounding-box test."""
    return lon.between(F.lit(float(box[0])), F.lit(float(box[2]))) & lat.between(F.lit(float(box[1])), F.lit(float(box[3])))


def last_box(lon: Column, lat: Column, boxes: dict, season: str | None = None) -> Column:
    """Name of the last matching box of a small constant registry, NULL if none.

    A box written as ``(bbox, seasons)`` matches only if ``season`` is open or listed. The
    registry is a handful of literals, so the range join becomes a CASE: no join, no shuffle.
    """
    out = []
    for name, spec in boxes.items():
        box, seasons = (spec[0], spec[1]) if isinstance(spec[0], (tuple, list)) else (spec, None)
        if season is None or seasons is None or season in seasons:
            out.append(F.when(in_box(lon, lat, box), F.lit(name)))
    return F.coalesce(*reversed(out)) if out else F.lit(None).cast("string")


def first_disc(lon: Column, lat: Column, discs: dict) -> Column:
    """Name of the first centre whose radius (km) covers the point."""
    hits = [
        F.when(haversine_km(lon, lat, F.lit(x), F.lit(y)) <= F.lit(float(km)), F.lit(name))
        for name, (x, y, km) in discs.items()
    ]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def nearest_time(rows: DataFrame, axis: DataFrame, time_col: str, axis_col: str, ranges: int | None = None) -> DataFrame:
    """Rows with the nearest instant of a time axis, before or after; the earlier wins a tie.
    All rows are kept; without a time or any instant the result is NULL.

    Rows and instants are dealt by ranges of one order and stored. Inside a range a row sees the instants before and
    after it; the last instant of the lower and the first of the higher ranges are carried over. Rows of one instant
    may fill several ranges.
    """
    axis_type = axis.schema[axis_col].dataType
    stamp = lambda c: F.unix_micros(c.cast("timestamp"))
    payload = F.struct(*[rows[c] for c in rows.columns])
    ticks = axis.where(F.col(axis_col).isNotNull()).select(stamp(F.col(axis_col)).alias("t"), F.col(axis_col).alias("tick")).distinct()
    both = ticks.select("t", F.lit(0).cast("long").alias("salt"), "tick", F.lit(None).cast(rows.schema).alias("row")).union(
        # a salt splits the rows of one instant; instants stand before them
        rows.select(stamp(rows[time_col]).alias("t"), F.monotonically_increasing_id() + 1, F.lit(None).cast(axis_type), payload)
    )
    keys = [F.col("t").asc_nulls_first(), F.col("salt")]
    spread = both.repartitionByRange(ranges, *keys) if ranges else both.repartitionByRange(*keys)
    spread = materialize(spread.withColumn("range", F.spark_partition_id()), "instants")
    seen = F.when(F.col("tick").isNotNull(), F.struct("t", "tick"))
    # one row for each range
    edges = spread.groupBy("range").agg(F.min(seen).alias("first"), F.max(seen).alias("last"))
    order = Window.partitionBy(F.lit(0)).orderBy("range")
    carried = edges.select(
        "range", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("from_below"), F.min("first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("from_above")
    )
    # both look back in their own order: a frame that ends with the partition is summed anew for every row
    rising = Window.partitionBy("range").orderBy(F.col("t").asc_nulls_first(), "salt")
    falling = Window.partitionBy("range").orderBy(F.col("t").desc_nulls_last(), F.desc("salt"))
    before = F.max(seen).over(rising.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(seen).over(falling.rowsBetween(Window.unboundedPreceding, 0))
    met = spread.withColumns({"before": before, "after": after}).where(F.col("row").isNotNull()).join(carried, "range", "left")
    low, high = F.coalesce("before", "from_below"), F.coalesce("after", "from_above")
    nearer = F.when(high.isNull() | (F.col("t") - low["t"] <= high["t"] - F.col("t")), low).otherwise(high)
    return met.select("row.*", F.when(F.col("t").isNotNull(), nearer["tick"]).alias("nearest_time"))


def in_set(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows outside, rows inside) a key set: train and validation parts."""
    unique = members.select(*keys).distinct()
    return df.join(unique, list(keys), "left_anti"), df.join(unique, list(keys), "left_semi")


def within_box(left: DataFrame, right: DataFrame, half_width: float, left_xy=("lon", "lat"), right_xy=("lon", "lat"), prefix: str = "r_") -> DataFrame:
    """Pairs whose coordinates differ by at most ``half_width`` on both axes.

    Bucketed on squares of twice the half width: the left side is copied to the (at most
    four) buckets its box touches, the right side stays single, so each pair appears once.
    """
    size = 2 * half_width
    right = right.withColumnsRenamed({c: f"{prefix}{c}" for c in right.columns})
    rx, ry = F.col(f"{prefix}{right_xy[0]}"), F.col(f"{prefix}{right_xy[1]}")
    lx, ly = F.col(left_xy[0]), F.col(left_xy[1])

    def span(c: Column) -> Column:
        pad = half_width * (1 + 1e-9)
        return F.sequence(F.floor((c - pad) / size).cast("bigint"), F.floor((c + pad) / size).cast("bigint"))

    spread = left.withColumn("_bx", F.explode(span(lx))).withColumn("_by", F.explode(span(ly)))
    keyed = right.withColumns({"_bx": F.floor(rx / size).cast("bigint"), "_by": F.floor(ry / size).cast("bigint")})
    near = (F.abs(rx - lx) <= F.lit(half_width)) & (F.abs(ry - ly) <= F.lit(half_width))
    return spread.join(keyed, ["_bx", "_by"]).where(near).drop("_bx", "_by")


def degrees_for_km(km: float) -> float:
    """Latitude span of a distance."""
    from hazegrid.constants import EARTH_RADIUS_KM

    return math.degrees(km / EARTH_RADIUS_KM)
