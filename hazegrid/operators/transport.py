"""Wind statistics, back-trajectories and fires along a path."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hazegrid import constants as K
from hazegrid.functions.geo import haversine_km, wind_from_direction, wind_speed
from hazegrid.grid import GridSpec
from hazegrid.session import materialize


def add_wind(df: DataFrame, u: str = "u_wind", v: str = "v_wind") -> DataFrame:
    return df.withColumns(
        {"wind_speed": wind_speed(F.col(u), F.col(v)), "wind_from": wind_from_direction(F.col(u), F.col(v))}
    )


def wind_rose(df: DataFrame, u: str = "u_wind", v: str = "v_wind", sectors: int = 16, speed_edges: Sequence[float] = (0, 2, 4, 6, 8, 10), keys: Sequence[str] = ()) -> DataFrame:
    """Percent of readings per direction sector and speed bin.

    Sectors are centred on north. A speed bin is named by its lower edge; the last is open.
    """
    width = 360.0 / sectors
    sector = F.pmod(F.floor((F.col("wind_from") + F.lit(width / 2)) / F.lit(width)), F.lit(sectors)).cast("int")
    edges = sorted(float(e) for e in speed_edges)
    speed_bin = F.coalesce(*[F.when(F.col("wind_speed") >= F.lit(e), F.lit(e)) for e in reversed(edges)])
    counted = (
        add_wind(df.where(F.col(u).isNotNull() & F.col(v).isNotNull()), u, v)
        .groupBy(*keys, sector.alias("sector"), speed_bin.alias("speed_bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("speed_bin").isNotNull())
    )
    # at most sectors x bins rows per key are left here
    total = F.sum("n").over(Window.partitionBy(*[F.col(k) for k in keys])) if keys else counted.agg(F.sum("n")).scalar()
    return counted.withColumn("percent", F.lit(100.0) * F.col("n") / total)


def _frame_index(t: Column, axis_start: int, axis_step: int, n_frames: int) -> Column:
    """Nearest frame of a regular time axis; the earlier wins a tie; clamped to the record."""
    pos = F.ceil((t - F.lit(axis_start)).cast("double") / F.lit(float(axis_step)) - F.lit(0.5))
    return F.greatest(F.lit(0), F.least(F.lit(n_frames - 1), pos)).cast("int")


def back_trajectories(
    parcels: DataFrame,
    winds: DataFrame,
    grid: GridSpec,
    axis_start: int,
    axis_step: int,
    n_frames: int,
    hours: float = 48,
    dt_hours: float = 1.0,
    u: str = "u_wind",
    v: str = "v_wind",
) -> DataFrame:
    """Paths of many air parcels traced backwards through a gridded wind field.

    ``parcels``: ``parcel_id, lon, lat, time`` (epoch seconds). ``winds``: ``t_idx, row, col,
    u, v`` on a regular time axis in epoch seconds. A parcel that reaches the rim of cell
    centres is clamped to it, keeps that node and stops; one in a cell without wind stops
    where it is.

    All parcels advance together, one inner equi-join on (t_idx, row, col) per step. The
    winds are stored once by frame and a step opens only the frames its parcels can be in.
    Every step is written out: its rows are the nodes of the result, the next step starts from
    a file of known size (so the optimiser can check whether it fits a broadcast), and a lost
    executor costs one step.
    """
    w = grid
    west, east = w.min_lon + w.resolution / 2, w.min_lon + w.resolution / 2 + (w.n_cols - 1) * w.resolution
    north = w.max_lat - w.resolution / 2
    south = north - (w.n_rows - 1) * w.resolution
    seconds = dt_hours * 3600.0
    metres = K.EARTH_RADIUS_KM * 1000
    field = winds.select("t_idx", "row", "col", F.col(u).alias("_u"), F.col(v).alias("_v")).where(
        F.col("_u").isNotNull() & F.col("_v").isNotNull()
    )
    field = materialize(field.repartition("t_idx", (F.col("row") / 64).cast("int")), "winds", ["t_idx"])
    keep = ["parcel_id", "step", "time", "lon", "lat"]
    start = parcels.select("parcel_id", F.lit(0).alias("step"), F.col("time").cast("bigint").alias("time"), "lon", "lat")
    active = materialize(start, "parcels")
    nodes = active.select(*keep)
    latest, earliest = active.agg(F.max("time"), F.min("time")).first()
    if latest is None:
        return nodes

    def frame_of(t: float) -> int:
        return max(0, min(n_frames - 1, math.ceil((t - axis_start) / axis_step - 0.5)))

    for k in range(1, int(hours / dt_hours) + 1):
        row, col = w.nearest_index(F.col("lon"), F.col("lat"))
        t_idx = _frame_index(F.col("time"), axis_start, axis_step, n_frames)
        gone = (k - 1) * int(seconds)
        frames = field.where(F.col("t_idx").between(frame_of(earliest - gone), frame_of(latest - gone)))
        at = active.withColumns({"row": row, "col": col, "t_idx": t_idx}).join(frames, ["t_idx", "row", "col"])
        new_lat = F.col("lat") - (F.col("_v") * F.lit(seconds)) / F.lit(metres) * F.lit(180 / math.pi)
        new_lon = F.col("lon") - (F.col("_u") * F.lit(seconds)) / (
            F.lit(metres) * F.cos(F.radians("lat"))
        ) * F.lit(180 / math.pi)
        moved = at.withColumns({"_lon": new_lon, "_lat": new_lat}).select(
            "parcel_id",
            F.lit(k).alias("step"),
            (F.col("time") - F.lit(int(seconds))).alias("time"),
            F.greatest(F.lit(west), F.least(F.lit(east), F.col("_lon"))).alias("lon"),
            F.greatest(F.lit(south), F.least(F.lit(north), F.col("_lat"))).alias("lat"),
            (F.col("_lon").between(west, east) & F.col("_lat").between(south, north)).alias("_inside"),
        )
        stored = materialize(moved, "parcels")
        nodes = nodes.unionByName(stored.select(*keep))
        active = stored.where("_inside")
    return nodes


#: About the most coordinates of fires in one array.
SPOTS = 512
#: Distances that are computed at once.
PAIRS = 1 << 19


def _fires_met(lon: pa.Array, lat: pa.Array, fire_lon: pa.Array, fire_lat: pa.Array, fires: pa.Array, radius_km: float) -> pa.Array:
    """How many of the fires of each row lie within the radius of any node of that row."""
    nodes, spots = np.diff(lon.offsets.to_numpy()).astype(np.int64), np.diff(fire_lon.offsets.to_numpy()).astype(np.int64)
    x, y = np.radians(lon.flatten().to_numpy()), np.radians(lat.flatten().to_numpy())
    u, v = np.radians(fire_lon.flatten().to_numpy()), np.radians(fire_lat.flatten().to_numpy())
    n = fires.flatten().to_numpy()
    x0, u0 = np.cumsum(nodes) - nodes, np.cumsum(spots) - spots
    ends = np.cumsum(nodes * spots)
    out, row = np.zeros(len(nodes), np.int64), 0
    while row < len(nodes):
        # whole rows, one at least
        upto = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PAIRS, side="right")))
        of, k = np.arange(row, upto), nodes[row:upto] * spots[row:upto]
        owner = np.repeat(of, k)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(k) - k, k)
        # the nodes of one coordinate follow each other
        i, j = x0[owner] + place % nodes[owner], u0[owner] + place // nodes[owner]
        half = np.sin((y[i] - v[j]) / 2) ** 2 + np.cos(v[j]) * np.cos(y[i]) * np.sin((x[i] - u[j]) / 2) ** 2
        hit = 2 * K.EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(half, 1.0))) <= radius_km
        met = np.logical_or.reduceat(hit, np.flatnonzero(place % nodes[owner] == 0))
        first = np.arange(u0[row], u0[row] + spots[row:upto].sum())
        out[row:upto] = np.bincount(np.repeat(of - row, spots[row:upto]), met * n[first], upto - row).astype(np.int64)
        row = upto
    return pa.array(out)


def fires_along_path(
    path: DataFrame, fires: DataFrame, radius_km: float = 50.0, path_key: Sequence[str] = ("parcel_id",),
    lon: str = "longitude", lat: str = "latitude",
) -> DataFrame:
    """Fires within ``radius_km`` of any node, counted once per path.

    Fires at one coordinate are merged first and dealt to latitude-longitude buckets. A path goes once to each bucket that
    the radius of any node touches, with those nodes in one array, so a pair of path and coordinate arises once and is
    counted where it arises. The longitude reach of a node grows with its latitude; near a pole it spans all longitudes.
    """
    reach = math.degrees(radius_km / K.EARTH_RADIUS_KM) * (1 + 1e-9)
    size = max(reach, 1e-6)
    spots = fires.groupBy(F.col(lon).alias("_flon"), F.col(lat).alias("_flat")).agg(F.count(F.lit(1)).alias("_fires"))

    def bucket(c: Column) -> Column:
        return F.floor(c / F.lit(size)).cast("bigint")

    rad_lat, angle = F.radians("lat"), radius_km / K.EARTH_RADIUS_KM
    ratio = F.lit(math.sin(min(angle, math.pi / 2))) / F.cos(rad_lat)
    lon_reach = F.when(F.abs(rad_lat) + F.lit(angle) >= F.lit(math.pi / 2), F.lit(360.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), ratio))) * F.lit(1 + 1e-9)
    )
    spread = path.select(*path_key, "lon", "lat").withColumn(
        "_by", F.explode(F.sequence(bucket(F.col("lat") - F.lit(reach)), bucket(F.col("lat") + F.lit(reach))))
    ).withColumn("_bx", F.explode(F.sequence(bucket(F.col("lon") - lon_reach), bucket(F.col("lon") + lon_reach))))
    near = spread.groupBy(*path_key, "_bx", "_by").agg(F.collect_set(F.struct("lon", "lat")).alias("_nodes"))
    keyed = spots.where(F.col("_flon").isNotNull() & F.col("_flat").isNotNull()).withColumns({"_bx": bucket(F.col("_flon")), "_by": bucket(F.col("_flat"))})
    # a bucket's coordinates come in arrays of SPOTS at most
    sized = keyed.groupBy("_bx", "_by").agg(F.ceil(F.count(F.lit(1)) / F.lit(SPOTS / 2)).alias("_parts"))
    dealt = keyed.join(sized, ["_bx", "_by"]).withColumn("_part", F.pmod(F.xxhash64("_flon", "_flat"), F.col("_parts")))
    arrays = dealt.groupBy("_bx", "_by", "_part").agg(F.collect_list(F.struct("_flon", "_flat", "_fires")).alias("_spots"))
    pairs = near.join(arrays, ["_bx", "_by"]).select(*path_key, *[F.col(f"_{a}.{c}").alias(c) for a, c in (("nodes", "lon"), ("nodes", "lat"), ("spots", "_flon"), ("spots", "_flat"), ("spots", "_fires"))])
    keys = list(path_key)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met = _fires_met(b.column("lon"), b.column("lat"), b.column("_flon"), b.column("_flat"), b.column("_fires"), radius_km)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], met], names=[*keys, "_met"])

    kinds = StructType([*[pairs.schema[k] for k in keys], StructField("_met", LongType())])
    found = pairs.mapInArrow(count, kinds).groupBy(*keys).agg(F.sum("_met").alias("fires_along_path"))
    everyone = path.select(*path_key).distinct()
    return everyone.join(found, list(path_key), "left").withColumn(
        "fires_along_path", F.coalesce("fires_along_path", F.lit(0)).cast("bigint")
    )


def trajectory_summary(path: DataFrame, fires: DataFrame | None = None, radius_km: float = 150.0) -> DataFrame:
    """Nodes, end point and (optionally) fires per path."""
    ends = path.groupBy("parcel_id").agg(
        F.count(F.lit(1)).alias("trajectory_points"),
        F.max_by("lon", "step").alias("end_lon"),
        F.max_by("lat", "step").alias("end_lat"),
    )
    return ends if fires is None else ends.join(fires_along_path(path, fires, radius_km), "parcel_id")


def fire_density(
    fires: DataFrame, extent: Sequence[float] = K.FIRE_DENSITY_EXTENT, bins: int = K.FIRE_DENSITY_BINS,
    lon: str = "longitude", lat: str = "latitude",
) -> DataFrame:
    """Counts on a fixed 2-D histogram; the upper edges belong to the last bins; empty bins absent."""
    x0, x1, y0, y1 = (float(v) for v in extent)

    def bin_of(c: Column, lo: float, hi: float) -> Column:
        return F.least(F.lit(bins - 1), F.floor((c - F.lit(lo)) / F.lit((hi - lo) / bins))).cast("int")

    inside = F.col(lon).between(x0, x1) & F.col(lat).between(y0, y1)
    return (
        fires.where(inside)
        .groupBy(bin_of(F.col(lon), x0, x1).alias("x_bin"), bin_of(F.col(lat), y0, y1).alias("y_bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
