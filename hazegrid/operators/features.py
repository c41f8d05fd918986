"""Derived predictors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.functions.geo import cyclic_day


def add_hcho_no2_ratio(df: DataFrame, eps: float = 1e-30) -> DataFrame:
    if not {"hcho", "no2"} <= set(df.columns):
        return df
    return df.withColumn("fnr", F.try_divide(F.col("hcho").cast("double"), F.col("no2").cast("double") + F.lit(eps)))


def add_cyclic_day(df: DataFrame, date_col: str = "date") -> DataFrame:
    sine, cosine = cyclic_day(F.col(date_col))
    return df.withColumns({"doy_sin": sine, "doy_cos": cosine})


def add_interactions(df: DataFrame) -> DataFrame:
    products = {"aod_blh": ("aod", "blh"), "photo_index": ("temperature", "solar_radiation")}
    made = {n: F.col(a) * F.col(b) for n, (a, b) in products.items() if {a, b} <= set(df.columns)}
    return df.withColumns(made) if made else df


def series_key(df: DataFrame) -> list[str]:
    """``station_id`` where there is one, otherwise the cell."""
    if "station_id" in df.columns:
        return ["station_id"]
    return ["row", "col"] if {"row", "col"} <= set(df.columns) else ["lat", "lon"]


def add_lags(
    df: DataFrame,
    columns: Sequence[str],
    lags: Sequence[int] = (1, 2, 3),
    roll: int = 3,
    group: Sequence[str] | None = None,
    order: Sequence[str] = ("date",),
    chunk: str | None = "month",
) -> DataFrame:
    """Row-based lags and the mean of the ``roll`` preceding rows, per series.

    The current row never enters its own rolling mean. ``order`` must be a total order
    inside a series for repeatable results.

    A single busy series must not become one task, so each series is cut into calendar
    chunks. Every chunk also receives the last rows before it (found among the last few rows
    of each earlier chunk, which are pruned before they are shuffled), the windows run per
    (series, chunk), and the carried rows are dropped again. ``chunk=None`` runs one window
    per series instead, for record lengths known to be short.
    """
    cols = [c for c in columns if c in df.columns]
    if not cols:
        return df
    keys = list(group or series_key(df))
    depth = max([*lags, roll])

    def with_lags(frame: DataFrame, part: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*order)
        back = w.rowsBetween(-roll, -1)
        made = {f"{c}_lag{k}": F.lag(c, k).over(w) for c in cols for k in lags}
        made |= {f"{c}_roll{roll}": F.avg(c).over(back) for c in cols}
        return frame.withColumns(made)

    if chunk is None:
        return with_lags(df, keys)

    body = df.withColumns({"_chunk": F.date_trunc(chunk, F.col(order[0]).cast("timestamp")), "_carried": F.lit(False)})
    newest = Window.partitionBy(*keys, "_chunk").orderBy(*[F.desc(c) for c in order])
    slim = body.select(*dict.fromkeys([*keys, "_chunk", *order, *cols]))
    tails = slim.withColumn("_from_end", F.row_number().over(newest)).where(F.col("_from_end") <= depth)
    # at most `depth` rows per chunk are left, so ordering them per series is cheap
    tails = tails.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    starts = tails.groupBy(*keys, "_chunk").agg(F.min("_pos").alias("_start"))
    needs = starts.select(
        *keys,
        F.col("_chunk").alias("_to"),
        F.explode(F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda i: F.col("_start") - i)).alias("_pos"),
    ).where(F.col("_pos") >= 1)
    carried = needs.join(tails, [*keys, "_pos"]).select(
        *[c for c in slim.columns if c != "_chunk"], F.col("_to").alias("_chunk"), F.lit(True).alias("_carried")
    )
    joined = with_lags(body.unionByName(carried, allowMissingColumns=True), [*keys, "_chunk"])
    return joined.where(~F.col("_carried")).drop("_chunk", "_carried")


def engineer(df: DataFrame, lag_columns: Sequence[str] | None = None, **lag_options) -> DataFrame:
    """The whole chain in its fixed order."""
    out = df.transform(add_hcho_no2_ratio).transform(add_cyclic_day).transform(add_interactions)
    return out.transform(add_lags, lag_columns, **lag_options) if lag_columns else out


def channel_statistics(df: DataFrame, channels: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) per channel in one pass; a zero deviation becomes 1."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(channels)],
        *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(channels)],
    ).first()
    return {c: (row[f"m_{i}"], row[f"s_{i}"] or 1.0) for i, c in enumerate(channels)}


def standardize(df: DataFrame, channels: Sequence[str], stats: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Z-scores. Without ``stats`` the statistics come from ``df`` as a scalar subquery (lazy)."""
    if stats is not None:
        return df.withColumns({c: (F.col(c) - F.lit(stats[c][0])) / F.lit(stats[c][1]) for c in channels})
    own = df.agg(
        F.struct(
            *[
                F.struct(F.avg(c).alias("m"), F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias("s")).alias(c)
                for c in channels
            ]
        ).alias("own")
    ).scalar()
    return df.withColumns(
        {c: (F.col(c) - own.getField(c).getField("m")) / own.getField(c).getField("s") for c in channels}
    )


def destandardize(df: DataFrame, channels: Sequence[str], stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(stats[c][1]) + F.lit(stats[c][0]) for c in channels})
