"""Train / validation splits that any engine can reproduce: hashes and calendar cuts only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.functions.geo import portable_hash
from hazegrid.grid import floor_divide
from hazegrid.operators.temporal import date_axis


def held_out_years(df: DataFrame, years: Sequence[int], date_col: str = "date") -> tuple[DataFrame, DataFrame]:
    """(train, test): test rows fall in one of the years."""
    in_test = F.coalesce(F.year(date_col).isin(*years), F.lit(False))
    return df.where(~in_test), df.where(in_test)


def last_dates(df: DataFrame, fraction: float = 0.2, date_col: str = "date") -> DataFrame:
    """Adds ``is_test``: rows on the last ``fraction`` of distinct dates."""
    axis = date_axis(df, date_col)
    n = axis.agg(F.count(F.lit(1)).alias("n")).scalar()
    position = F.floor(n.cast("double") * F.lit(1 - fraction))
    cut = axis.where(F.col("t_idx") == position).agg(F.min(date_col)).scalar()
    return df.withColumn("is_test", F.col(date_col) >= cut)


def block_keys(lon: Column, lat: Column, block_deg: float) -> tuple[Column, Column]:
    return floor_divide(lon, block_deg).cast("bigint"), floor_divide(lat, block_deg).cast("bigint")


def spatial_folds(df: DataFrame, block_deg: float = 0.5, k: int = 10, seed: int = 42) -> DataFrame:
    """Adds ``fold``: whole lon/lat blocks dealt to ``k`` near-equal folds in seeded hash order.

    The blocks (at most the globe over block size) are ordered, never the rows.
    """
    bx, by = block_keys(F.col("lon"), F.col("lat"), block_deg)
    keyed = df.withColumns({"_bx": bx, "_by": by})
    blocks = keyed.select("_bx", "_by").distinct()
    order = Window.orderBy(portable_hash(F.concat_ws("_", "_bx", "_by"), str(seed)), "_bx", "_by")
    dealt = blocks.withColumn("fold", (F.ntile(k).over(order) - 1).cast("int"))
    return keyed.join(dealt, ["_bx", "_by"]).drop("_bx", "_by")


def random_folds(df: DataFrame, key: Column, k: int = 5, seed: int = 0) -> DataFrame:
    """Adds ``fold`` from a seeded hash of a row key: stable under any partitioning."""
    return df.withColumn("fold", (portable_hash(key, str(seed)) % k).cast("int"))


def random_test(df: DataFrame, key: Column, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    return df.withColumn("is_test", portable_hash(key, str(seed)) % 1_000_000 < int(fraction * 1_000_000))


def group_folds(df: DataFrame, group: str = "station_id", k: int = 5, seed: int = 0) -> DataFrame:
    """Adds ``fold``: all rows of a group share one."""
    return random_folds(df, F.col(group), k, seed)
