"""Columnar tables in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid import constants as K
from hazegrid.functions.geo import finite


def missing_as_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn NaN and infinities of floating columns into NULL, the only missing marker used."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    picked = [c for c in floating if columns is None or c in columns]
    return df.withColumns({c: finite(F.col(c)) for c in picked}) if picked else df


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan of some columns; NaN becomes NULL on the way in."""
    df = spark.read.parquet(path)
    return missing_as_null(df.select(*columns) if columns else df)


def add_partition_columns(df: DataFrame, date_col: str = "date") -> DataFrame:
    """``year`` and ``month`` of the date, the storage partitioning of every analysis table."""
    return df.withColumns({"year": F.year(date_col), "month": F.month(date_col)})


def as_stored(df: DataFrame) -> DataFrame:
    """Predictors and targets as 32-bit floats, the at-rest type."""
    stored = [c for c in dict.fromkeys(K.PREDICTORS + K.TARGETS) if c in df.columns]
    return df.withColumns({c: F.col(c).cast("float") for c in stored}) if stored else df


def training_table(df: DataFrame) -> DataFrame:
    return add_partition_columns(as_stored(df))


def inference_table(cells: DataFrame) -> DataFrame:
    """Long table of every cell and day with at least one predictor present.

    Coordinates are keys, not evidence: they never keep an otherwise empty row.
    """
    predictors = [c for c in dict.fromkeys(K.PREDICTORS) if c in cells.columns and c not in K.TABLE_KEYS]
    keys = [c for c in (*K.TABLE_KEYS, "row", "col") if c in cells.columns]
    return training_table(cells.select(*keys, *predictors).dropna(how="all", subset=predictors))


def write_partitioned(df: DataFrame, path: str, partition_cols: Sequence[str] = K.PARTITION_COLUMNS) -> None:
    """Hive-partitioned Parquet. A re-run replaces only the partitions it contains.

    Rows are rebalanced on the partition columns before the write: small partitions share a
    task and a month that holds most of the data is split over many.
    """
    (
        df.hint("rebalance", *partition_cols)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_cols)
        .parquet(path)
    )


def read_months(spark: SparkSession, path: str, start: str, end: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with ``start <= date < end``; months outside the window are never opened."""
    df = spark.read.parquet(path)
    key = F.col("year") * 12 + F.col("month") - 1
    y0, m0 = (int(v) for v in start.split("-")[:2])
    y1, m1 = (int(v) for v in end.split("-")[:2])
    df = df.where((key >= y0 * 12 + m0 - 1) & (key <= y1 * 12 + m1 - 1))
    df = df.where((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date")))
    return missing_as_null(df.select(*columns) if columns else df)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
