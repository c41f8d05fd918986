"""JSON sinks for layers and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(documents: DataFrame, path: str, json_col: str = "json") -> None:
    """One compact JSON document per line; files are written in parallel."""
    documents.select(F.col(json_col).alias("value")).write.mode("overwrite").text(path)


def write_layers(layers: DataFrame, path: str) -> None:
    """(layer, json) rows into one folder per layer."""
    layers.select("layer", F.col("json").alias("value")).write.mode("overwrite").partitionBy("layer").text(path)


def gas_cell_documents(cells: DataFrame, gases: list[str]) -> DataFrame:
    """One JSON object per cell with rounded place and stretched gas columns."""
    return cells.select(
        F.to_json(
            F.struct(
                F.round("lon", 2).alias("lon"), F.round("lat", 2).alias("lat"), *[F.round(g, 3).alias(g) for g in gases]
            )
        ).alias("json")
    )
