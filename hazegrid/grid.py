"""Regular longitude/latitude grids addressed by integer row and column.

Row 0 is the northernmost row, column 0 the westernmost column, coordinates are cell
centres. Operators join on the integers and never on floating coordinates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _centre_count(span: float, res: float) -> int:
    # number of centres half a cell inside the low edge and strictly below the high edge
    return max(0, math.ceil((span - res / 2) / res - 1e-9))


def floor_divide(x: Column, step: float) -> Column:
    """Whole steps below ``x``, exact where ``x / step`` would round up to an integer."""
    return F.floor((x - F.pmod(x, F.lit(float(step)))) / F.lit(float(step)) + F.lit(0.5))


@dataclass(frozen=True)
class GridSpec:
    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float
    resolution: float

    @property
    def n_cols(self) -> int:
        return _centre_count(self.max_lon - self.min_lon, self.resolution)

    @property
    def n_rows(self) -> int:
        return _centre_count(self.max_lat - self.min_lat, self.resolution)

    # -- index -> coordinate ------------------------------------------------------------
    def lon_of(self, col: Column | str) -> Column:
        c = F.col(col) if isinstance(col, str) else col
        return F.lit(self.min_lon + self.resolution / 2) + c.cast("double") * F.lit(self.resolution)

    def lat_of(self, row: Column | str) -> Column:
        r = F.col(row) if isinstance(row, str) else row
        return F.lit(self.max_lat - self.resolution / 2) - r.cast("double") * F.lit(self.resolution)

    def with_coordinates(self, df: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
        return df.withColumns({"lon": self.lon_of(col), "lat": self.lat_of(row)})

    # -- coordinate -> index ------------------------------------------------------------
    def contains(self, lon: Column, lat: Column) -> Column:
        """Half-open box test: west and south edges belong to the grid."""
        return (
            (lon >= F.lit(self.min_lon)) & (lon < F.lit(self.max_lon))
            & (lat >= F.lit(self.min_lat)) & (lat < F.lit(self.max_lat))
        )

    def cell_index(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(row, col) of the cell that contains a point; NULL outside the box.

        A point exactly on the south edge is inside the box; it is given to the last row.
        """
        inside = self.contains(lon, lat)
        col = floor_divide(lon - F.lit(self.min_lon), self.resolution)
        row = floor_divide(F.lit(self.max_lat) - lat, self.resolution)
        row = F.least(row, F.lit(self.n_rows - 1))
        col = F.least(col, F.lit(self.n_cols - 1))
        return F.when(inside, row).cast("int"), F.when(inside, col).cast("int")

    def nearest_index(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(row, col) of the closest cell centre, clamped to the grid; no distance limit.

        A point halfway between two centres goes to the eastern / northern one.
        """
        col = F.floor((lon - F.lit(self.min_lon + self.resolution / 2)) / F.lit(self.resolution) + F.lit(0.5))
        row = F.ceil((F.lit(self.max_lat - self.resolution / 2) - lat) / F.lit(self.resolution) - F.lit(0.5))
        return (
            F.greatest(F.lit(0), F.least(F.lit(self.n_rows - 1), row)).cast("int"),
            F.greatest(F.lit(0), F.least(F.lit(self.n_cols - 1), col)).cast("int"),
        )

    # -- cells --------------------------------------------------------------------------
    def cells(self, spark: SparkSession) -> DataFrame:
        """Every cell as (row, col, lon, lat), generated in parallel from one range."""
        n = F.lit(self.n_cols)
        cells = spark.range(self.n_rows * self.n_cols).select(
            F.floor(F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col")
        )
        return self.with_coordinates(cells)

    def empty(self, spark: SparkSession, name: str = "value") -> DataFrame:
        """The grid with one all-NULL float variable."""
        return self.cells(spark).withColumn(name, F.lit(None).cast("float"))
