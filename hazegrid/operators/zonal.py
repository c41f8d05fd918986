"""Statistics of a gridded field over polygons, with the exact covered share of every cell.

Every edge of a ring is cut at the rows and columns of the grid. A piece in a cell says how much area lies to its right
inside the cell and how much height it closes for all cells further right, so a running sum along the row gives the
share of each touched cell, and untouched cells in between are spans of one share. Holes are rings of the other sign.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.grid import GridSpec
from hazegrid.operators.ranking import running_sums
from hazegrid.session import discard, materialize

#: Columns of one join bucket along a row.
BUCKET = 64
#: Shares below this come from rounding.
LEAST = 1e-12


def ring_edges(vertices: DataFrame, grid: GridSpec) -> DataFrame:
    """``zone, x0, y0, x1, y1, sign`` of the edges that are not horizontal, in cells from the north-west corner.

    ``vertices`` have ``zone, ring, seq, hole, lon, lat``; rings close by themselves and may turn either way.
    """
    x = (F.col("lon") - F.lit(grid.min_lon)) / F.lit(grid.resolution)
    y = (F.lit(grid.max_lat) - F.col("lat")) / F.lit(grid.resolution)
    ring = Window.partitionBy("zone", "ring")
    order = ring.orderBy("seq")
    placed = vertices.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("zone", "ring", "seq", "hole", x.alias("x0"), y.alias("y0"))
    first = ring.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = placed.withColumns({c + "1": F.coalesce(F.lead(c + "0").over(order), F.first(c + "0").over(first)) for c in "xy"})
    area = F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")).over(ring)
    sign = -F.signum(area) * F.when(F.col("hole"), -1).otherwise(1)
    return edges.withColumn("sign", sign).where("y0 <> y1").select("zone", "x0", "y0", "x1", "y1", "sign")


def _clip(c: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(c, low), high)


def zone_spans(vertices: DataFrame, grid: GridSpec) -> DataFrame:
    """``zone, row, first, last, share``: columns ``first`` to ``last`` of a row that a zone covers to the same share."""
    e = ring_edges(vertices, grid)
    top, bottom = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = F.sequence(F.greatest(F.floor(top), F.lit(0)), F.least(F.ceil(bottom) - 1, F.lit(grid.n_rows - 1)))
    inside = (bottom > 0) & (top < grid.n_rows)
    cut = e.where(inside).select("*", F.explode(rows).alias("row"))
    at = lambda y: F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    low, high = F.greatest(top, F.col("row")), F.least(bottom, F.col("row") + 1)
    up = F.when(F.col("y1") > F.col("y0"), F.col("sign")).otherwise(-F.col("sign"))
    cut = cut.withColumns({"dy": (high - low) * up, "xa": at(low), "xb": at(high)}).where("dy <> 0")
    left, right = F.least("xa", "xb"), F.greatest("xa", "xb")
    # everything west of the grid is one column, what is east of it closes no cell
    cols = F.sequence(F.greatest(F.floor(left), F.lit(-1)), F.greatest(F.lit(-1), F.least(F.floor(right), F.lit(grid.n_cols - 1))))
    cut = cut.where(left < grid.n_cols).select("zone", "row", "dy", left.alias("left"), right.alias("right"), F.explode(cols).alias("col"))
    from_ = F.when(F.col("col") < 0, F.col("left")).otherwise(_clip(F.col("left"), F.col("col"), F.col("col") + 1))
    to = _clip(F.col("right"), from_, F.col("col") + 1)
    part = F.col("dy") * F.when(F.col("right") > F.col("left"), (to - from_) / (F.col("right") - F.col("left"))).otherwise(1.0)
    pieces = cut.select("zone", "row", "col", part.alias("closes"), (part * (F.col("col") + 1 - (from_ + to) / 2)).alias("area"))
    cells = pieces.groupBy("zone", "row", "col").agg(F.sum("closes").alias("closes"), F.sum("area").alias("area"))
    along = Window.partitionBy("zone", "row").orderBy("col")
    before = F.coalesce(F.sum("closes").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    following = F.coalesce(F.lead("col").over(along), F.lit(grid.n_cols))
    cells = cells.withColumns({"share": before + F.col("area"), "after": before + F.col("closes"), "next": following})
    touched = F.struct(F.col("col").alias("first"), F.col("col").alias("last"), "share")
    between = F.struct((F.col("col") + 1).alias("first"), (F.col("next") - 1).alias("last"), F.col("after").alias("share"))
    spans = F.array(F.when(F.col("col") >= 0, touched), F.when(F.col("next") > F.col("col") + 1, between))
    out = cells.select("zone", F.col("row").cast("int").alias("row"), F.explode(F.array_compact(spans)).alias("s"))
    share = F.when(F.abs(F.col("s.share") - 1) < LEAST, 1.0).otherwise(F.col("s.share"))
    out = out.select("zone", "row", F.col("s.first").cast("int").alias("first"), F.col("s.last").cast("int").alias("last"), share.alias("share"))
    return out.where(F.col("share") > LEAST)


def zone_cells(spans: DataFrame, cells: DataFrame) -> DataFrame:
    """``zone, share`` beside every cell (``row, col`` and more) that a zone covers, one row per zone and cell.

    Both sides meet in buckets of ``BUCKET`` columns of a row. Aggregate ``cells`` to one row per cell before.
    """
    buckets = F.sequence(F.floor(F.col("first") / BUCKET), F.floor(F.col("last") / BUCKET))
    # stored: planned from the few vertices, the spans would pass for small and be sent whole to every executor
    dealt = materialize(spans.select("zone", "row", "first", "last", "share", F.explode(buckets).alias("bucket")), "spans")
    joined = cells.withColumn("bucket", F.floor(F.col("col") / BUCKET)).join(dealt, ["row", "bucket"])
    return joined.where(F.col("col").between(F.col("first"), F.col("last"))).drop("bucket", "first", "last")


def zonal_statistics(covered: DataFrame, value: str, weight: Column, probs: Sequence[float] = (0.5,)) -> DataFrame:
    """``zone, n_cells, weight, mean`` and ``q50``-like columns of the cells with a value.

    A cell weighs ``share * weight``. A quantile is the least value at which the weights of the values up to it reach
    that part of all weights. ``covered`` has one row for each zone and cell, as :func:`zone_cells` gives them.
    """
    weighed = covered.where(F.col(value).isNotNull()).select("zone", "row", "col", F.col(value).cast("double").alias("v"), (F.col("share") * weight).alias("w"))
    held = materialize(weighed.where("w > 0"), "weighed")
    # by value and place: no task gathers the cells of a zone or of one value to sum them before they are ordered
    run = running_sums(held, ["v", "row", "col"], "w", ["zone"])
    discard(held)
    reached = lambda p: F.col("upto") >= F.col("total") * F.lit(p) * F.lit(1 - 1e-12)
    quantiles = [F.min(F.when(reached(p), F.col("v"))).alias(f"q{round(100 * p)}") for p in probs]
    return run.groupBy("zone").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("w").alias("weight"), (F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mean"), *quantiles)


def exposure_shares(covered: DataFrame, band: Column, people: str) -> DataFrame:
    """``zone, band, people, share``: who lives under each band, as a number and as a share of the zone's people.

    ``band`` may be null for cells without a value; their people count in the total.
    """
    held = covered.where(F.col(people).isNotNull()).groupBy("zone", band.alias("band")).agg(F.sum(F.col("share") * F.col(people)).alias("people"))
    total = F.sum("people").over(Window.partitionBy("zone"))
    return held.withColumn("share", F.try_divide("people", total))
