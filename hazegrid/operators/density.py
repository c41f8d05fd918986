"""Density clusters of points (DBSCAN) without listing pairs of points.

Points fall into squares whose diagonal is the radius, so all points of a square are neighbours: a square with
``min_points`` of them holds core points only. Only points of thinner squares, of which every square has a bounded number
around it, count their neighbours. Squares with core points are joined where some two of them are within the radius;
that is read off bounding boxes, which are cut finer only where they leave it open. Border points go to the core point
with the least id.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.operators.components import contract
from hazegrid.session import discard, materialize

#: Cuts of a box along each axis when it is refined.
FINER = 8


def _square(c: str, side: float) -> Column:
    return F.floor(F.col(c) / F.lit(side)).cast("long")


def _around(df: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    """Rows sent to the squares at the offsets."""
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])
    sent = df.withColumn("move", F.explode(moves))
    return sent.withColumns({"sx": F.col("sx") + F.col("move.a"), "sy": F.col("sy") + F.col("move.b")}).drop("move")


def _near(dx: Column, dy: Column, eps: float) -> Column:
    return dx * dx + dy * dy <= F.lit(eps * eps)


def _boxes(core: DataFrame, keys: Sequence[str]) -> DataFrame:
    return core.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def _verdict(pairs: DataFrame, eps: float) -> DataFrame:
    """``sure`` where all points of two boxes are within the radius, ``open`` where some may be."""

    def apart(axis: str) -> tuple[Column, Column]:
        a0, a1, b0, b1 = (F.col(f"{side}{axis}{end}") for side in "ab" for end in "01")
        return F.greatest(F.lit(0.0), b0 - a1, a0 - b1), F.greatest(b1 - a0, a1 - b0)

    (low_x, high_x), (low_y, high_y) = apart("x"), apart("y")
    return pairs.withColumns({"sure": _near(high_x, high_y, eps), "open": _near(low_x, low_y, eps)}).where("open")


def _sided(boxes: DataFrame, side: str, keep: Sequence[str]) -> DataFrame:
    return boxes.select(*keep, *[F.col(c).alias(side + c) for c in ("x0", "x1", "y0", "y1")])


def _square_links(core: DataFrame, eps: float, side: float) -> DataFrame:
    """Pairs (u, v) of neighbouring squares that hold core points within the radius of each other."""
    name = F.struct("sx", "sy")
    boxes = materialize(_boxes(core, ["sx", "sy"]), "boxes")
    half = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if (a, b) > (0, 0)]
    ours = _sided(boxes.withColumn("u", name), "a", ["u", "sx", "sy"])
    theirs = _sided(boxes.withColumn("v", name), "b", ["v", "sx", "sy"])
    level = materialize(_verdict(_around(ours, half).join(theirs, ["sx", "sy"]), eps).select("u", "v", "sure"), "links")
    links, undecided = level.where("sure").select("u", "v"), level.where("NOT sure").select("u", "v", F.lit("").alias("pa"), F.lit("").alias("pb"))
    step, path = side, F.lit("")
    points = core.select(F.struct("sx", "sy").alias("u"), "x", "y")
    while not undecided.isEmpty():
        # the points of undecided boxes, cut finer; a path names the parts from the square on
        step /= FINER
        part = F.concat_ws(",", F.floor(F.col("x") / F.lit(step)), F.floor(F.col("y") / F.lit(step)))
        wanted = undecided.select("u", F.col("pa").alias("p")).union(undecided.select(F.col("v").alias("u"), F.col("pb").alias("p"))).distinct()
        finer = points.withColumns({"p": path, "q": part}).join(wanted, ["u", "p"])
        cut = materialize(_boxes(finer, ["u", "p", "q"]), "boxes")
        left = _sided(cut.withColumnsRenamed({"p": "pa", "q": "qa"}), "a", ["u", "pa", "qa"])
        right = _sided(cut.withColumnsRenamed({"u": "v", "p": "pb", "q": "qb"}), "b", ["v", "pb", "qb"])
        found = materialize(_verdict(undecided.join(left, ["u", "pa"]).join(right, ["v", "pb"]), eps).select("u", "v", "qa", "qb", "sure"), "links")
        discard(cut)
        newly = found.where("sure").select("u", "v").distinct()
        links = links.union(newly)
        undecided = found.where("NOT sure").join(newly, ["u", "v"], "left_anti").select("u", "v", F.col("qa").alias("pa"), F.col("qb").alias("pb"))
        path = part
    discard(boxes)
    return links


def density_clusters(points: DataFrame, eps: float, min_points: int, id_col: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """``id_col, cluster, core`` of every point with coordinates.

    A core point has ``min_points`` points within ``eps`` (itself included, planar distance). Core points within ``eps``
    of each other share a cluster, named by its least core id. Any other point within ``eps`` of a core point belongs
    to the cluster of the least such core point; the rest is noise with a null cluster. Ids must be unique.
    """
    # a little less than the radius: all points of a square are neighbours in floating point, too
    side = eps / math.sqrt(2.0) * (1 - 1e-9)
    placed = points.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    placed = placed.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    placed = placed.withColumns({"sx": _square("x", side), "sy": _square("y", side)})
    counts = placed.groupBy("sx", "sy").agg(F.count(F.lit(1)).alias("in_square"))
    # one row for each square on the right, so a square with a third of all points can be split
    placed = materialize(placed.join(counts, ["sx", "sy"]).withColumn("dense", F.col("in_square") >= min_points).drop("in_square"), "points")

    every = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]
    thin = placed.where("NOT dense").select("sx", "sy", F.col("id").alias("p"), F.col("x").alias("px"), F.col("y").alias("py"))
    met = _around(thin, every).join(placed, ["sx", "sy"]).where(_near(F.col("x") - F.col("px"), F.col("y") - F.col("py"), eps))
    seen = met.groupBy(F.col("p").alias("id")).agg(F.count(F.lit(1)).alias("neighbours"), F.min(F.when(F.col("dense"), F.col("id"))).alias("least_dense"))
    judged = materialize(
        placed.join(seen, "id", "left").withColumn("core", F.col("dense") | (F.coalesce("neighbours", F.lit(0)) >= min_points)).drop("neighbours"), "judged"
    )

    core = judged.where("core")
    square = F.struct("sx", "sy")
    roots = contract(_square_links(core, eps, side))
    of_square = core.groupBy("sx", "sy").agg(F.min("id").alias("least")).withColumn("node", square).join(roots, "node", "left")
    of_square = of_square.withColumn("root", F.coalesce("root", "node"))
    names = of_square.groupBy("root").agg(F.min("least").alias("cluster"))
    named = materialize(of_square.join(names, "root").select("sx", "sy", "cluster"), "squares")

    rest = judged.where("NOT core")
    thin_core = core.where("NOT dense").select("sx", "sy", F.col("id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    touching = _around(rest.select("sx", "sy", F.col("id"), "x", "y"), every).join(thin_core, ["sx", "sy"])
    touching = touching.where(_near(F.col("qx") - F.col("x"), F.col("qy") - F.col("y"), eps)).groupBy("id").agg(F.min("q").alias("least_thin"))
    border = rest.join(touching, "id", "left").withColumn("owner", F.least("least_dense", "least_thin"))
    owners = core.select(F.col("id").alias("owner"), "sx", "sy").join(named, ["sx", "sy"]).select("owner", "cluster")
    border = border.join(owners, "owner", "left").select(F.col("id").alias(id_col), "cluster", F.lit(False).alias("core"))
    inner = core.join(named, ["sx", "sy"]).select(F.col("id").alias(id_col), "cluster", F.lit(True).alias("core"))
    return inner.union(border)
