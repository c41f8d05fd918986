"""Connected clusters of flagged grid cells.

Cells are grouped in square tiles. Each tile is labelled on its own (a tile has a fixed
number of cells, so no task can grow with the data or with one giant cluster), then labels
that touch across tile borders are merged by star contraction on the far smaller border
graph, and the merged labels are written back onto the cells.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.session import discard, materialize

_TILE_BITS = 32


def _label_tile(rows: np.ndarray, cols: np.ndarray, diagonal: bool) -> np.ndarray:
    """Index of the first cell (row-major) of each cell's cluster within one tile."""
    n = len(rows)
    width = int(cols.max()) - int(cols.min()) + 3
    code = (rows - rows.min()).astype(np.int64) * width + (cols - cols.min())
    label = np.arange(n)
    pairs = []
    for step in [1, width] + ([width - 1, width + 1] if diagonal else []):
        at = np.searchsorted(code, code + step)
        hit = (at < n) & (code[np.minimum(at, n - 1)] == code + step)
        pairs.append(np.stack([np.flatnonzero(hit), at[hit]]))
    a, b = np.concatenate(pairs, axis=1)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            return label


def contract(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) of an edge list (u, v): alternating large-star and small-star steps.

    Joins the per-node minimum back instead of collecting neighbours, so a node that touches
    a third of all edges is only a skewed join key, which adaptive execution splits. Each
    round is written out; lost executors re-read the last round.
    """
    both = lambda e: e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def signature(e: DataFrame):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        return r["n"], r["h"]

    current = materialize(edges.where(F.col("u") != F.col("v")).distinct(), "edges")
    state = signature(current)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        around = both(current)
        low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v")).distinct()
        )
        following = materialize(small, "edges")
        previous, current = current, following
        discard(previous)
        after = signature(current)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def label_clusters(
    cells: DataFrame, mask: str, connectivity: int = 4, scene: Sequence[str] = (), tile: int = 512
) -> DataFrame:
    """Flagged cells with ``cluster_row``/``cluster_col``: the first cell (row-major) of the cluster.

    ``connectivity`` is 4 (shared edges) or 8 (corners too). ``scene`` columns separate
    independent grids.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    diagonal = connectivity == 8
    flagged = cells.where(F.col(mask)).select(
        *scene,
        F.col("row").cast("int").alias("row"),
        F.col("col").cast("int").alias("col"),
        F.floor(F.col("row") / tile).cast("int").alias("_tr"),
        F.floor(F.col("col") / tile).cast("int").alias("_tc"),
    )
    schema = T.StructType([*flagged.schema.fields, T.StructField("_lr", T.IntegerType()), T.StructField("_lc", T.IntegerType())])

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"], kind="stable").reset_index(drop=True)
        rows, cols = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        first = _label_tile(rows, cols, diagonal)
        return pdf.assign(_lr=rows[first].astype(np.int32), _lc=cols[first].astype(np.int32))

    labelled = materialize(flagged.groupBy(*scene, "_tr", "_tc").applyInPandas(label, schema), "tiles")

    # borders: cells whose right / lower (/ diagonal) partner lies in another tile
    node = F.struct(*scene, F.col("_lr"), F.col("_lc"))
    moves = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    here = labelled.select(*scene, "row", "col", "_tr", "_tc", node.alias("u"))
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in moves])
    sent = here.withColumn("_m", F.explode(steps)).withColumns(
        {"row": F.col("row") + F.col("_m.dr"), "col": F.col("col") + F.col("_m.dc")}
    )
    leaving = sent.where(
        (F.floor(F.col("row") / tile) != F.col("_tr")) | (F.floor(F.col("col") / tile) != F.col("_tc"))
    ).select(*scene, "row", "col", "u")
    edges = leaving.join(here.select(*scene, "row", "col", F.col("u").alias("v")), [*scene, "row", "col"]).select("u", "v")
    roots = contract(edges)
    keep = [*scene, "row", "col"]
    merged = labelled.withColumn("node", node).join(roots, "node", "left")
    root = F.coalesce(F.col("root"), F.col("node"))
    return merged.select(*keep, root.getField("_lr").alias("cluster_row"), root.getField("_lc").alias("cluster_col"))


def cluster_cells(
    cells: DataFrame, mask: str, connectivity: int = 4, scene: Sequence[str] = (), tile: int = 512
) -> DataFrame:
    """Flagged cells with cluster key and ``cluster_size``."""
    labelled = label_clusters(cells, mask, connectivity, scene, tile)
    keys = [*scene, "cluster_row", "cluster_col"]
    sizes = labelled.groupBy(*keys).agg(F.count(F.lit(1)).alias("cluster_size"))
    return labelled.join(sizes, keys)


def clusters(
    cells: DataFrame, mask: str, value: str | None = None, connectivity: int = 4, scene: Sequence[str] = (), tile: int = 512
) -> DataFrame:
    """One row per cluster: centroid, cell count and mean value. ``cells`` carry lon and lat."""
    labelled = label_clusters(cells, mask, connectivity, scene, tile)
    attrs = cells.where(F.col(mask)).select(*scene, "row", "col", "lon", "lat", *([value] if value else []))
    joined = labelled.join(attrs, [*scene, "row", "col"])
    out = [F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count(F.lit(1)).alias("n_cells")]
    if value:
        out.append(F.avg(value).alias("hcho_value"))
    return joined.groupBy(*scene, "cluster_row", "cluster_col").agg(*out)
