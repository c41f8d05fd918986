"""Isolation-forest anomaly scores.

Spark draws the training rows and scores all cells; only the growing of one tree on at most
256 rows, and the walk of a batch of rows through finished trees, run in Python workers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.functions.geo import portable_hash
from hazegrid.models.scaling import RobustScale
from hazegrid.models.zones import usable_features
from hazegrid.operators.components import cluster_cells
from hazegrid.operators.ranking import exact_quantiles
from hazegrid.session import materialize

DEFAULT_FEATURES = ("hcho", "no2", "co", "frp_mean", "doy_sin", "doy_cos")
SAMPLE_ROWS = 256
_NODES = "tree int, node int, feature int, cut double, left int, right int, depth double"


def _mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a random binary tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _draw(ready: DataFrame, key: Column, n_rows: int, n_trees: int, seed: int) -> DataFrame:
    """Rows with their ``tree``: up to 256 per tree, without replacement inside a shuffled pass.

    Passes over the data are seeded permutations laid end to end and cut into trees, so at
    most trees x 256 rows are ever needed. When one pass suffices, a hash filter keeps a
    little more than that before anything is ordered.
    """
    size = min(SAMPLE_ROWS, n_rows)
    need = size * n_trees
    passes = math.ceil(need / n_rows)
    if passes == 1:
        share = min(1.0, (need + 6 * math.sqrt(need) + 64) / n_rows)
        space = 16**7
        kept = ready.where(portable_hash(key, f"keep{seed}", 7) < F.lit(int(share * space) + 1))
    else:
        kept = ready
    runs = kept.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    order = Window.partitionBy("_pass").orderBy(portable_hash(F.concat_ws(":", F.col("_pass"), key), f"draw{seed}", 15), key)
    position = F.col("_pass") * n_rows + F.row_number().over(order) - 1
    return runs.withColumn("tree", F.floor(position / size).cast("int")).where(F.col("tree") < n_trees).drop("_pass")


def grow_trees(sample: DataFrame, columns: Sequence[str], sample_rows: int, seed: int) -> DataFrame:
    """One random tree per ``tree`` value, as node rows."""
    limit = max(1, math.ceil(math.log2(max(sample_rows, 2))))
    cols = list(columns)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(cols)[cols].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        nodes: list[list] = []

        def split(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([tree, at, -1, 0.0, -1, -1, depth + _mean_path(len(rows))])
            low, high = rows.min(axis=0), rows.max(axis=0)
            open_cols = np.flatnonzero(high > low)
            if depth < limit and len(rows) > 1 and len(open_cols):
                f = int(rng.choice(open_cols))
                cut = float(rng.uniform(low[f], high[f]))
                below = rows[:, f] < cut
                if below.any() and not below.all():
                    nodes[at][2:4] = [f, cut]
                    nodes[at][4] = split(rows[below], depth + 1)
                    nodes[at][5] = split(rows[~below], depth + 1)
            return at

        split(x, 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "depth"])

    return sample.select("tree", *cols).groupBy("tree").applyInPandas(grow, _NODES)


def _levels(nodes: pd.DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(feature and cut of all places of each level, depth of each place below the last level) of one tree.

    A leaf above the last level goes on with itself on both sides, so every row walks the same number of levels.
    """
    feature, cut, left, right, depth = (nodes[c].to_numpy() for c in ("feature", "cut", "left", "right", "depth"))
    at, levels = np.zeros(1, np.int64), []
    while (feature[at] >= 0).any():
        inner = feature[at] >= 0
        levels.append((np.where(inner, feature[at], 0).astype(np.int64), np.where(inner, cut[at], np.inf)))
        at = np.stack([np.where(inner, left[at], at), np.where(inner, right[at], at)], axis=1).ravel()
    return levels, depth[at]


def _walk(x: np.ndarray, trees: Sequence[tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]]) -> np.ndarray:
    """Depths of the leaves of each row, summed over the trees."""
    values, first, total = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
    for levels, depth in trees:
        at = np.zeros(len(x), np.int64)
        for feature, cut in levels:
            below = values.take(first + feature.take(at)) < cut.take(at)
            at += at
            at += ~below
        total += depth.take(at)
    return total


def anomaly_score(df: DataFrame, columns: Sequence[str], nodes: DataFrame, sample_rows: int, n_trees: int, out: str) -> DataFrame:
    """Adds the isolation score in (0, 1]; larger is more isolated.

    The forest has at most trees x 511 places whatever the data size, so it is broadcast.
    """
    table = nodes.toPandas().sort_values(["tree", "node"])
    trees = [_levels(g) for _, g in table.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(trees)
    norm = _mean_path(sample_rows) or 1.0

    @F.pandas_udf("double")
    def walk(*features: pd.Series) -> pd.Series:
        x = np.stack([f.to_numpy(dtype=float) for f in features], axis=1)
        return pd.Series(np.exp2(-(_walk(x, shared.value) / len(shared.value)) / norm))

    return df.withColumn(out, walk(*[F.col(c) for c in columns]))


def number_clusters(grouped: DataFrame, scene: Sequence[str] = ()) -> DataFrame:
    """Clusters counted from 0 by scene and first cell, without ordering them all in one task.

    A grid row of one scene is counted on its own and shifted by what the rows before it hold.
    """
    line = [*scene, "cluster_row"]
    first_cells = grouped.groupBy(*line, "cluster_col").agg(F.first("cluster_size").alias("isolation_cluster_size"))
    # one row per grid row and scene
    before = Window.orderBy(*line).rowsBetween(Window.unboundedPreceding, -1)
    shift = first_cells.groupBy(*line).agg(F.count(F.lit(1)).alias("_k")).select(*line, F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*line).orderBy("cluster_col"))
    return first_cells.withColumn("_n", inside).join(shift, line).withColumn("isolation_cluster_id", (F.col("_n") + F.col("_before") - 1).cast("bigint")).drop("_n", "_before")


def isolation_hotspots(
    cells: DataFrame,
    features: Sequence[str] | None = None,
    contamination: float = 0.05,
    seed: int = 0,
    n_trees: int = 300,
    scene: Sequence[str] = (),
) -> tuple[DataFrame, dict]:
    """(cells with anomaly columns, metadata).

    A missing input counts as the median, a cell without any input has no score. Scores are relative to their
    ``1 - contamination`` quantile, so anomalies are positive. Anomalous neighbours, corners included, form clusters
    within one ``scene`` (a date, say), which have a number and a size; all other cells have -1 and 0. Grid indices
    must be unique within a scene.
    """
    cols = usable_features(cells, features, DEFAULT_FEATURES)
    key = [*scene, "row", "col"]
    stored = materialize(cells.withColumn("_scored", F.coalesce(*[F.col(c).cast("double") for c in cols]).isNotNull()), "cells")
    totals = stored.agg(F.count(F.lit(1)).alias("all"), F.count_if("_scored").alias("scored")).first()
    if totals["scored"] < 10:
        raise ValueError("a forest needs ten cells or more with an input")
    if not stored.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"cells repeat within {key}: name the columns that tell scenes apart")

    basis = stored.where("_scored")
    scale = RobustScale.fit(basis, cols)
    scaled = [f"_s_{c}" for c in cols]
    ready = scale.apply(basis).select(*key, *scaled)
    size = min(SAMPLE_ROWS, totals["scored"])
    nodes = grow_trees(_draw(ready, F.concat_ws(",", *key), totals["scored"], n_trees, seed), scaled, size, seed)
    raw = materialize(anomaly_score(ready, scaled, nodes, size, n_trees, "_raw").select(*key, "_raw"), "isolation")
    cut = exact_quantiles(raw, ["_raw"], [1.0 - contamination])["_raw"][0]
    relative = F.col("_raw") - F.lit(cut)
    flagged = raw.select(*key, relative.alias("isolation_score"), (relative > 0).alias("isolation_anomaly"))
    grouped = materialize(cluster_cells(flagged, "isolation_anomaly", connectivity=8, scene=scene), "anomalies")
    numbered = number_clusters(grouped, scene)
    members = grouped.join(numbered, [*scene, "cluster_row", "cluster_col"]).select(*key, "isolation_cluster_id", "isolation_cluster_size")
    absent = {"isolation_anomaly": F.lit(False), "isolation_cluster_id": F.lit(-1).cast("bigint"), "isolation_cluster_size": F.lit(0).cast("bigint")}
    result = stored.drop("_scored").join(flagged, key, "left").join(members, key, "left")
    result = result.withColumns({c: F.coalesce(F.col(c).cast(dict(result.dtypes)[c]), default) for c, default in absent.items()})
    found = grouped.agg(F.count(F.lit(1)).alias("n_anomalies"), F.count_distinct(*scene, "cluster_row", "cluster_col").alias("n_clusters")).first()
    return result, describe_forest(cols, contamination, n_trees, totals, found)


def describe_forest(columns: Sequence[str], contamination: float, n_trees: int, totals, found) -> dict:
    """The run as a document."""
    return {
        "n_cells": totals["all"],
        "n_valid_cells": totals["scored"],
        **found.asDict(),
        "method": "IsolationForest",
        "n_estimators": n_trees,
        "contamination": contamination,
        "feature_cols": list(columns),
        "score_definition": "depth-based score less its cut-off; above zero is anomalous",
    }
