"""Pollution zones: K-Means on robustly scaled cells, zone count by silhouette."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid import constants as K
from hazegrid.models.scaling import RobustScale
from hazegrid.session import materialize

#: Points that the first centres of all runs are drawn from.
START_ROWS = 4096
DEFAULT_FEATURES = ("aqi", "hcho", "no2", "co", "doy_sin", "doy_cos")


def usable_features(df: DataFrame, wanted: Sequence[str] | None, default: Sequence[str]) -> list[str]:
    cols = [c for c in (wanted if wanted is not None else default) if c in df.columns]
    if not cols:
        raise ValueError("no usable columns")
    return cols


def complete(columns: Sequence[str]) -> Column:
    """True where no column is NULL or NaN."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns])


@dataclass(frozen=True)
class Fit:
    """One run of K-Means: its centres, the cost of the cells at them and how many cells each centre has."""

    k: int
    start: int
    centres: np.ndarray
    cost: float
    counts: np.ndarray


def candidate_counts(k_range: Sequence[int], n_cells: int) -> list[int]:
    """The wanted numbers of zones that ``n_cells`` cells can have."""
    return sorted({int(k) for k in k_range}.intersection(range(2, n_cells)))


def _squares(x: Sequence[np.ndarray], centre: np.ndarray) -> np.ndarray:
    """Squared distance of each point to the centre, from differences: products lose digits far from 0."""
    return reduce(lambda a, b: np.add(a, b, out=a), [np.square(gap, out=gap) for gap in (c - v for c, v in zip(x, centre, strict=True))])


def _nearest(x: Sequence[np.ndarray], centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance to it) of each point of the columns ``x``; the first of equally near ones.

    Whole columns are compared with one centre after the other, so nothing wider than a column is made.
    """
    nearest, least = np.zeros(len(x[0]), np.int64), _squares(x, centres[0])
    for i, centre in enumerate(centres[1:], 1):
        square = _squares(x, centre)
        np.putmask(nearest, square < least, i)
        np.minimum(least, square, out=least)
    return nearest, least


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def lloyd_step(points: DataFrame, columns: Sequence[str], models: Sequence[np.ndarray]) -> DataFrame:
    """``model, cluster, n, cost`` and the sum of each column, of the points nearest to each centre of each model.

    All models are served by one pass over ``points``; a task sends one row for each centre. Among equally near centres
    the first one wins; a centre without points has no row.
    """
    flat, sizes = np.concatenate(models), [len(m) for m in models]
    sums = [f"sum_{c}" for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cost, total = np.zeros(len(flat), np.int64), np.zeros(len(flat)), np.zeros((len(flat), len(columns)))
        for batch in batches:
            x = _columns(batch)
            low = 0
            for k in sizes:
                nearest, gap = _nearest(x, flat[low : low + k])
                n[low : low + k] += np.bincount(nearest, minlength=k)
                cost[low : low + k] += np.bincount(nearest, gap, k)
                for j, c in enumerate(x):
                    total[low : low + k, j] += np.bincount(nearest, c, k)
                low += k
        at = np.flatnonzero(n)
        model = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        cluster = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
        yield pa.RecordBatch.from_arrays([pa.array(a[at]) for a in (model, cluster, n, cost, *total.T)], ["model", "cluster", "n", "cost", *sums])

    kinds = "model int, cluster int, n long, cost double" + "".join(f", {c} double" for c in sums)
    parts = points.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(run, kinds)
    return parts.groupBy("model", "cluster").agg(*[F.sum(c).alias(c) for c in ("n", "cost", *sums)])


def _first_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Rows of the sample, each drawn with the squared distance to those drawn before."""
    chosen = [sample[rng.integers(len(sample))]]
    gap = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        weights = gap / gap.sum() if gap.sum() > 0 else None
        chosen.append(sample[rng.choice(len(sample), p=weights)])
        gap = np.minimum(gap, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def _settled(sample: np.ndarray, centres: np.ndarray, max_iter: int) -> np.ndarray:
    """Where K-Means on the sample alone ends."""
    for _ in range(max_iter):
        own = ((sample * sample).sum(axis=1)[:, None] - 2 * sample @ centres.T + (centres * centres).sum(axis=1)).argmin(axis=1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.column_stack([np.bincount(own, sample[:, j], len(centres)) for j in range(sample.shape[1])])
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.array_equal(new, centres):
            break
        centres = new
    return centres


def best_fits(points: DataFrame, columns: Sequence[str], counts: Sequence[int], seed: int = 0, n_init: int = 20, max_iter: int = 100, tol: float = 1e-4) -> dict[int, Fit]:
    """The cheapest of ``n_init`` runs for each number of clusters.

    All runs of all numbers advance together, one pass over the points a step; a run leaves when the squared movements
    of its centres add up to no more than ``tol`` times the mean variance of the columns. A run begins where it ends on ``START_ROWS`` points alone; every step then uses all points.
    """
    order = F.xxhash64(*columns, F.lit(seed))
    sample = points.select(*columns).orderBy(order, *columns).limit(START_ROWS).toPandas().to_numpy(float)
    runs = [(k, i) for k in counts for i in range(n_init)]
    centres = {r: _settled(sample, _first_centres(sample, r[0], np.random.default_rng((seed, *r))), max_iter) for r in runs}
    still = tol * sum(points.agg(*[F.var_pop(c) for c in columns]).first()) / len(columns)
    done: dict[tuple[int, int], Fit] = {}
    for step in range(max_iter + 1):
        active = [r for r in runs if r not in done]
        if not active:
            break
        # one row for each centre
        found = lloyd_step(points, columns, [centres[r] for r in active]).collect()
        for m, r in enumerate(active):
            new, n, cost = centres[r].copy(), np.zeros(r[0], np.int64), 0.0
            for row in (x for x in found if x["model"] == m):
                n[row["cluster"]] = row["n"]
                cost += row["cost"]
                new[row["cluster"]] = [row[f"sum_{c}"] / row["n"] for c in columns]
            if ((new - centres[r]) ** 2).sum() <= still or step == max_iter:
                done[r] = Fit(*r, centres[r], cost, n)
            centres[r] = new
    return {k: min((done[r] for r in runs if r[0] == k), key=lambda f: (f.cost, f.start)) for k in counts}


def nearest_centre(centres: np.ndarray, columns: Sequence[str]) -> Column:
    """Number of the nearest centre, the first one among equally near ones."""
    gaps = []
    for i, centre in enumerate(centres):
        gap = reduce(lambda a, b: a + b, [(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, centre, strict=True)])
        gaps.append(F.struct(gap.alias("gap"), F.lit(i).alias("i")))
    return F.array_min(F.array(*gaps))["i"]


def silhouettes(points: DataFrame, columns: Sequence[str], fits: Sequence[Fit]) -> dict[int, float | None]:
    """Mean silhouette of squared distances for each fit, all in two passes; None where fewer than two clusters hold points."""
    models = [f.centres for f in fits]
    found = lloyd_step(points, columns, models).collect()
    stats = []
    for m, centres in enumerate(models):
        n, mean, spread = np.zeros(len(centres)), centres.copy(), np.zeros(len(centres))
        for row in (x for x in found if x["model"] == m):
            c = row["cluster"]
            n[c], mean[c] = row["n"], [row[f"sum_{name}"] / row["n"] for name in columns]
            # the cost is around the centre; around the mean it is less by their squared distance
            spread[c] = max(0.0, row["cost"] / row["n"] - ((centres[c] - mean[c]) ** 2).sum())
        stats.append((n, mean, spread))
    useful = [m for m, (n, *_) in enumerate(stats) if (n > 0).sum() > 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(stats)), 0
        for batch in batches:
            x = _columns(batch)
            rows += len(batch)
            for m in useful:
                n, mean, spread = stats[m]
                own, _ = _nearest(x, models[m])
                inside, outside = np.zeros(len(own)), np.full(len(own), np.inf)
                for c in np.flatnonzero(n):
                    # mean squared distance to the members of the cluster
                    apart = _squares(x, mean[c]) + spread[c]
                    mine = own == c
                    np.copyto(inside, apart * (n[c] / max(n[c] - 1, 1)), where=mine)
                    np.minimum(outside, apart, out=outside, where=~mine)
                score = np.where(n[own] > 1, (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-300), 0.0)
                total[m] += score.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(stats), dtype=np.int32)), pa.array(total), pa.array(np.full(len(stats), rows))], ["model", "total", "n"])

    scored = points.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(run, "model int, total double, n long").groupBy("model").agg((F.sum("total") / F.sum("n")).alias("s")).collect()
    by_model = {r["model"]: r["s"] for r in scored}
    return {f.k: by_model.get(m) if m in useful else None for m, f in enumerate(fits)}


def label_zones(cells: DataFrame, cluster: str, order_by: str, labels: Sequence[str]) -> DataFrame:
    """Cells with ``zone_id, zone_label, zone_score`` instead of their cluster number.

    Zones count from 0 by rising mean of ``order_by`` (ties by cluster number); the score is the distance from the
    zone's mean. A cell without cluster keeps NULL.
    """
    means = cells.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.avg(order_by).alias("_mean"))
    # one row per cluster
    rising = Window.orderBy(F.asc_nulls_last("_mean"), cluster)
    zones = means.withColumn("zone_id", (F.row_number().over(rising) - 1).cast("int"))
    zones = zones.withColumn("zone_label", F.get(F.array(*[F.lit(x) for x in labels]), F.col("zone_id")))
    joined = cells.join(zones, cluster, "left")
    return joined.withColumn("zone_score", F.col(order_by) - F.col("_mean")).drop(cluster, "_mean")


def zone_table(zoned: DataFrame, features: Sequence[str]) -> DataFrame:
    """``zone_id, zone_label, n_cells`` and the mean of each feature: the centre of the zone."""
    return zoned.where(F.col("zone_id").isNotNull()).groupBy("zone_id", "zone_label").agg(F.count(F.lit(1)).alias("n_cells"), *[F.avg(c).alias(c) for c in features])


def fit_zones(
    cells: DataFrame, features: Sequence[str] | None = None, k_range: Sequence[int] = (3, 4, 5), seed: int = 0, n_init: int = 20
) -> tuple[DataFrame, dict]:
    """(cells with zone columns, metadata).

    Zones are numbered by rising mean AQI (else by the first feature). Cells with a missing feature keep NULL zone
    columns. The count with the best silhouette is taken, the smaller one if two agree.
    """
    cols = usable_features(cells, features, DEFAULT_FEATURES)
    stored = materialize(cells.withColumn("_whole", complete(cols)), "cells")
    sizes = stored.agg(F.count(F.lit(1)).alias("all"), F.count_if("_whole").alias("whole")).first()
    if sizes["whole"] < 4:
        raise ValueError("zones need four cells or more with all features")
    counts = candidate_counts(k_range, sizes["whole"])
    if not counts:
        raise ValueError("k_range has no count below the number of cells")

    scale = RobustScale.fit(stored.where("_whole"), cols)
    scaled = [f"_s_{c}" for c in cols]
    whole = materialize(scale.apply(stored.where("_whole"), "_s_").select(*cells.columns, *scaled), "scaled")
    points = whole.select(*scaled).persist()
    fits = best_fits(points, scaled, counts, seed, n_init)
    scores = silhouettes(points, scaled, [fits[k] for k in counts])
    points.unpersist()
    best = max(counts, key=lambda k: (scores[k] is not None, scores[k] or 0.0, -k))
    clustered = whole.withColumn("_zone", nearest_centre(fits[best].centres, scaled)).select(*cells.columns, "_zone")
    clustered = clustered.unionByName(stored.where(~F.col("_whole")).drop("_whole"), allowMissingColumns=True)

    names = list(K.ZONE_LABELS.get(best, [f"Zone {i + 1}" for i in range(best)]))
    zoned = materialize(label_zones(clustered, "_zone", "aqi" if "aqi" in cells.columns else cols[0], names), "zones")
    return zoned, describe_zones(zoned, cols, names, {str(k): scores[k] for k in counts}, best, sizes["all"])


def describe_zones(zoned: DataFrame, features: Sequence[str], labels: Sequence[str], scores: dict[str, float | None], k: int, n_cells: int) -> dict:
    """The zones as a document; its size is that of the zone table, one entry per zone."""
    table = zone_table(zoned, features).orderBy("zone_id").collect()
    centres = [{key: r[key] for key in ("zone_id", "zone_label", *features)} for r in table]
    # fixed values: the field names of the document
    return {
        "method": "KMeans",
        "feature_cols": list(features),
        "n_cells": int(n_cells),
        "n_clustered_cells": sum(r["n_cells"] for r in table),
        "candidate_silhouette": scores,
        "selected_k": int(k),
        "zone_labels": list(labels),
        "zone_counts": {str(r["zone_id"]): r["n_cells"] for r in table},
        "cluster_centres": centres,
    }


def zone_metadata_rows(spark, metadata: dict) -> DataFrame:
    """Centres and counts of the chosen zones as rows."""
    rows = [
        (c["zone_id"], c["zone_label"], metadata["zone_counts"][str(c["zone_id"])], json.dumps({k: v for k, v in c.items() if not k.startswith("zone_")}))
        for c in metadata["cluster_centres"]
    ]
    return spark.createDataFrame(rows, "zone_id int, zone_label string, n_cells bigint, centre string")
