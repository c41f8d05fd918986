import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid.operators.components import cluster_cells, clusters, contract, label_clusters


def brute(mask, diagonal):
    h, w = mask.shape
    label = {}
    for start in zip(*np.nonzero(mask)):
        if start in label:
            continue
        label[start], todo = start, [start]
        while todo:
            r, c = todo.pop()
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    if (dr, dc) == (0, 0) or (not diagonal and dr and dc):
                        continue
                    q = (r + dr, c + dc)
                    if 0 <= q[0] < h and 0 <= q[1] < w and mask[q] and q not in label:
                        label[q] = start
                        todo.append(q)
    return {tuple(map(int, k)): tuple(map(int, v)) for k, v in label.items()}


def frame(spark, mask):
    rows = [(int(r), int(c), bool(mask[r, c]), float(c), float(-r), float(r * 100 + c)) for r in range(mask.shape[0]) for c in range(mask.shape[1])]
    return spark.createDataFrame(rows, "row int, col int, m boolean, lon double, lat double, v double")


def snake(n):
    m = np.zeros((n, n), bool)
    m[::2] = True
    for i, r in enumerate(range(1, n, 2)):
        m[r, -1 if i % 2 == 0 else 0] = True
    return m


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("tile", [3, 8, 512])
def test_labels_match_flood_fill(spark, connectivity, tile):
    mask = np.random.default_rng(7).random((17, 23)) < 0.45
    got = label_clusters(frame(spark, mask), "m", connectivity, tile=tile).collect()
    assert {(r["row"], r["col"]): (r["cluster_row"], r["cluster_col"]) for r in got} == brute(mask, connectivity == 8)


@pytest.mark.parametrize("tile", [4, 512])
def test_one_long_snake(spark, tile):
    mask = snake(21)
    got = cluster_cells(frame(spark, mask), "m", 4, tile=tile)
    assert got.select("cluster_row", "cluster_col", "cluster_size").distinct().collect() == [(0, 0, int(mask.sum()))]


def test_empty_mask_and_scenes(spark):
    mask = np.ones((4, 4), bool)
    df = frame(spark, mask)
    assert label_clusters(df.withColumn("m", F.lit(False)), "m").count() == 0
    two = df.withColumn("day", F.lit(1)).union(df.withColumn("day", F.lit(2)))
    rows = clusters(two, "m", "v", scene=["day"], tile=2).orderBy("day").collect()
    assert [(r["day"], r["n_cells"], r["lon"], r["lat"]) for r in rows] == [(1, 16, 1.5, -1.5), (2, 16, 1.5, -1.5)]
    assert rows[0]["hcho_value"] == pytest.approx(151.5)


def test_contract_handles_hubs_chains_and_cycles(spark):
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(300, 301), (301, 302), (302, 300)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    roots = {r["node"]: r["root"] for r in contract(df).collect()}
    assert all(roots[i] == 0 for i in range(1, 60)) and all(roots[100 + i] == 100 for i in range(1, 41))
    assert roots[301] == roots[302] == 300
    assert contract(df.where("u < 0")).count() == 0
