"""Global order statistics that never put all rows into one task.

There is one path at every size: rows are dealt by ranges of their order and stored, each range counts its rows, and the
counts of the lower ranges are joined back.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.functions.geo import portable_hash
from hazegrid.session import materialize


def running_sums(df: DataFrame, order: Sequence[str], amount: str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with ``range``, ``upto`` (sum of ``amount`` up to and with the row, per ``by``) and ``total`` (of its group).

    ``by`` must not be null. Rows that are equal in ``order`` are taken in any order. ``ranges`` asks for a number of
    ranges; without it the session's shuffle settings decide.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*by, *order]]
    spread = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    # stored: both readings below must see the same ranges
    spread = materialize(spread.withColumn("range", F.spark_partition_id()), "ranges")
    # one row for each range and group
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    lower = group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = spread.groupBy(*by, "range").agg(F.sum(amount).alias("_amount")).select(
        *by, "range", F.coalesce(F.sum("_amount").over(lower), F.lit(0)).alias("_below"), F.sum("_amount").over(group).alias("total")
    )
    inside = Window.partitionBy(*by, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = spread.withColumn("_upto", F.sum(amount).over(inside)).join(base, [*by, "range"])
    return counted.select(*df.columns, "range", (F.col("_upto") + F.col("_below")).alias("upto"), "total")


def cumulative_counts(df: DataFrame, value: str, by: Sequence[str] = (), ranges: int | None = None, rows: str | None = None) -> DataFrame:
    """Distinct non-NULL values (per ``by``) with ``n``, ``n_le`` (rows <= value), ``total`` and ``range``.

    Rows collapse to distinct values before anything is ordered, so a value held by a third of all rows is one row here.
    A row counts ``rows`` times, once without it.
    """
    n = F.sum(rows) if rows else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("n"))
    return running_sums(counts, [value], "n", by, ranges).select(*by, value, "n", "range", F.col("upto").alias("n_le"), "total")


def mid_ranks(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank", ranges: int | None = None) -> DataFrame:
    """``df`` with the rank of each value per ``by``; equal values share the mean of their ranks, NULL has none.

    ``df`` is stored first, so that values are counted and looked up with the same digits.
    """
    df = materialize(df, "values")
    counts = cumulative_counts(df, value, by, ranges)
    # one row for each value on the right, so adaptive execution can split a hot value on the left
    ranks = counts.select(*by, value, (F.col("n_le") - (F.col("n") - 1) / F.lit(2.0)).alias(out))
    return df.join(ranks, [*by, value], "left")


def exact_quantiles(
    df: DataFrame, columns: Mapping[str, Column] | Sequence[str], probs: Sequence[float], ranges: int | None = None
) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of several columns, NULLs ignored, in one pass over ``df``."""
    exprs = dict(columns) if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    if not exprs:
        return {}
    names = list(exprs)
    values = F.array(*[F.struct(F.lit(i).alias("q"), exprs[c].cast("double").alias("v")) for i, c in enumerate(names)])
    counts = cumulative_counts(df.select(F.explode(values).alias("e")).select("e.q", "e.v"), "v", ["q"], ranges)
    picks = []
    for j, p in enumerate(probs):
        at = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.least(F.floor(at) + 1, F.col("total") - 1)
        picks += [
            F.min(F.when(F.col("n_le") > low, F.col("v"))).alias(f"a{j}"), F.min(F.when(F.col("n_le") > high, F.col("v"))).alias(f"b{j}"),
            F.max(at - F.floor(at)).alias(f"f{j}"),
        ]
    found = {names[r["q"]]: r for r in counts.groupBy("q").agg(*picks).collect()}  # one row for each column

    def at(r, j: int) -> float:
        a, b, frac = r[f"a{j}"], r[f"b{j}"], r[f"f{j}"]
        return a if frac == 0.0 or a == b or math.isnan(b) else a + (b - a) * frac

    return {c: [at(found[c], j) for j in range(len(probs))] if c in found else [None] * len(probs) for c in names}


def shuffled_positions(
    df: DataFrame, key: Column, seed: str, out: str, parts: Sequence[str] = (), tie: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Dense 1-based position of every row in a seeded random order, per ``parts``."""
    hashed = df.withColumns({"_h": portable_hash(key, seed, 15), "_one": F.lit(1).cast("long")})
    counted = running_sums(hashed, ["_h", *tie], "_one", parts, ranges)
    return counted.select(*df.columns, F.col("upto").cast("int").alias(out))
