"""Trends of series: Mann-Kendall test and Theil-Sen slope.

A series collapses to one mean per instant before it is gathered, so its length is bounded by the instants of the
record, however many rows a cell has. Pairs of instants are counted by merging, never listed: n log n steps and memory
linear in the series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.operators.hotspots import _upper_tail

#: Instants up to which all pairs of a series are looked at; their number is then a constant.
DIRECT = 256


def series(df: DataFrame, keys: Sequence[str], time: Column, value: str) -> DataFrame:
    """One row per series: ``keys`` and ``points``, an array of (t, x) with one mean per instant, in order of time.

    Rows without time or value take no part; ``time`` is a number.
    """
    steps = df.where(F.col(value).isNotNull()).groupBy(*keys, time.cast("double").alias("t")).agg(F.avg(value).alias("x"))
    return steps.where(F.col("t").isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("points"))


def _merges(rank: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Merge levels of many sequences at once, as (order, right, key, left_before, left_until, base, left_total).

    ``rank`` are dense ranks of the values, ``start`` the index at which each element's sequence begins. In blocks of
    twice the level's width, elements of the right half meet those of the left half.
    """
    n, spread = len(rank), int(rank.max()) + 1 if len(rank) else 1
    inside = np.arange(n) - start
    longest, width = (int(inside.max()) + 1 if n else 0), 1
    while width < longest:
        block = start + inside // (2 * width) * (2 * width)
        key = block * spread + rank
        order = np.argsort(key, kind="stable")
        key, block = key[order], block[order]
        right = (inside[order] // width) % 2 == 1
        left = np.append(0, np.cumsum(~right))
        yield order, right, key, left[np.searchsorted(key, key, "left")], left[np.searchsorted(key, key, "right")], left[np.searchsorted(block, block, "left")], left[np.searchsorted(block, block, "right")]
        width *= 2


def rising_and_falling(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of many sequences (laid end to end): pairs i < j with a greater, and with a smaller, later value."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    rank = np.unique(values, return_inverse=True)[1]
    up, down = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for order, right, _, before, until, base, total in _merges(rank, start):
        at = owner[order[right]]
        np.add.at(up, at, (before - base)[right])
        np.add.at(down, at, (total - until)[right])
    return up, down


def _tie_term(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of t (t - 1) (2 t + 5) over the groups of equal values of each sequence."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    rank = np.unique(values, return_inverse=True)[1]
    groups, t = np.unique(owner * (int(rank.max()) + 1 if len(rank) else 1) + rank, return_counts=True)
    out = np.zeros(len(lengths))
    np.add.at(out, groups // (int(rank.max()) + 1 if len(rank) else 1), (t * (t - 1.0) * (2.0 * t + 5.0)))
    return out


#: Points that one step looks at together; a longer series is looked at alone.
TOGETHER = 1 << 18


def _per_series(packed: DataFrame, fn: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], kinds: str) -> DataFrame:
    """Rows with what ``fn(times, values, lengths)`` finds for series laid end to end, a bounded number of points at a time."""

    numpy_kinds = {name: {"long": "int64", "double": "float64"}[kind] for name, kind in (part.split() for part in kinds.split(","))}

    @F.arrow_udf(kinds)
    def run(points: pa.Array) -> pa.Array:
        ends = points.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        t, x = (points.values.field(name).to_numpy(zero_copy_only=False) for name in ("t", "x"))
        found, low = [], 0
        while low < len(points):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + TOGETHER, "right")) - 1)
            at = slice(ends[low], ends[high])
            found.append(fn(t[at], x[at], np.diff(ends[low : high + 1])))
            low = high
        return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, k), *[f[name] for f in found]]), k) for name, k in numpy_kinds.items()], list(numpy_kinds))

    rows = packed.withColumn("_found", run(F.col("points")))
    return rows.select(*[c for c in packed.columns if c != "points"], F.size("points").cast("long").alias("n"), "_found.*")


def mann_kendall(df: DataFrame, keys: Sequence[str], time: Column, value: str, level: float = 0.05) -> DataFrame:
    """``keys, n, s, variance, z, p, trend`` of every series.

    S is the number of rising less that of falling pairs, its variance is corrected for ties, and ``z`` takes one step
    off S towards zero. ``p`` is two-sided; ``trend`` is 1 or -1 where ``p < level``, else 0. A constant series or one
    instant has variance 0, ``z`` 0 and ``p`` 1.
    """

    def count(_: np.ndarray, x: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
        up, down = rising_and_falling(x, lengths)
        return {"s": up - down, "ties": _tie_term(x, lengths)}

    counted = _per_series(series(df, keys, time, value), count, "s long, ties double")
    n, s = F.col("n").cast("double"), F.col("s")
    variance = (n * (n - 1) * (2 * n + 5) - F.col("ties")) / 18
    out = counted.withColumn("variance", variance)
    z = F.when(F.col("variance") > 0, (s - F.signum(s)) / F.sqrt("variance")).otherwise(F.lit(0.0))
    out = out.withColumn("z", z).withColumn("p", F.least(F.lit(1.0), 2 * _upper_tail(F.col("z"))))
    trend = F.when(F.col("p") < level, F.signum("z").cast("int")).otherwise(0)
    return out.withColumn("trend", trend).select(*keys, "n", "s", "variance", "z", "p", "trend")


def _inverted(first: np.ndarray, second: np.ndarray, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with ``first[i] < first[j]`` and ``second[i] >= second[j]``, or ``>`` if ``strict``."""
    order = np.lexsort((second, first))
    rank = np.unique(second[order], return_inverse=True)[1]
    pairs_i, pairs_j = [], []
    for merged, right, _, before, until, _, total in _merges(rank, np.zeros(len(rank), np.int64)):
        lefts = merged[~right]
        met = until if strict else before
        count = np.where(right, total - met, 0)
        j = np.repeat(merged, count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(met, count)
        pairs_i.append(order[lefts[at]])
        pairs_j.append(order[j])
    i, j = np.concatenate([np.zeros(0, np.int64), *pairs_i]), np.concatenate([np.zeros(0, np.int64), *pairs_j])
    below = first[i] < first[j]
    return i[below], j[below]


def _slope_of_rank(t: np.ndarray, x: np.ndarray, k: int, rng: np.random.Generator) -> float:
    """The ``k``-th smallest (from 1) of the slopes of all pairs, by randomised selection.

    Slopes at most s belong to the pairs whose ``x - s t`` does not rise, so a pass of merges counts them. Random pairs
    give the pivots; once few slopes are left strictly between two pivots, exactly these are listed. A slope that many
    pairs share is never inside: as a pivot it is the answer or a border.
    """
    n = len(t)
    pairs = n * (n - 1) // 2
    low, high, below, until = -np.inf, np.inf, 0, pairs
    while until - below > 8 * n:
        i, j = rng.integers(0, n, (2, 16 * n))
        slopes = (x[j] - x[i])[i != j] / (t[j] - t[i])[i != j]
        sample = np.sort(slopes[(slopes > low) & (slopes < high)])
        if not len(sample):
            break
        wanted = (k - below) / (until - below) * len(sample)
        reach = 2 * np.sqrt(len(sample)) + 1
        for at in {int(np.clip(wanted - reach, 0, len(sample) - 1)), int(np.clip(wanted, 0, len(sample) - 1)), int(np.clip(wanted + reach, 0, len(sample) - 1))}:
            pivot = sample[at]
            if not low < pivot < high:
                continue
            up, down = rising_and_falling(x - pivot * t, np.array([n]))
            less, at_most = int(down[0]), pairs - int(up[0])
            if less < k <= at_most:
                return float(pivot)
            if at_most < k:
                low, below = pivot, at_most
            else:
                high, until = pivot, less
    first = x - low * t if np.isfinite(low) else np.arange(n, dtype=float)
    second = x - high * t if np.isfinite(high) else -np.arange(n, dtype=float)
    i, j = _inverted(first, second, strict=True)
    slopes = (x[j] - x[i]) / (t[j] - t[i])
    at = min(max(k - below - 1, 0), len(slopes) - 1)
    return float(np.partition(slopes, at)[at])


def median_slope(t: np.ndarray, x: np.ndarray, direct: int = DIRECT) -> float:
    """Median of the slopes of all pairs of instants; NaN for fewer than two."""
    n = len(t)
    if n < 2:
        return float("nan")
    if n <= direct:
        i, j = np.triu_indices(n, 1)
        return float(np.median((x[j] - x[i]) / (t[j] - t[i])))
    pairs, rng = n * (n - 1) // 2, np.random.default_rng(n)
    upper = _slope_of_rank(t, x, pairs // 2 + 1, rng)
    return upper if pairs % 2 else (_slope_of_rank(t, x, pairs // 2, rng) + upper) / 2


def theil_sen(df: DataFrame, keys: Sequence[str], time: Column, value: str) -> DataFrame:
    """``keys, n, slope, intercept`` of every series: median of all pair slopes, and of what it leaves of the medians.

    With one instant the slope is null and the intercept its value.
    """

    def fit(times: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
        cuts = np.cumsum(lengths)[:-1]
        t, x = np.split(times, cuts), np.split(values, cuts)
        # times from the first instant on, which keeps x - s t small
        slopes = [median_slope(a - a[0], b) for a, b in zip(t, x, strict=True)]
        middle = [np.median(b) - (s * np.median(a) if len(a) > 1 else 0.0) for a, b, s in zip(t, x, slopes, strict=True)]
        return {"slope": np.array(slopes), "intercept": np.array(middle)}

    out = _per_series(series(df, keys, time, value), fit, "slope double, intercept double")
    return out.withColumn("slope", F.when(~F.isnan("slope"), F.col("slope")))
