"""Plausibility screens. Values that fail become NULL; rows are never dropped here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid import constants as K


def plausible_units(df: DataFrame, ranges: Mapping[str, tuple[float, float]] | None = None) -> dict[str, bool]:
    """For each gas column present: does its typical magnitude fit the configured range?

    The median magnitude may exceed the range by a factor of 100 before the column is taken
    to be in other units. An empty column counts as plausible.
    """
    limits = ranges or K.VALID_RANGES
    gases = [c for c in K.GAS_COLUMNS if c in df.columns and c in limits]
    return _plausibility(df, {c: limits[c] for c in gases}).first()["fits"].asDict() if gases else {}


def _plausibility(df: DataFrame, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """One row: a struct ``fits`` with a flag per column, from one pass without any order statistic.

    The median does not exceed the bound if more than half of the magnitudes do not. If exactly half do not, it is the
    mean of the largest of them and the smallest of the others.
    """
    flags = []
    for c, ends in limits.items():
        size, bound = F.abs(F.col(c).cast("double")), F.lit(max(abs(v) for v in ends) * K.UNIT_TOLERANCE)
        n, low = F.count(size), F.count_if(size <= bound)
        middle = (F.max(F.when(size <= bound, size)) + F.min(F.when(size > bound, size))) / 2.0
        fits = F.when(n == 0, True).when(2 * low == n, middle <= bound).otherwise(2 * low > n)
        flags.append(fits.alias(c))
    return df.agg(F.struct(*flags).alias("fits"))


def clip_to_range(df: DataFrame, ranges: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Out-of-range values become NULL.

    A gas column in other units keeps its values, except that negatives still go when the
    range itself is non-negative.
    """
    limits = ranges or K.VALID_RANGES
    gases = {c: limits[c] for c in K.GAS_COLUMNS if c in df.columns and c in limits}
    # a scalar subquery: nothing runs before the caller's action
    fits = _plausibility(df, gases).scalar() if gases else None
    screened = {}
    for c, (lo, hi) in limits.items():
        if c not in df.columns:
            continue
        v = F.col(c)
        inside = F.when(v.between(lo, hi), v)
        if c in gases:
            other = F.when(v >= lo, v) if lo >= 0.0 else v
            screened[c] = F.when(fits.getField(c), inside).otherwise(other)
        else:
            screened[c] = inside
    return df.withColumns(screened) if screened else df


def within_sigma(df: DataFrame, columns: Sequence[str], n_sigma: float = 5.0) -> DataFrame:
    """Global screen: keep values within ``n_sigma`` population deviations of the mean.

    All columns share one aggregate, injected as a scalar subquery, so the plan stays lazy.
    """
    if not columns:
        return df
    stats = df.agg(
        F.struct(
            *[F.struct(F.avg(c).alias("mu"), F.stddev_pop(c).alias("sd")).alias(c) for c in columns]
        ).alias("stats")
    ).scalar()

    def screened(c: str):
        s = stats.getField(c)
        return F.when(F.abs(F.col(c) - s.getField("mu")) <= F.lit(float(n_sigma)) * s.getField("sd"), F.col(c))

    return df.withColumns({c: screened(c) for c in columns})


def screen(df: DataFrame, variables: Sequence[str], n_sigma: float = 5.0, exclude: Sequence[str] = ()) -> DataFrame:
    """Range clip followed by the sigma screen on every variable not excluded."""
    return within_sigma(clip_to_range(df), [v for v in variables if v not in exclude], n_sigma)


def cap_targets(df: DataFrame, caps: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    limits = {c: v for c, v in (caps or K.TARGET_CAPS).items() if c in df.columns}
    return df.withColumns({c: F.when(F.col(c).between(lo, hi), F.col(c)) for c, (lo, hi) in limits.items()})


def strong_fires(fires: DataFrame, threshold: float = 5.0, frp: str = "frp") -> DataFrame:
    return fires.where(F.col(frp) > F.lit(float(threshold)))


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every listed column that exists is present."""
    return df.dropna(subset=[c for c in columns if c in df.columns])


def model_inputs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing values and missing feature columns become 0.0."""
    zero = F.lit(0.0)
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), zero) if c in df.columns else zero for c in features}
    )
