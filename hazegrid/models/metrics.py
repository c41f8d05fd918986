"""Skill scores as plain aggregates, many targets in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _r2(ss_res: Column, ss_tot: Column) -> Column:
    flat = F.when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(ss_tot == 0, flat).otherwise(F.lit(1.0) - F.try_divide(ss_res, ss_tot))


def score(df: DataFrame, pairs: Mapping[str, tuple[str, str]], keys: Sequence[str] = ()) -> DataFrame:
    """R2, RMSE, MAE and n per target (and per key) over rows whose truth is present.

    ``pairs`` maps a target name to its (truth, prediction) columns.
    """
    aggs = []
    for i, (truth, pred) in enumerate(pairs.values()):
        t = F.when(F.col(pred).isNotNull(), F.col(truth))
        err = F.col(truth) - F.col(pred)
        aggs += [
            F.count(t).alias(f"n{i}"),
            F.sum(err * err).alias(f"sse{i}"),
            F.var_pop(t).alias(f"var{i}"),
            F.avg(F.abs(err)).alias(f"mae{i}"),
        ]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = [
        F.struct(
            F.lit(name).alias("target"),
            F.when(F.col(f"n{i}") > 0, _r2(F.col(f"sse{i}"), F.col(f"var{i}") * F.col(f"n{i}"))).alias("r2"),
            F.sqrt(F.try_divide(F.col(f"sse{i}"), F.col(f"n{i}"))).alias("rmse"),
            F.col(f"mae{i}").alias("mae"),
            F.col(f"n{i}").alias("n"),
        )
        for i, name in enumerate(pairs)
    ]
    return wide.select(*keys, F.inline(F.array(*rows)))


def calibration_report(df: DataFrame, truth: str, prediction: str, column: str, method: str) -> DataFrame:
    """Skill of a calibrated field next to the straight line through the raw column."""
    both = df.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
    err = F.col(truth) - F.col(prediction)
    agg = both.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(err * err).alias("_sse"),
        F.var_pop(truth).alias("_var"),
        F.regr_slope(truth, column).alias("raw_column_slope"),
        F.regr_r2(truth, column).alias("raw_column_r2"),
    )
    r2 = _r2(F.col("_sse"), F.col("_var") * F.col("n"))
    return agg.select(
        r2.alias("r2"),
        F.sqrt(F.try_divide(F.col("_sse"), F.col("n"))).alias("rmse"),
        "n",
        F.lit(method).alias("method"),
        "raw_column_slope",
        "raw_column_r2",
        F.round(r2 - F.col("raw_column_r2"), 4).alias("r2_gain_over_raw_column"),
    )


def density_bins(df: DataFrame, truth: str, prediction: str, bins: int = 50) -> DataFrame:
    """Counts of (truth, prediction) pairs on a square grid over their common range.

    The range starts at 0 or at the smallest value, whichever is lower.
    """
    both = df.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull()).select(
        F.col(truth).cast("double").alias("_t"), F.col(prediction).cast("double").alias("_p")
    )
    lim = both.agg(
        F.struct(
            F.least(F.lit(0.0), F.min("_t"), F.min("_p")).alias("lo"), F.greatest(F.max("_t"), F.max("_p")).alias("hi")
        )
    ).scalar()
    width = (lim.getField("hi") - lim.getField("lo")) / F.lit(float(bins))

    def bin_of(c: str) -> Column:
        return F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col(c) - lim.getField("lo"), width)), F.lit(0))).cast("int")

    return both.select(bin_of("_t").alias("truth_bin"), bin_of("_p").alias("prediction_bin")).groupBy(
        "truth_bin", "prediction_bin"
    ).agg(F.count(F.lit(1)).alias("n"))
