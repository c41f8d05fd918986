"""Gap filling, column calibration and whole-grid prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid import constants as K
from hazegrid.functions.geo import cyclic_day
from hazegrid.models.metrics import calibration_report, score
from hazegrid.models.regression import Factory, TargetRegressors, cross_validate, linear, random_forest
from hazegrid.models.splits import group_folds, last_dates, random_folds, random_test, spatial_folds
from hazegrid.operators.features import engineer
from hazegrid.session import materialize


def missing_share(df: DataFrame, variable: str) -> DataFrame:
    return df.agg((F.count_if(F.col(variable).isNull()) / F.count(F.lit(1))).alias("missing_frac"))


def _gap_inputs(df: DataFrame, covariates: Sequence[str] | None, date_col: str) -> tuple[DataFrame, list[str]]:
    out = df
    if date_col in df.columns and "doy_sin" not in df.columns:
        sine, cosine = cyclic_day(F.col(date_col))
        out = df.withColumns({"doy_sin": sine, "doy_cos": cosine})
    return out, [c for c in (covariates or K.GAPFILL_COVARIATES) if c in out.columns]


def fill_gaps(df: DataFrame, variable: str = "aod", covariates: Sequence[str] | None = None, factory: Factory | None = None, date_col: str = "date") -> DataFrame:
    """Observed values stay; missing ones come from a model of the gap-free covariates.

    Only the missing rows are scored. Adds ``was_missing``.
    """
    ready, used = _gap_inputs(df, covariates, date_col)
    model = TargetRegressors([variable], used, factory or random_forest(200)).fit(ready)
    observed = ready.where(F.col(variable).isNotNull()).withColumn("was_missing", F.lit(False))
    gaps = model.predict(ready.where(F.col(variable).isNull()))
    filled = gaps.withColumn(variable, F.col(f"pred_{variable}")).drop(f"pred_{variable}").withColumn("was_missing", F.lit(True))
    return observed.withColumn(variable, F.col(variable).cast("double")).unionByName(filled)


def gap_skill(df: DataFrame, variable: str = "aod", covariates: Sequence[str] | None = None, factory: Factory | None = None, block_deg: float = 2.0, k: int = 5, seed: int = 42, date_col: str = "date") -> DataFrame:
    """Skill on held-out spatial blocks; NULL scores below 50 observed rows."""
    ready, used = _gap_inputs(df, covariates, date_col)
    seen = ready.where(F.col(variable).isNotNull())
    n = seen.count()
    names = {"r2": "cv_r2", "rmse": "cv_rmse", "n": "cv_n"}
    held = None
    if n >= 50:
        folded = spatial_folds(seen, block_deg, k, seed)
        held = cross_validate(folded, variable, used, factory or random_forest(120), k, min_train=20)
    if held is None:
        return df.sparkSession.range(1).select(
            F.lit(None).cast("double").alias("cv_r2"), F.lit(None).cast("double").alias("cv_rmse"), F.lit(n).cast("bigint").alias("cv_n")
        )
    return score(held, {variable: (variable, f"pred_{variable}")}).select(*[F.col(a).alias(b) for a, b in names.items()])


class ColumnCalibrator:
    """Surface concentration from a satellite column and weather covariates."""

    def __init__(self, covariates: Sequence[str] | None = None, method: str = "rf", column: str = "no2", target: str = "no2_obs", factory: Factory | None = None):
        self.covariates = list(covariates or K.CALIBRATION_COVARIATES)
        self.method, self.column, self.target = method, column, target
        self.factory = factory or (linear() if method == "linear" else random_forest(200))
        self.used: list[str] = []
        self.model: TargetRegressors | None = None

    def _complete(self, df: DataFrame) -> DataFrame:
        return df.dropna(subset=[self.target, *self.used])

    def fit(self, df: DataFrame) -> ColumnCalibrator:
        self.used = [c for c in self.covariates if c in df.columns]
        self.model = TargetRegressors([self.target], self.used, self.factory).fit(self._complete(df))
        return self

    def predict(self, df: DataFrame, out: str = "no2_surface") -> DataFrame:
        """Adds the calibrated field. A covariate column that was fitted must exist; its gaps count as 0."""
        if self.model is None:
            raise RuntimeError("fit before predict")
        absent = [c for c in self.used if c not in df.columns]
        if absent:
            raise KeyError(f"covariates missing from the input: {absent}")
        return self.model.predict(df).withColumnRenamed(f"pred_{self.target}", out)

    def report(self, df: DataFrame) -> DataFrame:
        scored = self.predict(self._complete(df), "_calibrated")
        return calibration_report(scored, self.target, "_calibrated", self.column, self.method)

    def save(self, path: str, spark) -> None:
        self.model.save(path, spark)

    @classmethod
    def load(cls, path: str, spark, method: str = "rf", column: str = "no2") -> ColumnCalibrator:
        model = TargetRegressors.load(path, spark)
        out = cls(model.features, method, column, model.targets[0])
        out.used, out.model = model.features, model
        return out


def calibrate_cells(cells: DataFrame, training: DataFrame, out: str = "no2_surface", **options) -> tuple[DataFrame, DataFrame]:
    """(cells with the calibrated column, one-row report)."""
    cal = ColumnCalibrator(**options).fit(training)
    return cal.predict(cells, out).withColumn(out, F.col(out).cast("float")), cal.report(training)


def predict_cells(cells: DataFrame, model, date: str | None = None) -> DataFrame:
    """Predictions for every cell: derive features, then score. Stays one row per cell."""
    dated = cells.withColumn("date", F.lit(date).cast("date")) if date else cells
    return model.predict(engineer(dated))


def compare_schemes(df: DataFrame, target: str, features: Sequence[str], row_key: Column, factory: Factory | None = None, block_deg: float = 2.0, k: int = 5, seed: int = 0) -> DataFrame:
    """R2 of one target under a random, a spatial and a temporal hold-out."""
    make = factory or random_forest(150)
    rows = df.where(F.col(target).isNotNull())
    spatial = spatial_folds(rows, block_deg, k, 42).withColumn("is_test", F.col("fold") == 0).drop("fold")
    schemes = {"random": random_test(rows, row_key, 0.2, seed), "spatial": spatial, "temporal": last_dates(rows, 0.2)}
    out = None
    for name, split in schemes.items():
        model = TargetRegressors([target], features, make).fit(split.where(~F.col("is_test")))
        held = model.predict(split.where(F.col("is_test")))
        part = score(held, {target: (target, f"pred_{target}")}).withColumn("scheme", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def dual_validation(df: DataFrame, targets: Sequence[str], features: Sequence[str], row_key: Column, factory: Factory | None = None, k: int = 5, block_deg: float = 2.0, min_stations: int = 12, min_rows: int = 150) -> DataFrame:
    """Random and spatial cross-validation of every target with enough stations and rows.

    Empty when no target qualifies.
    """
    make = factory or random_forest(300, min_leaf=2, seed=0)
    # stored once: sizes, blocks and both schemes read it
    wanted = [*targets, *features, "station_id", "lon", "lat"]
    df = materialize(df.select(*dict.fromkeys(c for c in wanted if c in df.columns), row_key.alias("_row")), "validation")
    sizes = df.agg(
        *[F.count(t).alias(f"n_{t}") for t in targets],
        *[F.count_distinct(F.when(F.col(t).isNotNull(), F.col("station_id"))).alias(f"s_{t}") for t in targets],
    ).first()
    out = None
    for t in targets:
        if sizes[f"s_{t}"] < min_stations or sizes[f"n_{t}"] < min_rows:
            continue
        rows = df.where(F.col(t).isNotNull())
        runs = {
            "random_cv": cross_validate(random_folds(rows, F.col("_row"), k), t, features, make, k),
            "spatial_cv": cross_validate(
                spatial_folds(rows, block_deg, k), t, features, make, k, min_train=100, min_test_groups=("station_id", 2)
            ),
        }
        for scheme, held in runs.items():
            if held is None:
                continue
            part = score(held, {t: (t, f"pred_{t}")}).withColumns(
                {"scheme": F.lit(scheme), "stations": F.lit(sizes[f"s_{t}"]).cast("bigint")}
            )
            out = part if out is None else out.unionByName(part)
    if out is None:
        schema = "target string, r2 double, rmse double, mae double, n bigint, scheme string, stations bigint"
        return df.sparkSession.createDataFrame([], schema)
    return out


def group_validation(df: DataFrame, target: str, features: Sequence[str], factory: Factory | None = None, k: int = 5, group: str = "station_id") -> DataFrame:
    """Per-fold skill with whole groups held out."""
    df = df.select(*dict.fromkeys(c for c in (target, *features, group) if c in df.columns))
    held = cross_validate(group_folds(df, group, k), target, features, factory or random_forest(50), k)
    return score(held, {target: (target, f"pred_{target}")}, ["fold"])
