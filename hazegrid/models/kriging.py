"""Trend plus kriged station residual."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid import constants as K
from hazegrid.models.metrics import score
from hazegrid.models.regression import Factory, TargetRegressors
from hazegrid.session import materialize

# Beyond this many length scales a weight is below exp(-40), under double rounding of `reg`.
REACH = 9.0


def krige_residuals(
    points: DataFrame,
    stations: DataFrame,
    residuals: Sequence[str],
    length_deg: float = 0.6,
    reg: float = 1e-2,
    point_key: Sequence[str] = ("lon", "lat"),
) -> DataFrame:
    """Gaussian-kernel residual field at distinct points: ``sum(w r) / (sum(w) + reg)``.

    The field depends on place only, so repeated dates collapse to distinct points first.
    Stations are copied to the 3 x 3 buckets around them (bucket = the reach of the kernel);
    weights past the reach are smaller than rounding, so nothing visible is dropped. Far from
    every station the field is 0. A station without a residual for a target is ignored for
    that target only.
    """
    size = REACH * length_deg

    def bucket(c: Column) -> Column:
        return F.floor(c / F.lit(size)).cast("bigint")

    spots = points.select(*dict.fromkeys([*point_key, "lon", "lat"])).distinct().withColumns(
        {"_bx": bucket(F.col("lon")), "_by": bucket(F.col("lat"))}
    )
    around = F.array(*[F.struct(F.lit(dx).alias("x"), F.lit(dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    spread = stations.select(
        F.col("lon").alias("_slon"), F.col("lat").alias("_slat"), *[F.col(r).alias(f"_r_{r}") for r in residuals], F.explode(around).alias("_o")
    ).withColumns({"_bx": bucket(F.col("_slon")) + F.col("_o.x"), "_by": bucket(F.col("_slat")) + F.col("_o.y")}).drop("_o")
    dx, dy = F.col("lon") - F.col("_slon"), F.col("lat") - F.col("_slat")
    d2 = dx * dx + dy * dy
    near = spots.join(spread, ["_bx", "_by"]).where(d2 <= F.lit(size * size)).withColumn(
        "_w", F.exp(-d2 / F.lit(2 * length_deg * length_deg))
    )
    field = near.groupBy(*point_key).agg(
        *[
            (F.sum(F.col("_w") * F.col(f"_r_{r}")) / (F.sum(F.when(F.col(f"_r_{r}").isNotNull(), F.col("_w"))) + F.lit(reg))).alias(r)
            for r in residuals
        ]
    )
    everywhere = spots.select(*point_key).join(field, list(point_key), "left")
    return everywhere.withColumns({r: F.coalesce(F.col(r), F.lit(0.0)) for r in residuals})


def station_residuals(predicted: DataFrame, targets: Sequence[str], station_col: str = "station_id", order: str = "date") -> DataFrame:
    """Mean residual per station and target, with the station's first coordinates."""
    place = F.min(F.struct(F.col(order), F.col("lon"), F.col("lat")))
    return predicted.groupBy(station_col).agg(
        place.alias("_p"), *[F.avg(F.col(t) - F.col(f"pred_{t}")).alias(t) for t in targets]
    ).select(station_col, "_p.lon", "_p.lat", *targets)


class HybridModel:
    """Any per-target trend plus the kriged mean residual of the stations."""

    def __init__(self, targets: Sequence[str], features: Sequence[str], factory: Factory | None = None, length_deg: float = 0.6, station_col: str = "station_id"):
        self.trend = TargetRegressors(targets, features, factory)
        self.length_deg, self.station_col = length_deg, station_col
        self.residuals: DataFrame | None = None

    @property
    def targets(self) -> list[str]:
        return list(self.trend.models)

    def fit(self, df: DataFrame) -> HybridModel:
        used = [self.station_col, "date", "lon", "lat", *self.trend.features, *self.trend.targets]
        train = materialize(df.select(*[c for c in dict.fromkeys(used) if c in df.columns]), "training")
        self.trend.stored = True
        self.trend.fit(train)
        # one row per station: stored, because every prediction joins it
        fitted = station_residuals(self.trend.predict(train), self.targets, self.station_col)
        self.residuals = materialize(fitted, "residuals")
        return self

    def correct(self, predicted: DataFrame, prefix: str = "pred_") -> DataFrame:
        """Add the residual field to trend predictions found in ``predicted``."""
        field = krige_residuals(predicted, self.residuals, self.targets, self.length_deg)
        field = field.withColumnsRenamed({t: f"_v_{t}" for t in self.targets})
        joined = predicted.join(field, ["lon", "lat"], "left")
        summed = {f"{prefix}{t}": F.col(f"pred_{t}") + F.coalesce(F.col(f"_v_{t}"), F.lit(0.0)) for t in self.targets}
        return joined.withColumns(summed).drop(*[f"_v_{t}" for t in self.targets])

    def predict(self, df: DataFrame) -> DataFrame:
        return self.correct(self.trend.predict(df))


def trend_versus_hybrid(train: DataFrame, test: DataFrame, targets: Sequence[str], features: Sequence[str], factory: Factory | None = None, length_deg: float = 0.6) -> DataFrame:
    """Skill of the trend alone and of the hybrid on held-out rows, one row per target and model."""
    model = HybridModel(targets, features, factory, length_deg).fit(train)
    both = model.correct(model.trend.predict(test), prefix="hyb_")
    pairs = {f"{t}|trend": (t, f"pred_{t}") for t in model.targets} | {f"{t}|hybrid": (t, f"hyb_{t}") for t in model.targets}
    long = score(both, pairs)
    name = F.split("target", r"\|")
    bench = F.create_map(*[F.lit(x) for pair in K.BENCHMARK_R2.items() for x in pair])
    return long.select(
        name[0].alias("target"), name[1].alias("model"), "r2", "rmse", "mae", "n",
        F.try_element_at(bench, F.regexp_replace(name[0], "_obs$", "")).alias("benchmark_r2"),
    )
