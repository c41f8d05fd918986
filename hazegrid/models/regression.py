"""One Spark ML regressor per target, with pluggable estimators."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.operators.qa import model_inputs
from hazegrid.session import checkpoint_folder, materialize

Factory = Callable[[], object]


def random_forest(trees: int = 300, max_depth: int = 30, min_leaf: int = 1, seed: int = 42, **kw) -> Factory:
    """Forest factory. Spark limits depth to 30, which stands in for unbounded growth."""
    return lambda: RandomForestRegressor(
        numTrees=trees, maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=seed, featureSubsetStrategy="all", **kw
    )


def boosted_trees(rounds: int = 600, max_depth: int = 8, rate: float = 0.05, share: float = 0.8, seed: int = 42, **kw) -> Factory:
    return lambda: GBTRegressor(
        maxIter=rounds, maxDepth=max_depth, stepSize=rate, subsamplingRate=share,
        featureSubsetStrategy=str(share), seed=seed, **kw,
    )


def linear(**kw) -> Factory:
    """Ordinary least squares with intercept."""
    return lambda: LinearRegression(solver="normal", regParam=0.0, **kw)


#: The most rows of one partition that trees are grown on: their estimators keep rows in memory, many times as large as in files.
TREE_ROWS = 500_000


def tree_partitions(ready: DataFrame) -> DataFrame:
    """``ready`` (cheap to re-read) in partitions of about ``TREE_ROWS`` rows at most, dealt anew only if files hold more."""
    needed = -(-ready.count() // TREE_ROWS)
    return ready.repartition(needed) if needed > ready.rdd.getNumPartitions() else ready


#: Blocks that the rows of equal features are dealt to before boosting: a round's subsample takes or leaves a whole block.
BLOCKS = 64


def blocks(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows of equal features in up to ``BLOCKS`` blocks: their mean target, and their number as ``_weight``.

    Squared error tells such rows apart by a constant only, so splits and leaves of the weighted blocks are those of the rows.
    """
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(target), F.lit(BLOCKS)))
    return dealt.groupBy(*features, "_block").agg(
        F.avg(target).alias(target), F.count(F.lit(1)).cast("double").alias("_weight")
    ).drop("_block")


class TargetRegressors:
    """A regressor for every target that has rows; predictions arrive as ``pred_<target>``.

    Missing features count as 0.0 in fitting and prediction; rows without the target are
    left out for that target only.
    """

    def __init__(
        self, targets: Sequence[str], features: Sequence[str], factory: Factory | None = None, parallel: int = 4,
        stored: bool = False, pooled: bool = False,
    ):
        """``stored``: the training frame is cheap to re-read, so it is not written out first.

        ``pooled``: rows of equal features are fitted as weighted :func:`blocks` and predicted once, for estimators with
        many passes; it needs a squared loss and a ``weightCol``.
        """
        self.targets, self.features, self.stored, self.pooled = list(targets), list(features), stored, pooled
        self.factory, self.parallel = factory or random_forest(), parallel
        self.models: dict[str, PipelineModel] = {}

    def fit(self, df: DataFrame) -> TargetRegressors:
        ready = model_inputs(df, self.features).select(*dict.fromkeys([*self.features, *self.targets]))
        if not self.stored:
            # estimators pass over their input several times, once per target at least
            ready = materialize(ready, "training")
        usable = [t for t in self.targets if not ready.where(F.col(t).isNotNull()).select(t).isEmpty()]

        def one(target: str) -> PipelineModel:
            est = self.factory()
            est = est.copy({est.labelCol: target, est.featuresCol: "_x", est.predictionCol: f"pred_{target}"})
            stages = [VectorAssembler(inputCols=self.features, outputCol="_x"), est]
            rows = ready.where(F.col(target).isNotNull()).select(*self.features, F.col(target).cast("double").alias(target))
            if self.pooled:
                est.setWeightCol("_weight")
                rows = materialize(blocks(rows, self.features, target), "blocks")
            if est.hasParam("checkpointInterval"):  # without a folder the lineage of all rounds is kept
                checkpoint_folder(df.sparkSession)
            return Pipeline(stages=stages).fit(tree_partitions(rows) if est.hasParam("maxDepth") else rows)

        # fits of different targets are independent jobs; a few may share the cluster
        with ThreadPoolExecutor(max_workers=max(1, min(self.parallel, len(usable) or 1))) as pool:
            self.models = dict(zip(usable, pool.map(one, usable), strict=True))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with one prediction column per fitted target; original columns stay as they were."""
        hidden = {c: f"_in_{c}" for c in self.features}
        out = model_inputs(df.withColumns({h: F.col(c) for c, h in hidden.items() if c in df.columns}), self.features)
        scored = out.select(*self.features).distinct() if self.pooled else out
        for model in self.models.values():
            scored = model.transform(scored).drop("_x")
        # stored: its size decides how it is joined
        out = out.join(materialize(scored, "scored"), self.features) if self.pooled else scored
        kept = [F.col(hidden[c]).alias(c) if c in hidden else F.col(c) for c in df.columns]
        return out.select(*kept, *[f"pred_{t}" for t in self.models])

    def save(self, path: str, spark: SparkSession) -> None:
        for target, model in self.models.items():
            model.write().overwrite().save(f"{path}/{target}")
        meta = json.dumps({"targets": self.targets, "features": self.features, "fitted": list(self.models)})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_about")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> TargetRegressors:
        meta = json.loads(spark.read.text(f"{path}/_about").first()[0])
        out = cls(meta["targets"], meta["features"])
        out.models = {t: PipelineModel.load(f"{path}/{t}") for t in meta["fitted"]}
        return out


def importances(model: TargetRegressors, target: str, spark: SparkSession, top: int = 20) -> DataFrame:
    """Features of a fitted tree model by importance, largest first."""
    scores = model.models[target].stages[-1].featureImportances.toArray()
    rows = [(f, float(s)) for f, s in zip(model.features, scores, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def cross_validate(
    folded: DataFrame, target: str, features: Sequence[str], factory: Factory, k: int,
    min_train: int = 1, min_test_groups: tuple[str, int] | None = None,
) -> DataFrame | None:
    """Held-out predictions of every usable fold, as one DataFrame with ``pred_<target>``.

    A fold is skipped when it is empty, trains on too few rows or (optionally) holds too few
    distinct groups. ``None`` if no fold is usable.
    """
    # stored once, by fold: every other fold trains on it again, and only its own model predicts it
    rows = materialize(folded.where(F.col(target).isNotNull() & F.col("fold").isNotNull()), "folds", ["fold"])
    group = F.count_distinct(min_test_groups[0]) if min_test_groups else F.lit(0)
    sizes = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), group.alias("groups")).collect()}
    total = sum(r["n"] for r in sizes.values())
    usable = []
    for f in range(k):
        size = sizes.get(f)
        if size is None or total - size["n"] < max(min_train, 1):
            continue
        if min_test_groups and size["groups"] < min_test_groups[1]:
            continue
        usable.append(f)

    def held_out(f: int) -> DataFrame:
        model = TargetRegressors([target], features, factory, stored=True).fit(rows.where(F.col("fold") != f))
        return model.predict(rows.where(F.col("fold") == f))

    # folds are independent jobs; a few may share the cluster
    with ThreadPoolExecutor(max_workers=max(1, min(4, len(usable)))) as pool:
        parts = list(pool.map(held_out, usable))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out
