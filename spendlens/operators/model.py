"""Models and evaluation with ``pyspark.ml``: O-63..69.

Training is distributed by Spark ML (tree statistics are aggregated across tasks);
the driver only loops over ``fit`` calls and holds model metadata. The modelling
frame is one row per customer; it is laid out once (fixed partitioning, sorted
within partitions) and checkpointed before the iterative fits, so every fit reads
the same small table and metrics do not depend on upstream partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import from_log_target
from ..session import checkpointed
from . import folds as FO
from . import metrics as M
from . import rank as R
from .features import FEATURES, KEY, LABEL

SEED = 42


@dataclass(frozen=True)
class Preset:
    """A model family and its parameters (Spark ML parameter names)."""

    kind: str  # linear | forest | boosted
    params: dict = field(default_factory=dict)


# Fixed values of the source's model settings, mapped to Spark ML parameters:
# boosted 300 rounds, rate 0.05, depth 7; second boosted preset 500 rounds, rate
# 0.05, depth 7; forest 200 trees, depth 10; ordinary least squares.
PRESETS: dict[str, Preset] = {
    "boosted_deep": Preset("boosted", {"maxIter": 500, "stepSize": 0.05, "maxDepth": 7}),
    "forest": Preset("forest", {"numTrees": 200, "maxDepth": 10}),
    "linear": Preset("linear", {}),
    "boosted": Preset("boosted", {"maxIter": 300, "stepSize": 0.05, "maxDepth": 7}),
}

# Fixed values of the source's tuning grid (2*3*2*2*2*2*2 = 192 points, 3 folds),
# mapped: rounds -> maxIter, rate -> stepSize, depth -> maxDepth, row subsample ->
# subsamplingRate, column subsample -> featureSubsetStrategy (per node),
# gamma -> minInfoGain, min child weight -> minInstancesPerNode.
TUNING_GRID: dict[str, list] = {
    "maxIter": [300, 500],
    "stepSize": [0.01, 0.03, 0.05],
    "maxDepth": [6, 8],
    "subsamplingRate": [0.8, 1.0],
    "featureSubsetStrategy": ["0.8", "all"],
    "minInfoGain": [0.0, 1.0],
    "minInstancesPerNode": [1, 5],
}


#: Fits that run at a time. A boosting round is a row of short jobs, so that one fit leaves
#: most of a cluster idle; several fits share it.
PARALLEL_FITS = 8
GBT_ROUNDS = 20  # where a preset names none: Spark ML's default


def in_parallel(work: Callable, items: Iterable, parallelism: int = PARALLEL_FITS) -> list:
    """``work`` of every item, several at a time as Spark jobs of driver threads."""
    items = list(items)
    if len(items) < 2 or parallelism < 2:
        return [work(i) for i in items]
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(work), items, chunksize=1)


def estimator(preset: Preset, features_col: str = "features", label: str = LABEL):
    p = dict(preset.params)
    if preset.kind == "linear":
        return LinearRegression(featuresCol=features_col, labelCol=label, solver="normal", **p)
    if preset.kind == "forest":
        return RandomForestRegressor(featuresCol=features_col, labelCol=label, seed=SEED, **p)
    if preset.kind == "boosted":
        return GBTRegressor(featuresCol=features_col, labelCol=label, lossType="squared", seed=SEED, **p)
    raise ValueError(f"unknown model kind {preset.kind!r}")


def assembler(features: Sequence[str] = FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


#: Rows of a partition of the modelling frame, at most, where there are more than two a core.
PARTITION_ROWS = 500_000


def _partitions(frame: DataFrame) -> int:
    """As many as the session shuffles into, but with few rows no more than two a core. A
    fit runs a job per level, and each of its tasks sends the statistics of all nodes, so its
    time grows with the partitions, however few rows they hold."""
    spark = frame.sparkSession
    n, enough = int(spark.conf.get("spark.sql.shuffle.partitions", "8")), 2 * spark.sparkContext.defaultParallelism
    return n if n <= enough else min(n, max(enough, -(-frame.count() // PARTITION_ROWS)))


def prepare(
    frame: DataFrame,
    features: Sequence[str] = FEATURES,
    fill_missing: float | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Modelling rows with double features, laid out deterministically and
    checkpointed. A missing feature (a customer whose prices are all missing has
    no average item price) becomes ``fill_missing``, or the feature's mean over the rows
    that have it (0 if none has): Spark ML trees and least squares take no nulls."""
    n = partitions or _partitions(frame)
    rest = [c for c in frame.columns if c not in features]
    cols = [F.col(c).cast("double").alias(c) for c in features]
    laid = checkpointed(frame.select(*rest, *cols).repartition(n, KEY).sortWithinPartitions(KEY))
    gaps = laid.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in features], *[F.avg(c).alias(f"{c}__mean") for c in features])
    gaps = gaps.first()  # one row
    fill = {c: (gaps[f"{c}__mean"] or 0.0) if fill_missing is None else float(fill_missing) for c in features if gaps[c]}
    return laid.fillna(fill) if fill else laid


def fit(frame: DataFrame, preset: Preset, features: Sequence[str] = FEATURES) -> PipelineModel:
    return Pipeline(stages=[assembler(features), estimator(preset)]).fit(frame)


def first_rounds(model: PipelineModel, rounds: int) -> PipelineModel:
    """The boosted model of so many rounds: the first trees of one of more rounds, which a
    shorter fit would have grown too."""
    *before, boosted = model.stages
    if rounds >= boosted.getNumTrees:
        return model
    java, gateway = boosted._java_obj, SparkContext._gateway
    regression = gateway.jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(java.trees()[:rounds], boosted.treeWeights)):
        trees[i], weights[i] = tree, float(weight)
    short = GBTRegressionModel(regression.GBTRegressionModel(java.uid(), trees, weights, java.numFeatures()))
    return PipelineModel([*before, boosted._copyValues(short)])


def _fit_each(frame: DataFrame, presets: dict[str, Preset]) -> dict[str, PipelineModel]:
    """The model of every preset. Boosted presets that differ in rounds alone share the fit
    of the most rounds."""
    alike: dict[tuple, list[str]] = {}
    for name, p in presets.items():
        rest = {n: v for n, v in p.params.items() if n != "maxIter"}
        alike.setdefault((repr(sorted(rest.items())) if p.kind == "boosted" else name, p.kind), []).append(name)
    rounds = {n: p.params.get("maxIter", GBT_ROUNDS) for n, p in presets.items()}
    groups = [sorted(names, key=rounds.get) for names in alike.values()]
    made = {}
    for names, model in zip(groups, in_parallel(lambda names: fit(frame, presets[names[-1]]), groups)):
        made |= {n: first_rounds(model, rounds[n]) if presets[n].kind == "boosted" else model for n in names}
    return made


def score(model: PipelineModel, frame: DataFrame) -> DataFrame:
    """O-64: ``prediction`` (log scale) and ``predicted_cltv`` (back-transformed)."""
    return model.transform(frame).drop("features").withColumn("predicted_cltv", from_log_target("prediction"))


def final_model(model: PipelineModel):
    return model.stages[-1]


def coefficients(spark: SparkSession, model: PipelineModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """O-63a: linear coefficients and intercept as rows (model metadata)."""
    lr = final_model(model)
    rows = [(f, float(c)) for f, c in zip(features, lr.coefficients.toArray())] + [("intercept", float(lr.intercept))]
    return spark.createDataFrame(rows, "feature string, coefficient double")


def importances(spark: SparkSession, model: PipelineModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """O-63b..d: tree-ensemble feature importances as rows (model metadata)."""
    imp = final_model(model).featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    return spark.createDataFrame(rows, "feature string, importance double")


def holdout_metrics(model: PipelineModel, test: DataFrame) -> DataFrame:
    """O-65 for a fitted model on held-out rows: ``(n, rmse, r2, mae)``."""
    return M.regression_metrics(score(model, test), LABEL, "prediction")


def model_comparison(frame: DataFrame, presets: dict[str, Preset] | None = None, top_n: int = R.TOP_N) -> DataFrame:
    """O-66: each model fitted on the 80% split, RMSE/R² on the 20% holdout, top-n
    overlap of realised value and prediction over all rows (as the source does)."""
    presets = presets or PRESETS
    split = FO.train_test_split(frame)
    train, test = split.where(F.col("split") == "train"), split.where(F.col("split") == "test")
    out = None
    models = _fit_each(train, presets)
    for name in presets:
        model = models[name]
        m = holdout_metrics(model, test)
        ov = R.top_n_overlap(score(model, frame), "actual_cltv", "prediction", top_n, KEY)
        row = m.select(
            F.lit(name).alias("model"), "rmse", "r2", ov.select("overlap").scalar().alias("top_n_overlap")
        )
        out = row if out is None else out.unionByName(row)
    return out


def _fold_models(df: DataFrame, preset: Preset, k: int, fold_col: str = "fold") -> list[PipelineModel]:
    """For each fold the model of all other folds."""
    return in_parallel(lambda i: fit(df.where(F.col(fold_col) != i), preset), range(k))


def cv_rmse(frame: DataFrame, preset: Preset, k: int = FO.K_SHUFFLED) -> DataFrame:
    """O-67: shuffled k-fold RMSE per fold, with the mean over folds on every row."""
    df = FO.kfold_assign(frame, k=k)
    out = None
    for i, model in enumerate(_fold_models(df, preset, k)):
        m = holdout_metrics(model, df.where(F.col("fold") == i)).select(F.lit(i).alias("fold"), "rmse")
        out = m if out is None else out.unionByName(m)
    return out.withColumn("mean_rmse", F.avg("rmse").over(W.partitionBy(F.lit(0))))


def out_of_fold(frame: DataFrame, preset: Preset, k: int = FO.K_SHUFFLED) -> DataFrame:
    """O-69: per fold, fit on the other folds and predict the held-out rows; both
    the realised and predicted value back-transformed with ``expm1``."""
    df = FO.kfold_assign(frame, k=k)
    out = None
    for i, model in enumerate(_fold_models(df, preset, k)):
        part = score(model, df.where(F.col("fold") == i)).select(
            KEY, "fold", from_log_target(LABEL).alias("actual_cltv"), F.col("predicted_cltv").alias("pred_cltv")
        )
        out = part if out is None else out.unionByName(part)
    return out
