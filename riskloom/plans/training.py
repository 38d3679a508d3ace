"""Classifier training, calibration, validation and search with ``pyspark.ml``."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from riskloom import vocab as v
from riskloom.operators.classifier import business_metrics, classification_metrics, to_long
from riskloom.operators.splits import stratified_folds, three_way_split, with_class_weight
from riskloom.operators.sweep import COSTS, cost_optimal_threshold
from riskloom.plans import boosting
from riskloom.runtime import pin, shared_folder
from riskloom.sources.files import _exists
from riskloom.sources.runs import append_run, run_row

WEIGHT = "_weight"


# fixed values: settings of the published models
GRADIENT_BOOSTING = {"maxIter": 500, "maxDepth": 7, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
RANDOM_FOREST = {"numTrees": 200, "maxDepth": 10, "minInstancesPerNode": 5}
LOGISTIC = {"C": 1.0, "maxIter": 1000}


def estimator(kind: str, rows: int | None = None, seed: int = 42, weighted: bool = False, **settings):
    """An unfitted classifier on ``features``; ``settings`` override the published ones.

    The penalty of the logistic model is given as ``C``; the mean loss used here takes 1 / (C n).
    """
    common = {"featuresCol": "features", "labelCol": v.TARGET}
    if weighted:
        common["weightCol"] = WEIGHT
    if kind == "gradient_boosting":
        return GBTClassifier(**common, seed=seed, **{**GRADIENT_BOOSTING, **settings})
    if kind == "random_forest":
        return RandomForestClassifier(**common, seed=seed, **{**RANDOM_FOREST, **settings})
    if kind == "logistic_regression":
        options = {**LOGISTIC, **settings}
        strength = options.pop("C")
        penalty = 1.0 / (strength * rows) if rows else 0.0
        return LogisticRegression(**common, elasticNetParam=0.0, regParam=penalty, **options)
    raise ValueError(f"unknown model kind {kind!r}")


def model_pipeline(classifier, features: Sequence[str], scale: bool = False) -> Pipeline:
    """Assemble the named features in order, optionally scale them, and classify."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="raw" if scale else "features", handleInvalid="error")
    stages = [assembler, StandardScaler(inputCol="raw", outputCol="features", withMean=True)] if scale else [assembler]
    return Pipeline(stages=[*stages, classifier])


def fit_model(
    train: DataFrame, kind: str, features: Sequence[str] = tuple(v.MODEL_FEATURES), balanced: bool = False,
    scale: bool = False, seed: int = 42, cut: bool = True, **settings,
) -> PipelineModel:
    """A fitted pipeline.

    Boosting runs a job per level of every tree, and each ships the lineage of the rows to its tasks.  With ``cut``
    the assembled rows are checkpointed first, once a fit; the files stay as long as the checkpoints of the session do.
    """
    rows = train.count() if kind == "logistic_regression" else None
    data = with_class_weight(train, name=WEIGHT) if balanced else train
    pipeline = model_pipeline(estimator(kind, rows, seed, balanced, **settings), features, scale)
    if kind != "gradient_boosting" or not cut:
        return pipeline.fit(data)
    *before, classifier = pipeline.getStages()
    inputs = Pipeline(stages=before).fit(data)
    shared_folder(train.sparkSession)
    ready = inputs.transform(data).select("features", v.TARGET, *([WEIGHT] if balanced else [])).checkpoint()
    return PipelineModel([*inputs.stages, classifier.fit(ready)])


def scored(model: Transformer, df: DataFrame, name: str = "score", margin: str | None = None) -> DataFrame:
    """Rows with the probability of default, and optionally the raw margin."""
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    if margin:
        out = out.withColumn(margin, vector_to_array("rawPrediction")[1])
    return out.select(*df.columns, name, *([margin] if margin else []))


class Calibrator:
    """A fitted map from raw scores to probabilities."""

    def __init__(self, stage: Transformer, method: str, source: str):
        self.stage, self.method, self.source = stage, method, source

    def apply(self, df: DataFrame, name: str = "score") -> DataFrame:
        rest = [c for c in df.columns if c != name]
        fitted = self.stage.transform(df.withColumn("_x", F.col(self.source)))
        if self.method == "isotonic":
            value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_calibrated")))
        else:
            value = vector_to_array("_calibrated_probability")[1]
        return fitted.select(*rest, value.alias(name))


def fit_calibrator(df: DataFrame, method: str, source: str, label: str = v.TARGET) -> Calibrator:
    """Isotonic or sigmoid calibration of column ``source`` on held-out rows.

    Equal inputs are collapsed to weighted rows first, which leaves both fits unchanged.
    """
    points = df.groupBy(F.col(source).alias("_x"), F.col(label).cast("double").alias("_y")).agg(
        F.count(F.lit(1)).cast("double").alias("_w")
    )
    if method == "isotonic":
        stage = IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol="_calibrated").fit(points)
        return Calibrator(stage, method, source)
    if method == "sigmoid":
        vector = VectorAssembler(inputCols=["_x"], outputCol="_v")
        link = LogisticRegression(
            featuresCol="_v", labelCol="_y", weightCol="_w", probabilityCol="_calibrated_probability",
            rawPredictionCol="_calibrated_raw", predictionCol="_calibrated_label", maxIter=100,
        )
        return Calibrator(Pipeline(stages=[vector, link]).fit(points), method, source)
    raise ValueError(f"unknown calibration {method!r}")


def cross_calibrated_scores(
    train: DataFrame, test: DataFrame, kind: str, method: str, features: Sequence[str], k: int = 5, seed: int = 42,
    **settings,
) -> DataFrame:
    """Test rows with the mean of k calibrated models, each calibrated on the fold it did not see."""
    folded = pin(stratified_folds(train, k, seed=seed, name="_fold"))
    out = test
    for i in range(k):
        model = fit_model(folded.where(F.col("_fold") != i), kind, features, seed=seed, **settings)
        held_out = scored(model, folded.where(F.col("_fold") == i), "_p", "_margin")
        source = "_margin" if method == "sigmoid" else "_p"
        calibrator = fit_calibrator(held_out, method, source)
        out = calibrator.apply(scored(model, out, "_p", "_margin"), f"_s{i}").drop("_p", "_margin")
    mean: Column = reduce(lambda a, b: a + b, [F.col(f"_s{i}") for i in range(k)]) / float(k)
    return out.withColumn("score", mean).drop(*[f"_s{i}" for i in range(k)])


def prepare(df: DataFrame, features: Sequence[str] = tuple(v.MODEL_FEATURES)) -> DataFrame:
    """Key, target and the model's features as doubles; no alias of the target is a feature."""
    banned = set(v.TARGET_ALIASES) | {v.KEY}
    wanted = [f for f in features if f not in banned]
    return df.select(v.KEY, v.TARGET, *[F.col(f"`{f}`").cast("double").alias(_plain(f)) for f in wanted])


def _plain(name: str) -> str:
    return name.replace("-", "_").replace("+", "_plus").replace("<=", "le_")


def plain_features(features: Sequence[str] = tuple(v.MODEL_FEATURES)) -> list[str]:
    """Feature names as used inside models."""
    return [_plain(f) for f in features]


def train(
    df: DataFrame, kind: str = "gradient_boosting", calibration: str = "isotonic", costs: dict | None = None,
    features: Sequence[str] = tuple(v.MODEL_FEATURES), seed: int = 42, runs: str | None = None, experiment: str = "training",
    **settings,
) -> dict:
    """Split 64/16/20, fit, calibrate on validation, choose the threshold there, measure all splits.

    Returns the model, the calibrator, the threshold, and the scored and metric tables.  Every
    metric of every split comes from one scored table.  With ``runs`` the run is appended to that table:
    its parameters, threshold and named metrics.
    """
    costs = costs or COSTS
    names = plain_features(features)
    parts = pin(three_way_split(prepare(df, features), seed=seed))
    model = fit_model(parts.where("split = 'train'"), kind, names, seed=seed, **settings)
    margin = calibration == "sigmoid"
    raw = scored(model, parts, "raw_score", "margin" if margin else None)
    raw = pin(raw.select(v.KEY, v.TARGET, "split", "raw_score", *(["margin"] if margin else [])))  # the trees are walked once
    if calibration == "none":
        calibrator, final = None, raw.withColumn("score", F.col("raw_score"))
    else:
        calibrator = fit_calibrator(raw.where("split = 'validation'"), calibration, "margin" if margin else "raw_score")
        final = calibrator.apply(raw)
    table = pin(final.select(v.KEY, v.TARGET, "split", "raw_score", "score"))
    threshold = cost_optimal_threshold(table.where("split = 'validation'"), costs).first()["optimal_threshold"]
    metrics = credit_metrics(table, [0.5, threshold], by=["split"])
    if runs:
        metrics = pin(metrics)
        named = {r["metric"]: r["value"] for r in named_credit_metrics(metrics, threshold).collect() if r["value"] is not None}
        params = {"model_type": kind, "calibration": calibration, "seed": seed, "n_features": len(names), **costs, **settings}
        append_run(run_row(df.sparkSession, experiment, kind, params, {**named, "threshold": threshold}, {"model_type": kind}), runs)
    return {
        "model": model, "calibrator": calibrator, "threshold": threshold, "scored": table,
        "metrics": metrics, "business": business_metrics(metrics.where(F.col("threshold") == F.lit(threshold)), **costs),
    }


CREDIT_METRICS = ["auc_roc", "recall", "precision", "f1", "brier", "ks", "tn", "fp", "fn", "tp", "specificity"]


def credit_metrics(df: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ("split",), **options) -> DataFrame:
    """The tracked metric set per group and threshold, in one job."""
    return classification_metrics(df, thresholds, by=by, **options).select(*by, "threshold", *CREDIT_METRICS)


def named_credit_metrics(metrics: DataFrame, optimal: float, split: str = "split") -> DataFrame:
    """Long rows (metric, value) with names such as ``val_optimal_recall``."""
    short = F.when(F.col(split) == "validation", "val").otherwise(F.col(split))
    infix = F.when(F.col("threshold") == F.lit(optimal), "_optimal_").otherwise("_")
    return to_long(metrics, CREDIT_METRICS, prefix=F.concat(short, infix)).select("metric", "value")


def _fold_metrics(
    folded: DataFrame, kind: str, features: Sequence[str], seed: int, balanced: bool = False, scale: bool = False,
    threshold: float = 0.5, cut: bool = True, **settings,
) -> DataFrame:
    """Rows (fold, auc_roc, recall, precision) of models that each leave one value of ``fold`` out."""
    folds = sorted(r[0] for r in folded.select("fold").distinct().collect())  # the k folds
    parts = []
    for i in folds:
        model = fit_model(folded.where(F.col("fold") != i), kind, features, balanced, scale, seed, cut, **settings)
        parts.append(scored(model, folded.where(F.col("fold") == i)).select("fold", v.TARGET, "score"))
    table = reduce(DataFrame.unionByName, parts)
    return classification_metrics(table, [threshold], by=["fold"]).select("fold", "auc_roc", "recall", "precision")


def cross_validate(
    df: DataFrame, kind: str, features: Sequence[str], k: int = 5, seed: int = 42, balanced: bool = False,
    scale: bool = False, threshold: float = 0.5, **settings,
) -> DataFrame:
    """Rows (fold, auc_roc, recall, precision) over stratified folds."""
    folded = pin(stratified_folds(df, k, seed=seed))
    return _fold_metrics(folded, kind, features, seed, balanced, scale, threshold, **settings)


def fold_summary(per_fold: DataFrame, metrics: Sequence[str] = ("auc_roc", "recall", "precision")) -> DataFrame:
    """Rows (metric, mean, std) with the population deviation."""
    return to_long(per_fold, metrics).groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


# fixed values: searched ranges (name, low, high, scale); leaf counts and penalties have no
# counterpart in depth-wise trees and act through depth and instances per node
SEARCH_SPACE = [
    ("learning_rate", 0.01, 0.3, "log"),
    ("n_estimators", 100, 500, "int"),
    ("max_depth", 3, 12, "int"),
    ("min_child_samples", 5, 50, "int"),
    ("feature_fraction", 0.6, 1.0, "uniform"),
    ("bagging_fraction", 0.6, 1.0, "uniform"),
]
SETTING_NAMES = {
    "learning_rate": "stepSize", "n_estimators": "maxIter", "max_depth": "maxDepth",
    "min_child_samples": "minInstancesPerNode", "feature_fraction": "featureSubsetStrategy",
    "bagging_fraction": "subsamplingRate",
}


def sample_settings(trials: int, seed: int = 42, space: Sequence[tuple] = tuple(SEARCH_SPACE)) -> list[dict]:
    """Seeded random draws from the search space."""
    draw = random.Random(seed)

    def value(low, high, scale):
        if scale == "int":
            return draw.randint(low, high)
        if scale == "log":
            return math.exp(draw.uniform(math.log(low), math.log(high)))
        return draw.uniform(low, high)

    return [{name: value(low, high, scale) for name, low, high, scale in space} for _ in range(trials)]


def _grown_aucs(folded: DataFrame, features: Sequence[str], settings: Sequence[dict], seed: int) -> list[float]:
    """The mean AUC over the folds per setting, all models grown in one job."""
    table = pin(boosting.held_out_scores(folded, features, settings, seed))
    folds = classification_metrics(table, [0.5], by=["trial", "fold"]).select("trial", "fold", "auc_roc", "recall", "precision")
    found = {r["trial"]: r["auc"] for r in folds.groupBy("trial").agg(F.avg("auc_roc").alias("auc")).collect()}  # one row per trial
    return [float(found[i]) for i in range(len(settings))]


def _fitted_aucs(folded: DataFrame, features: Sequence[str], settings: Sequence[dict], seed: int, parallelism: int) -> list[float]:
    """The mean AUC over the folds per setting, by fits whose rows stay dealt out."""
    @inheritable_thread_target(folded.sparkSession)
    def auc(options: dict) -> float:
        folds = _fold_metrics(folded, "gradient_boosting", features, seed, cut=False, **options)
        return float(folds.agg(F.avg("auc_roc")).first()[0])

    with ThreadPoolExecutor(parallelism) as pool:
        running = [pool.submit(auc, options) for options in settings]
        done, _ = wait(running, return_when=FIRST_EXCEPTION)
        if any(f.exception() for f in done):
            pool.shutdown(cancel_futures=True)
        return [f.result() for f in running if not f.cancelled()]


def search(
    df: DataFrame, features: Sequence[str], trials: int = 50, k: int = 5, seed: int = 42,
    space: Sequence[tuple] = tuple(SEARCH_SPACE), parallelism: int = 4, **fixed,
) -> DataFrame:
    """Rows (trial, params, cv_auc), best first.

    Folds are cut once and stored.  While a task can hold the binned rows (they are counted), each model is grown
    whole in a task of its own, and one job scores all trials and folds (``boosting.held_out_scores``).  Beyond that,
    or with other settings, ``parallelism`` trials run at a time, each a series of Spark jobs on the stored folds
    without checkpoints of their own, which would be a copy of the rows per fold and trial; scores do not
    depend on ``parallelism``, and the first trial to fail ends the search.
    """
    spark = df.sparkSession
    folded = pin(stratified_folds(df, k, seed=seed))
    drawn = sample_settings(trials, seed, space)
    settings = [
        {**{SETTING_NAMES[n]: str(x) if n == "feature_fraction" else x for n, x in params.items()}, **fixed} for params in drawn
    ]
    if boosting.fits(folded, features, settings):
        scores = _grown_aucs(folded, features, settings, seed)
    else:
        scores = _fitted_aucs(folded, features, settings, seed, parallelism)
    rows = [(i, {n: str(x) for n, x in params.items()}, s) for i, (params, s) in enumerate(zip(drawn, scores, strict=True))]
    table = spark.createDataFrame(rows, "trial int, params map<string,string>, cv_auc double")
    return table.orderBy(F.desc("cv_auc"), "trial")


def feature_importance(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """Rows (feature, importance): tree importances or absolute coefficients."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(f, abs(float(x))) for f, x in zip(features, values.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def linear_weights(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    """Log-odds that a unit of each feature adds in a fitted logistic model, its scaling undone."""
    values = model.stages[-1].coefficients.toArray()
    scalers = [stage for stage in model.stages if isinstance(stage, StandardScalerModel)]
    if scalers:
        spread = scalers[0].std.toArray()
        values = [w / s if s > 0 else 0.0 for w, s in zip(values, spread)]  # a constant feature adds nothing
    return {f: float(w) for f, w in zip(features, values)}


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    if not _exists(spark, f"{path}/metadata"):
        raise FileNotFoundError(f"Model not found: {path}")
    return PipelineModel.load(path)


def model_record(
    scored_table: DataFrame, features: int, params: dict, version: str = "1.0.0", split: str = "split", metrics: dict | None = None,
) -> DataFrame:
    """One JSON record: feature count, rows and target share per split, parameters, version, and the metrics if given."""
    shares = scored_table.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col(v.TARGET).cast("double")).alias("target_share")
    )
    entries = F.array_sort(F.collect_list(F.struct(split, "rows", "target_share")))  # one per split
    literal = F.create_map(*[F.lit(x) for k, value in sorted(params.items()) for x in (k, str(value))]) if params \
        else F.create_map().cast("map<string,string>")
    fields = [F.lit(features).alias("n_features"), F.col("splits"), literal.alias("params"), F.lit(version).alias("version")]
    if metrics:
        fields.append(F.create_map(*[F.lit(x) for k, value in sorted(metrics.items()) for x in (k, float(value))]).alias("metrics"))
    body = F.struct(*fields)
    return shares.agg(entries.alias("splits")).select(F.to_json(body).alias("record"))

