"""Training, calibration, scoring and explanation jobs (row checks only, save where noted)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import panel, query
from riskloom import vocab as v
from riskloom.functions.features import with_features
from riskloom.operators import attribution
from riskloom.operators.classifier import ranking_metrics
from riskloom.operators.splits import stratified_split
from riskloom.plans import calibrated, scoring, training
from riskloom.runtime import pin, scratch_path
from riskloom.sources.runs import append_run, run_row

INPUTS = ["LIMIT_BAL", "AGE", "PAY_0", "PAY_2", "BILL_AMT1", "PAY_AMT1", "utilization_1", "payment_ratio_1"]


def featured(spark, folder, features=tuple(v.MODEL_FEATURES)):
    return training.prepare(with_features(panel(spark, folder).drop("score"), "notebook"), features)


def trained(spark, folder, kind="gradient_boosting", calibration="isotonic", **settings):
    rows = with_features(panel(spark, folder).drop("score"), "notebook")
    return training.train(rows, kind, calibration, **settings)


def metric_rows(result):
    return result["metrics"].select("split", "threshold", "auc_roc", "ks", "brier", "recall", "precision")


@query("train_gradient_boosting")
def _(spark, folder):
    return metric_rows(trained(spark, folder))


@query("train_random_forest")
def _(spark, folder):
    return metric_rows(trained(spark, folder, "random_forest", "sigmoid"))


@query("train_logistic_regression")
def _(spark, folder):
    return metric_rows(trained(spark, folder, "logistic_regression", "none"))


@query("balanced_logistic_regression")
def _(spark, folder):
    rows = pin(featured(spark, folder))
    model = training.fit_model(rows, "logistic_regression", training.plain_features(), balanced=True, scale=True)
    return ranking_metrics(training.scored(model, rows))


@query("calibrated_scores_isotonic")
def _(spark, folder):
    rows = panel(spark, folder).select("ID", v.TARGET, F.col("score").alias("raw"))
    calibrator = training.fit_calibrator(rows, "isotonic", "raw")
    return calibrator.apply(rows)


@query("calibrated_scores_sigmoid")
def _(spark, folder):
    rows = panel(spark, folder).select("ID", v.TARGET, F.col("score").alias("raw"))
    return training.fit_calibrator(rows, "sigmoid", "raw").apply(rows)


@query("cross_calibrated_scores")
def _(spark, folder):
    parts = pin(stratified_split(featured(spark, folder)))
    train, test = parts.where("split = 'train'").drop("split"), parts.where("split = 'test'").drop("split")
    return training.cross_calibrated_scores(
        train, test, "logistic_regression", "isotonic", training.plain_features()
    ).select("ID", "score")


@query("cross_validation")
def _(spark, folder):
    rows = pin(featured(spark, folder))
    folds = training.cross_validate(rows, "logistic_regression", training.plain_features(), balanced=True, scale=True)
    return training.fold_summary(folds)


@query("parameter_search")
def _(spark, folder):
    rows = pin(featured(spark, folder, INPUTS))
    return training.search(rows, training.plain_features(INPUTS))


@query("saved_calibrated_model")
def _(spark, folder):
    """Trained, calibrated and given a threshold; saved, loaded, and applied to all rows."""
    path = scratch_path(spark, "calibrated")
    training.save_model(calibrated.calibrated_model(trained(spark, folder, "logistic_regression", "isotonic")), path)
    return calibrated.decided(training.load_model(spark, path), featured(spark, folder))


@query("recorded_training_run")
def _(spark, folder):
    """The run that training appends, as the record of its model."""
    path = scratch_path(spark, "training-runs")
    result = trained(spark, folder, "logistic_regression", "sigmoid", runs=path)
    run = spark.read.parquet(path).first()
    return training.model_record(result["scored"], len(v.MODEL_FEATURES), run["params"], metrics=run["metrics"])


@query("feature_importance")
def _(spark, folder):
    rows = pin(featured(spark, folder))
    names = training.plain_features()
    return training.feature_importance(training.fit_model(rows, "gradient_boosting", names), names, spark)


@query("batch_scoring_with_saved_model")
def _(spark, folder):
    names = training.plain_features()
    path = scratch_path(spark, "model")
    training.save_model(training.fit_model(pin(featured(spark, folder)), "gradient_boosting", names), path)
    raw = panel(spark, folder).drop("score")
    return scoring.score_and_save(training.load_model(spark, path), raw, scratch_path(spark, "scored"), variant="notebook")


@query("reference_scores")
def _(spark, folder):
    names = training.plain_features()
    model = training.fit_model(pin(featured(spark, folder)), "random_forest", names)
    return scoring.model_scores(model, with_features(panel(spark, folder).drop("score"), "notebook"))


@query("training_runs")
def _(spark, folder):
    rows = panel(spark, folder)
    path = scratch_path(spark, "runs")
    best = ranking_metrics(rows).first()
    metrics = {"auc_roc": best["auc_roc"], "ks_statistic": best["ks"]}
    append_run(run_row(spark, "panel", "given-score", {"source": {"column": "score"}}, metrics, {"model_type": "given"}), path)
    return spark.read.parquet(path).select("experiment", "run_name", "status", F.to_json("params").alias("params"),
                                           F.to_json("metrics").alias("metrics"))


@query("model_record")
def _(spark, folder):
    split = stratified_split(panel(spark, folder))
    return training.model_record(split, len(v.MODEL_FEATURES), training.GRADIENT_BOOSTING)


def explained(spark, folder):
    """All rows, the documented background, and the scaled logistic model with its features."""
    rows = pin(featured(spark, folder))
    names = training.plain_features()
    model = training.fit_model(rows, "logistic_regression", names, scale=True)
    return rows, attribution.hash_sample(rows, attribution.BACKGROUND_ROWS, seed=7), model, names


@query("shapley_ranking")
def _(spark, folder):
    rows, background, model, names = explained(spark, folder)
    found = attribution.shapley(
        attribution.hash_sample(rows, attribution.SAMPLE_ROWS), background, names, lambda states: training.scored(model, states)
    )
    return attribution.attribution_ranking(found)


@query("top_attributions_per_row")
def _(spark, folder):
    """Parts of the log-odds of every row, exact for a linear model."""
    rows, background, model, names = explained(spark, folder)
    return attribution.top_attributions(
        attribution.linear_shapley(rows, background, training.linear_weights(model, names))
    )
