"""Evaluation of a prediction table against outcomes, as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.operators.calibration import calibration_error
from riskloom.operators.classifier import business_metrics, class_report, classification_metrics, to_long
from riskloom.operators.matching import match_actuals
from riskloom.runtime import pin
from riskloom.sources.files import save_json

CLASSIFICATION = [
    "accuracy", "precision", "recall", "f1_score", "specificity", "auc_roc", "brier_score", "ks_statistic",
    "true_positives", "true_negatives", "false_positives", "false_negatives",
    "true_positive_rate", "false_positive_rate", "false_negative_rate",
]
BUSINESS = [
    "total_cost", "cost_false_positives", "cost_false_negatives", "baseline_cost", "expected_savings",
    "savings_percentage", "roi",
]


def evaluation_row(
    scored: DataFrame, threshold: float = v.DECISION_THRESHOLD, cost_fp: float = 1000.0, cost_fn: float = 10000.0,
    score: str = "default_probability", label: str = v.TARGET, by: tuple[str, ...] = (),
) -> DataFrame:
    """Classification, business and size figures per group under their published names."""
    rows = business_metrics(classification_metrics(scored, [threshold], score, label, by), cost_fp, cost_fn)
    names = {
        "f1_score": F.col("f1"), "brier_score": F.col("brier"), "ks_statistic": F.col("ks"),
        "true_positives": F.col("tp"), "true_negatives": F.col("tn"),
        "false_positives": F.col("fp"), "false_negatives": F.col("fn"),
        "true_positive_rate": F.col("recall"), "false_positive_rate": F.col("fpr"), "false_negative_rate": F.col("fnr"),
    }
    return rows.withColumns(names).select(
        *by, F.col("threshold").alias("optimal_threshold"), F.col("n").alias("n_samples"),
        F.col("positives").alias("n_defaults"), (F.col("positives") / F.col("n")).alias("default_rate"),
        *CLASSIFICATION, *BUSINESS, "tp", "fp", "fn", "tn",
    )


def evaluate(
    predictions: DataFrame, actuals: DataFrame, threshold: float = v.DECISION_THRESHOLD, cost_fp: float = 1000.0,
    cost_fn: float = 10000.0, key: str = v.KEY, label: str = v.TARGET, path: str | None = None,
) -> DataFrame:
    """Join, decide, and return long rows (section, metric, value); written as JSON if a path is given."""
    if "default_probability" not in predictions.columns:
        raise ValueError("predictions need a default_probability column")
    if label not in actuals.columns:
        raise ValueError(f"actuals need a {label} column")
    pair = match_actuals(predictions.select(key, "default_probability"), actuals.select(key, label), key)
    rows = pin(pair.select("default_probability", label))
    row = pin(evaluation_row(rows, threshold, cost_fp, cost_fn, "default_probability", label))
    calibration = calibration_error(rows, 10, "default_probability", label).select(
        F.col("ece").alias("expected_calibration_error")
    )
    report = class_report(row)
    report_rows = report.select(
        F.lit("classification_report").alias("section"),
        F.inline(F.array(*[
            F.struct(F.concat_ws(" ", "class", F.lit(m)).alias("metric"), F.col(m).cast("double").alias("value"))
            for m in ("precision", "recall", "f1", "support")
        ])),
    )
    section = lambda df, name, cols: to_long(df, cols).select(F.lit(name).alias("section"), "metric", "value")
    result = (
        section(row, "size", ["optimal_threshold", "n_samples", "n_defaults", "default_rate"])
        .unionByName(section(row, "classification", CLASSIFICATION))
        .unionByName(section(row, "business", BUSINESS))
        .unionByName(section(calibration, "calibration", ["expected_calibration_error"]))
        .unionByName(report_rows)
    )
    if path:
        save_json(result, path)
    return result
