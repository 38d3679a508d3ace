"""Scores to decisions: bands, limits, status labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import vocab as v


def risk_band(p: Column, approve_below: float = v.APPROVE_BELOW, review_below: float = v.REVIEW_BELOW) -> Column:
    approve, review, reject = v.BANDS
    return F.when(p < approve_below, approve).when(p < review_below, review).otherwise(reject)


def credit_limit(p: Column, band: Column | None = None, base: float = v.BASE_LIMIT) -> Column:
    """Suggested limit by band; the slopes refer to the default cuts whatever the band came from."""
    approve, review, _ = v.BANDS
    band = risk_band(p) if band is None else band
    full, reduced = 1.0 - (p / 0.20) * 0.2, 0.6 - ((p - 0.20) / 0.30) * 0.2
    return F.when(band == approve, full * base).when(band == review, reduced * base).otherwise(0.0)


def decision(p: Column, threshold: float = v.DECISION_THRESHOLD) -> Column:
    return (p >= threshold).cast("int")


def decision_label(p: Column, threshold: float = v.DECISION_THRESHOLD) -> Column:
    return F.when(p >= threshold, "DEFAULT").otherwise("NO_DEFAULT")


def psi_status(
    psi: Column, warning: float = v.PSI_WARNING, critical: float = v.PSI_CRITICAL, lower_case: bool = False
) -> Column:
    names = ["ok", "warning", "critical"] if lower_case else ["OK", "WARNING", "CRITICAL"]
    return F.when(psi < warning, names[0]).when(psi < critical, names[1]).otherwise(names[2])


def stability_label(cv: Column, stable: float = 0.05, variable: float = 0.10) -> Column:
    return F.when(cv < stable, "stable").when(cv < variable, "high").otherwise("unstable")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole != 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def with_decisions(
    df: DataFrame,
    score: str = "score",
    threshold: float = v.DECISION_THRESHOLD,
    approve_below: float = v.APPROVE_BELOW,
    review_below: float = v.REVIEW_BELOW,
    include_features: bool = False,
    keep: Sequence[str] = (v.KEY,),
    at: Column | None = None,
) -> DataFrame:
    """Scored rows to the prediction table; inputs stay on the row, so nothing is joined back."""
    p = F.col(score)
    band = risk_band(p, approve_below, review_below)
    made = [
        p.alias("default_probability"),
        decision(p, threshold).alias("default_prediction"),
        band.alias("risk_band"),
        credit_limit(p, band).alias("suggested_credit_limit_mxn"),
    ]
    if at is not None:
        made.append(F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("prediction_timestamp"))
    kept = [c for c in df.columns if c != score] if include_features else list(keep)
    return df.select(*[F.col(f"`{c}`") for c in kept], *made)


def with_online_response(
    df: DataFrame, score: str = "score", threshold: float = v.DECISION_THRESHOLD, version: str = "1.0.0",
    keep: Sequence[str] = (v.KEY,), at: Column | None = None,
) -> DataFrame:
    """Scored rows to the service's answer: probability to 4 places, label, band, threshold, version."""
    p = F.col(score)
    return df.select(
        *keep,
        F.round(p, 4).alias("probability"),
        decision_label(p, threshold).alias("prediction"),
        risk_band(p).alias("risk_band"),
        F.lit(threshold).alias("threshold_used"),
        F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.lit(version).alias("model_version"),
    )


# fixed values: published model goals (metric, operator, target)
GOALS = [
    ("auc_roc", ">=", 0.80),
    ("ks", ">=", 0.30),
    ("recall", ">=", 0.70),
    ("precision", ">=", 0.30),
    ("brier", "<=", 0.20),
]


def rule_table(spark, rows, schema: str) -> DataFrame:
    """A small literal table of rules."""
    return spark.createDataFrame(rows, schema)


def check_goals(metrics: DataFrame, goals: Sequence[tuple] = tuple(GOALS)) -> DataFrame:
    """Long rows (metric, value) against targets: adds ``op``, ``target`` and ``met``."""
    targets = rule_table(metrics.sparkSession, list(goals), "metric string, op string, target double")
    met = F.when(F.col("op") == ">=", F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    return metrics.join(F.broadcast(targets), "metric").withColumn("met", met)


def goals_met(checked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    met = F.count_if("met")
    return checked.groupBy(*by).agg(
        met.alias("met"), F.count(F.lit(1)).alias("goals"),
        (met.cast("double") / F.count(F.lit(1)) * 100).alias("percent"),
    )
