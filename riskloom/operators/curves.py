"""Curve tables: one row per distinct score, never a drawing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.functions.decisions import ratio
from riskloom.operators.classifier import cut_counts, ranked_points, score_points
from riskloom.operators.ordered import running_totals


def roc_points(
    df: DataFrame, score: str = "score", label: str = v.TARGET, by: Sequence[str] = (), drop_collinear: bool = False
) -> DataFrame:
    """Rows (by, threshold, fpr, tpr), from the point (0, 0) at an infinite threshold on.

    ``drop_collinear`` leaves out thresholds inside a straight run: those whose own counts
    equal the counts at the next lower threshold.
    """
    points = running_totals(
        score_points(df, score, label, by), "score", ["pos", "neg"], by, carry=["pos", "neg"] if drop_collinear else ()
    )
    tp, fp = cut_counts()
    if drop_collinear:
        top = (tp == F.col("pos")) & (fp == F.col("neg"))
        bottom = F.col("pos_prev").isNull()
        turn = (F.col("pos") != F.col("pos_prev")) | (F.col("neg") != F.col("neg_prev"))
        points = points.where(top | bottom | turn)
    curve = points.select(
        *by, F.col("score").alias("threshold"), F.try_divide(fp, F.col("neg_total")).alias("fpr"),
        F.try_divide(tp, F.col("pos_total")).alias("tpr"),
        # the highest score also stands for the start of the curve
        ((tp == F.col("pos")) & (fp == F.col("neg"))).alias("_top"),
    )
    start = F.struct(F.lit(math.inf).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    here = F.struct("threshold", "fpr", "tpr")
    return curve.select(*by, F.inline(F.when(F.col("_top"), F.array(start, here)).otherwise(F.array(here))))


def pr_points(df: DataFrame, score: str = "score", label: str = v.TARGET, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by, threshold, precision, recall, step_area, baseline).

    ``step_area`` is the trapezoid up to the next higher threshold (recall 0, precision 1
    above the highest), so its sum is the area under the curve.
    """
    tp, fp = cut_counts()
    above_tp, above_fp = tp - F.col("pos"), fp - F.col("neg")
    precision, recall = ratio(tp, tp + fp), F.try_divide(tp, F.col("pos_total"))
    above = F.when(above_tp + above_fp > 0, ratio(above_tp, above_tp + above_fp)).otherwise(1.0)
    width = recall - F.try_divide(above_tp, F.col("pos_total"))
    return ranked_points(df, score, label, by).select(
        *by, F.col("score").alias("threshold"), precision.alias("precision"), recall.alias("recall"),
        (width * (precision + above) / 2).alias("step_area"),
        F.try_divide(F.col("pos_total"), F.col("pos_total") + F.col("neg_total")).alias("baseline"),
    )


def curve_areas(df: DataFrame, score: str = "score", label: str = v.TARGET, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid areas of the ROC and precision-recall curves, per group."""
    tp, fp = cut_counts()
    above_tp, above_fp = tp - F.col("pos"), fp - F.col("neg")
    p_total, n_total = F.col("pos_total").cast("double"), F.col("neg_total").cast("double")
    roc_step = F.try_divide(F.col("neg").cast("double"), n_total) * F.try_divide(tp + above_tp, p_total) / 2
    above = F.when(above_tp + above_fp > 0, ratio(above_tp, above_tp + above_fp)).otherwise(1.0)
    pr_step = F.try_divide(F.col("pos").cast("double"), p_total) * (ratio(tp, tp + fp) + above) / 2
    return ranked_points(df, score, label, by).groupBy(*by).agg(
        F.sum(roc_step).alias("roc_area"), F.sum(pr_step).alias("pr_area"),
        F.max(F.try_divide(p_total, p_total + n_total)).alias("pr_baseline"),
    )


def gain_points(df: DataFrame, score: str = "score", label: str = v.TARGET, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative good and bad shares by descending score, ties merged."""
    tp, fp = cut_counts()
    good, bad = F.try_divide(fp, F.col("neg_total")), F.try_divide(tp, F.col("pos_total"))
    return ranked_points(df, score, label, by).select(
        *by, F.col("score").alias("threshold"),
        F.try_divide(tp + fp, F.col("pos_total") + F.col("neg_total")).alias("population"),
        good.alias("cumulative_good"), bad.alias("cumulative_bad"), F.abs(bad - good).alias("gap"),
    )


def youden_threshold(df: DataFrame, score: str = "score", label: str = v.TARGET, by: Sequence[str] = ()) -> DataFrame:
    """Threshold with the largest TPR - FPR, the highest on ties."""
    tp, fp = cut_counts()
    gap = F.try_divide(tp, F.col("pos_total")) - F.try_divide(fp, F.col("neg_total"))
    points = ranked_points(df, score, label, by).withColumn("_gap", gap)
    return points.groupBy(*by).agg(
        F.max_by("score", F.struct("_gap", "score")).alias("threshold"), F.max("_gap").alias("youden")
    )


def nearest_roc_points(
    df: DataFrame, thresholds: Sequence[float], score: str = "score", label: str = v.TARGET, by: Sequence[str] = (),
    drop_collinear: bool = True,
) -> DataFrame:
    """For each asked threshold the ROC point closest to it, the higher one on ties."""
    curve = roc_points(df, score, label, by, drop_collinear)

    def closest(t: float):
        rank = F.struct(F.abs(F.col("threshold") - t).alias("distance"), (-F.col("threshold")).alias("high"))
        found = F.min_by(F.struct("threshold", "fpr", "tpr"), rank)
        return F.struct(F.lit(float(t)).alias("asked"), found["threshold"].alias("threshold"),
                        found["fpr"].alias("fpr"), found["tpr"].alias("tpr"))

    return curve.groupBy(*by).agg(F.array(*[closest(t) for t in thresholds]).alias("_found")).select(
        *by, F.inline("_found")
    )


def highest_scored(df: DataFrame, score: str = "score", key: str = v.KEY, by: Sequence[str] = ()) -> DataFrame:
    """The row with the highest score, smallest key on ties."""
    rest = [c for c in df.columns if c not in by]
    top = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(key))).alias("_row")
    return df.groupBy(*by).agg(top).select(*by, "_row.*")
