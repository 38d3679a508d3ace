"""Metrics of a binary classifier over a scored table.

Rows are first collapsed to one per distinct score (``pos`` and ``neg`` counts).  Every
metric, at every threshold, is then a sum over those points, so a table is scanned once
however many metrics, thresholds and groups are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.functions.decisions import ratio
from riskloom.operators.ordered import running_totals

SMALLEST_STEP = 2.220446049250313e-16  # double precision, bounds probabilities in the log loss


def score_points(df: DataFrame, score: str = "score", label: str = v.TARGET, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by, score, pos, neg); rows lacking a score or a label are left out."""
    y = F.col(label).cast("bigint")
    return (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    )


def ranked_points(
    df: DataFrame, score: str = "score", label: str = v.TARGET, by: Sequence[str] = (), **options
) -> DataFrame:
    """Score points with the counts below each score and the group totals."""
    return running_totals(score_points(df, score, label, by), "score", ["pos", "neg"], by, **options)


def cut_counts() -> tuple[Column, Column]:
    """True and false positives when everything from this score up is called positive."""
    return F.col("pos_total") - F.col("pos_below"), F.col("neg_total") - F.col("neg_below")


def cell_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Rates of a confusion matrix; 0 where a denominator is 0."""
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "specificity": ratio(tn, tn + fp),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
    }


def confusion(
    df: DataFrame, threshold: float, score: str = "score", label: str = v.TARGET, by: Sequence[str] = ()
) -> DataFrame:
    """Cells (by, tn, fp, fn, tp), zero for a class that does not occur."""
    called, bad = F.col(score) >= threshold, F.col(label) == 1
    cells = {"tn": ~called & ~bad, "fp": called & ~bad, "fn": ~called & bad, "tp": called & bad}
    return df.groupBy(*by).agg(*[F.count_if(test).alias(name) for name, test in cells.items()])


def order_metrics() -> dict[str, Column]:
    """Aggregates over ranked points that need no threshold."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp, fp = cut_counts()
    p_total, n_total = F.max("pos_total"), F.max("neg_total")
    gap = F.try_divide(tp, F.col("pos_total")) - F.try_divide(fp, F.col("neg_total"))
    p = F.col("score")
    safe = F.greatest(F.lit(SMALLEST_STEP), F.least(F.lit(1 - SMALLEST_STEP), p))
    size = (p_total + n_total).cast("double")
    wins = F.sum(pos * (F.col("neg_below").cast("double") + neg / 2))
    return {
        "n": p_total + n_total,
        "positives": p_total,
        "auc_roc": F.try_divide(wins, p_total.cast("double") * n_total),
        "ks": F.greatest(F.lit(0.0), F.max(gap)),
        "ks_two_sided": F.max(F.abs(gap)),
        "brier": F.sum(pos * (1 - p) * (1 - p) + neg * p * p) / size,
        "log_loss": F.sum(-pos * F.log(safe) - neg * F.log(1 - safe)) / size,
    }


def ranking_metrics(df: DataFrame, score: str = "score", label: str = v.TARGET, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by, n, positives, auc_roc, ks, ks_two_sided, brier, log_loss)."""
    metrics = order_metrics()
    return ranked_points(df, score, label, by).groupBy(*by).agg(*[x.alias(n) for n, x in metrics.items()])


def classification_metrics(
    df: DataFrame,
    thresholds: Sequence[float] = (v.DECISION_THRESHOLD,),
    score: str = "score",
    label: str = v.TARGET,
    by: Sequence[str] = (),
) -> DataFrame:
    """Full metric set per group and threshold: order metrics, cells and rates."""
    metrics = order_metrics()
    at = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.sum(F.when(F.col("score") >= t, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("score") >= t, F.col("neg")).otherwise(0)).alias("fp"),
        )
        for t in thresholds
    ]
    rows = (
        ranked_points(df, score, label, by).groupBy(*by)
        .agg(*[x.alias(n) for n, x in metrics.items()], F.array(*at).alias("cells"))
        .select(*by, *metrics, F.inline("cells"))
        .withColumns({"fn": F.col("positives") - F.col("tp"), "tn": F.col("n") - F.col("positives") - F.col("fp")})
    )
    return rows.withColumns(cell_metrics(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def business_metrics(
    cells: DataFrame, cost_fp: float = 1000.0, cost_fn: float = 10000.0, savings: str | None = None
) -> DataFrame:
    """Costs and savings from confusion cells.

    The baseline approves everyone.  With a ``savings`` column of stored results the
    baseline is total cost plus those savings instead.
    """
    fp_cost, fn_cost = F.col("fp") * F.lit(float(cost_fp)), F.col("fn") * F.lit(float(cost_fn))
    total = fp_cost + fn_cost
    baseline = (F.col("tp") + F.col("fn")) * F.lit(float(cost_fn)) if savings is None else total + F.col(savings)
    saved = baseline - total
    return cells.withColumns(
        {
            "cost_false_positives": fp_cost,
            "cost_false_negatives": fn_cost,
            "total_cost": total,
            "baseline_cost": baseline,
            "expected_savings": saved,
            "savings_percentage": ratio(saved, baseline) * 100,
            "roi": ratio(saved, baseline),
        }
    )


def class_report(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, macro, weighted and accuracy, as rows."""
    tp, fp, fn, tn = [F.col(c) for c in ("tp", "fp", "fn", "tn")]
    good = {"precision": ratio(tn, tn + fn), "recall": ratio(tn, tn + fp), "f1": ratio(2 * tn, 2 * tn + fn + fp)}
    bad = {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}
    n_good, n_bad = tn + fp, tp + fn
    n = n_good + n_bad

    def row(name: str, values: list[Column], support: Column) -> Column:
        named = zip(("precision", "recall", "f1"), values)
        return F.struct(F.lit(name).alias("class"), *[x.alias(c) for c, x in named], support.alias("support"))

    macro = [(good[c] + bad[c]) / 2 for c in good]
    weighted = [ratio(good[c] * n_good + bad[c] * n_bad, n) for c in good]
    rows = [
        row("No Default", list(good.values()), n_good),
        row("Default", list(bad.values()), n_bad),
        row("accuracy", [ratio(tp + tn, n)] * 3, n),
        row("macro avg", macro, n),
        row("weighted avg", weighted, n),
    ]
    return cells.select(*by, F.inline(F.array(*rows)))


def to_long(df: DataFrame, metrics: Sequence[str], keep: Sequence[str] = (), prefix: Column | str = "") -> DataFrame:
    """Metric columns as rows (keep, metric, value), names optionally prefixed."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    pairs = [
        F.struct(F.concat(prefix, F.lit(m)).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
    ]
    return df.select(*keep, F.inline(F.array(*pairs)))
