"""Threshold sweeps: every threshold of a grid from one scan."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.operators.classifier import business_metrics, cell_metrics, ranking_metrics
from riskloom.operators.curves import youden_threshold
from riskloom.operators.ordered import join_groups

# fixed values: the two grids, cost pairs and goals in use
HUNDREDTHS = np.linspace(0.01, 0.99, 99).tolist()
NINETY = np.arange(0.05, 0.95, 0.01).tolist()
COSTS = {"cost_fp": 1000.0, "cost_fn": 10000.0}
NOTEBOOK_COSTS = {"cost_fp": 500.0, "cost_fn": 10000.0}
MIN_RECALL = 0.70
MIN_PRECISION = 0.30


def threshold_cells(
    df: DataFrame, grid: Sequence[float] = tuple(HUNDREDTHS), score: str = "score", label: str = v.TARGET,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows (by, threshold, tn, fp, fn, tp) for every threshold of a rising grid.

    A row is counted once, in the grid cell of its score (a binary search); a threshold's
    positives are the cells at or above it.
    """
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn(
        "_score", F.col(score).cast("double")
    )
    splits = [-math.inf, *grid, math.inf]
    y = F.col(label).cast("bigint")
    cells = (
        Bucketizer(splits=splits, inputCol="_score", outputCol="_cell").transform(known)
        .groupBy(*by, "_cell").agg(F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg"))
    )
    marks = F.array(*[F.struct(F.lit(i + 1).alias("_step"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])
    reached = F.col("_cell") >= F.col("_step")
    return (
        cells.select(*by, "_cell", "_pos", "_neg", F.inline(marks)).groupBy(*by, "threshold")
        .agg(
            F.sum(F.when(reached, 0).otherwise(F.col("_neg"))).alias("tn"),
            F.sum(F.when(reached, F.col("_neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(reached, 0).otherwise(F.col("_pos"))).alias("fn"),
            F.sum(F.when(reached, F.col("_pos")).otherwise(0)).alias("tp"),
        )
    )


def _rated(cells: DataFrame, costs: dict) -> DataFrame:
    rates = cell_metrics(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    cost = F.col("fp") * F.lit(costs["cost_fp"]) + F.col("fn") * F.lit(costs["cost_fn"])
    wanted = {c: rates[c] for c in ("accuracy", "precision", "recall", "f1")}
    return cells.withColumns(wanted).withColumn("total_cost", cost)


def sweep(
    df: DataFrame, grid: Sequence[float] = tuple(HUNDREDTHS), costs: dict | None = None, score: str = "score",
    label: str = v.TARGET, by: Sequence[str] = (),
) -> DataFrame:
    """Cells, rates and cost at every threshold."""
    return _rated(threshold_cells(df, grid, score, label, by), costs or COSTS)


def full_sweep(
    df: DataFrame, grid: Sequence[float] = tuple(NINETY), costs: dict | None = None, score: str = "score",
    label: str = v.TARGET, by: Sequence[str] = (),
) -> DataFrame:
    """A sweep whose rows also carry the threshold-free metrics, computed once per group."""
    free = ranking_metrics(df, score, label, by).select(
        *by, "auc_roc", F.col("ks_two_sided").alias("ks"), "brier"
    )
    return join_groups(sweep(df, grid, costs or NOTEBOOK_COSTS, score, label, by), free, by)


def _first_best(value: str, best: Column) -> Column:
    """``value`` of the row with the least ``best``, the lowest threshold on ties."""
    return F.min_by(value, F.struct(best, F.col("threshold")))


def cost_optimal_threshold(
    df: DataFrame, costs: dict | None = None, grid: Sequence[float] = tuple(HUNDREDTHS), score: str = "score",
    label: str = v.TARGET, by: Sequence[str] = (),
) -> DataFrame:
    """The cheapest threshold, its cells, and savings against approving everyone."""
    costs = costs or COSTS
    swept = sweep(df, grid, costs, score, label, by)
    row = F.struct("threshold", "tn", "fp", "fn", "tp")
    best = swept.groupBy(*by).agg(F.min_by(row, F.struct("total_cost", "threshold")).alias("_row"))
    return business_metrics(best.select(*by, "_row.*"), **costs).select(
        *by, F.col("threshold").alias("optimal_threshold"), F.col("total_cost").alias("optimal_cost"),
        "baseline_cost", "expected_savings", "savings_percentage", "tn", "fp", "fn", "tp",
    )


def chosen_thresholds(swept: DataFrame, by: Sequence[str] = (), min_recall: float = MIN_RECALL) -> DataFrame:
    """Rows (by, rule, threshold): least cost, best F1, best precision at enough recall."""
    enough = F.col("recall") >= min_recall
    target = F.coalesce(
        F.min_by(F.when(enough, F.col("threshold")), F.when(enough, F.struct(-F.col("precision"), F.col("threshold")))),
        _first_best("threshold", -F.col("recall")),
    )
    picked = swept.groupBy(*by).agg(
        _first_best("threshold", F.col("total_cost")).alias("min_cost"),
        _first_best("threshold", -F.col("f1")).alias("max_f1"),
        target.alias("recall_target"),
    )
    rules = [F.struct(F.lit(r).alias("rule"), F.col(r).alias("threshold")) for r in ("min_cost", "max_f1", "recall_target")]
    return picked.select(*by, F.inline(F.array(*rules)))


def threshold_rules(
    df: DataFrame, grid: Sequence[float] = tuple(NINETY), costs: dict | None = None, score: str = "score",
    label: str = v.TARGET, by: Sequence[str] = (),
) -> DataFrame:
    """The three sweep rules plus Youden's threshold, as rows (by, rule, threshold)."""
    swept = sweep(df, grid, costs or NOTEBOOK_COSTS, score, label, by)
    youden = youden_threshold(df, score, label, by).select(*by, F.lit("youden").alias("rule"), "threshold")
    return chosen_thresholds(swept, by).unionByName(youden)


def final_threshold(
    swept: DataFrame, by: Sequence[str] = (), min_recall: float = MIN_RECALL, min_precision: float = MIN_PRECISION
) -> DataFrame:
    """Cheapest threshold meeting both goals, else the recall goal, else cheapest of all."""
    recall_ok, precision_ok = F.col("recall") >= min_recall, F.col("precision") >= min_precision
    preference = F.when(recall_ok & precision_ok, 0).when(recall_ok, 1).otherwise(2)
    rest = [c for c in swept.columns if c not in by]
    order = F.struct(preference.alias("preference"), F.col("total_cost"), F.col("threshold"))
    goal = F.element_at(F.array(F.lit("both"), F.lit("recall"), F.lit("cost")), F.col("preference") + 1)
    return (
        swept.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("_row"), F.min(preference).alias("preference"))
        .select(*by, goal.alias("met"), "_row.*")
    )


def compare_thresholds(
    df: DataFrame, grid: Sequence[float] = tuple(NINETY), costs: dict | None = None, score: str = "score",
    label: str = v.TARGET, default: float = 0.5,
) -> DataFrame:
    """Chosen thresholds side by side: metrics, cost, and goal flags.

    The chosen values are at most five numbers, so they are read and evaluated together in
    one more scan (Youden's need not be on the grid).
    """
    costs = costs or NOTEBOOK_COSTS
    chosen = [("default", float(default))] + [
        (r["rule"], r["threshold"]) for r in threshold_rules(df, grid, costs, score, label).collect()
    ]
    names = df.sparkSession.createDataFrame(chosen, "rule string, threshold double")
    rated = sweep(df, sorted({t for _, t in chosen}), costs, score, label)
    return rated.join(F.broadcast(names), "threshold").withColumns(
        {"recall_ok": F.col("recall") >= MIN_RECALL, "precision_ok": F.col("precision") >= MIN_PRECISION}
    )


def savings_between(
    df: DataFrame, chosen: float, default: float = 0.5, costs: dict | None = None, score: str = "score",
    label: str = v.TARGET, by: Sequence[str] = (),
) -> DataFrame:
    """Cost at the default threshold, at the chosen one, and their difference; costs stay on the row."""
    costs = costs or NOTEBOOK_COSTS
    rows = sweep(df, sorted({float(default), float(chosen)}), costs, score, label, by)
    at = lambda t: F.max(F.when(F.col("threshold") == F.lit(float(t)), F.col("total_cost")))
    return rows.groupBy(*by).agg(
        at(default).alias("default_cost"), at(chosen).alias("chosen_cost"), (at(default) - at(chosen)).alias("savings")
    ).withColumns({k: F.lit(c) for k, c in costs.items()})
