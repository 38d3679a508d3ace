"""Group fairness of decisions, and production gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.functions.decisions import ratio
from riskloom.operators.ranking import with_value_groups


def group_fairness(
    df: DataFrame, group: str, threshold: float = v.DECISION_THRESHOLD, score: str = "score", label: str = v.TARGET,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows (by, group, n, base_rate, selection_rate, precision, recall, fpr, fnr).

    Rows without a score or label are left out.  Rates are 0 where undefined, and ``fnr`` is
    1 - recall throughout.
    """
    called, bad = F.col(score) >= threshold, F.col(label) == 1
    tp, fp = F.count_if(called & bad), F.count_if(called & ~bad)
    positives, negatives, n = F.count_if(bad), F.count_if(~bad), F.count(F.lit(1))
    recall = ratio(tp, positives)
    usable = F.col(group).isNotNull() & F.col(score).isNotNull() & F.col(label).isNotNull()
    return df.where(usable).groupBy(*by, F.col(group).cast("string").alias("group")).agg(
        n.alias("n"), ratio(positives, n).alias("base_rate"), ratio(tp + fp, n).alias("selection_rate"),
        ratio(tp, tp + fp).alias("precision"), recall.alias("recall"), ratio(fp, negatives).alias("fpr"),
        (1 - recall).alias("fnr"),
    )


def fairness_by_sex(df: DataFrame, column: str = "SEX", **options) -> DataFrame:
    name = F.when(F.col(column) == 1, "Masculino").otherwise("Femenino")
    return group_fairness(df.withColumn("_sex", name), "_sex", **options)


def fairness_by_value(df: DataFrame, column: str, **options) -> DataFrame:
    """Fairness over quartile groups of a continuous column, or over its few values."""
    return group_fairness(with_value_groups(df, column, "_group"), "_group", **options)


def disparate_impact(groups: DataFrame, by: Sequence[str] = (), limit: float = 0.8) -> DataFrame:
    """Lowest over highest selection rate, flagged below the limit."""
    rates = groups.groupBy(*by).agg(
        F.min("selection_rate").alias("lowest"), F.max("selection_rate").alias("highest"),
        F.count(F.lit(1)).alias("groups"),
    )
    return rates.withColumn("disparate_impact", ratio(F.col("lowest"), F.col("highest"))).withColumn(
        "biased", F.col("disparate_impact") < limit
    )


def parity_gaps(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Demographic parity, equal opportunity and equalised odds gaps."""
    gap = lambda c: F.max(c) - F.min(c)
    return groups.groupBy(*by).agg(
        gap("selection_rate").alias("demographic_parity_gap"), gap("recall").alias("equal_opportunity_gap"),
        F.greatest(gap("recall"), gap("fpr")).alias("equalised_odds_gap"),
    )


# fixed values: requirements of a production model
PRODUCTION_GATES = [
    ("auc_roc", ">=", 0.75),
    ("ks_statistic", ">=", 0.30),
    ("recall", ">=", 0.70),
    ("precision", ">=", 0.30),
    ("brier_score", "<=", 0.20),
    ("expected_savings", ">=", 1000000.0),
    ("savings_percentage", ">=", 10.0),
    ("train_test_auc_diff", "<=", 0.05),
    ("train_test_ks_diff", "<=", 0.05),
]


def production_gate(checked: DataFrame) -> DataFrame:
    """One row from goal-checked metric rows: all met, and the failed metrics."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("met"), F.col("metric"))))
    return checked.agg(F.bool_and("met").alias("ready"), failed.alias("failed"))
