"""Key joins that take the place of matching rows by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordered import join_groups


def match_actuals(predictions: DataFrame, actuals: DataFrame, key: str = "ID") -> DataFrame:
    """Predictions with the outcome of the same key."""
    return predictions.join(actuals, key, "inner")


def match_counts(predictions: DataFrame, actuals: DataFrame, key: str = "ID") -> DataFrame:
    """One row: matched keys and keys found on one side only, from one full join."""
    left = predictions.select(F.col(key), F.lit(1).alias("_p"))
    right = actuals.select(F.col(key), F.lit(1).alias("_a"))
    return left.join(right, key, "full").agg(
        F.count_if(F.col("_p").isNotNull() & F.col("_a").isNotNull()).alias("matched"),
        F.count_if(F.col("_a").isNull()).alias("predictions_only"),
        F.count_if(F.col("_p").isNull()).alias("actuals_only"),
    )


def single_row(df: DataFrame) -> DataFrame:
    """The one row of ``df``; an error when it is read if there are more or none."""
    one = F.assert_true(F.count(F.lit(1)) == 1, "a table of one row is needed").alias("_one")
    return df.agg(*[F.first(c).alias(c) for c in df.columns], one).where(F.col("_one").isNull()).drop("_one")


def with_parameters(df: DataFrame, parameters: DataFrame) -> DataFrame:
    """Put the single row of a parameter table on every row."""
    return df.crossJoin(F.broadcast(single_row(parameters)))


def with_share(counts: DataFrame, count: str = "n", by: Sequence[str] = (), name: str = "share") -> DataFrame:
    """Count rows plus their share of the group's total.

    The total is aggregated with map-side combine and joined back, so a large group is not
    gathered in one task.
    """
    total = counts.groupBy(*by).agg(F.sum(count).alias("_total"))
    share = F.try_divide(F.col(count), F.col("_total"))
    return join_groups(counts, total, by).withColumn(name, share).drop("_total")
