"""Exact stratified splits that do not move the rows.

Rows of a class are ordered by a seeded hash of the key.  The cut positions are exact
order statistics of that hash, found from two scans and a few candidate rows; each row
then compares itself with its class's cuts.  The result depends on keys and seed alone,
not on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.operators.ordered import join_groups, keys_at_ranks, small_side


def _shuffle_key(key: str, seed: int) -> Column:
    return F.struct(F.xxhash64(F.col(key), F.lit(seed)).alias("hash"), F.col(key).alias("key"))


def _with_part(df: DataFrame, cuts, key: str, strata: Sequence[str], shares: Sequence[float], seed: int) -> DataFrame:
    """Adds ``_part``: how many of the class's cut positions lie at or below the row.

    ``cuts(n)`` gives, per share, how many rows of an n-row class come before the cut.
    """
    place = _shuffle_key(key, seed)
    values = df.select(*strata, place.alias("key"), place["hash"].cast("double").alias("spread"))
    marks = keys_at_ranks(values, strata, shares, lambda n: [F.greatest(c - 1, F.lit(0)) for c in cuts(n)])
    marks = marks.select(*strata, F.col("n").alias("_n"), F.col("keys").alias("_marks"))
    placed = join_groups(df, small_side(marks) if strata else marks, strata, "left" if strata else "inner")
    beyond = [
        F.when((c > 0) & (place <= F.col("_marks")[i]), 0).otherwise(1)
        for i, c in enumerate(cuts(F.col("_n")))
    ]
    return placed.withColumn("_part", sum(beyond, F.lit(0))).drop("_n", "_marks")


def _half_up(share: float):
    return lambda n: F.floor(n * F.lit(share) + 0.5).cast("bigint")


def stratified_split(
    df: DataFrame, test_share: float = 0.2, label: str = v.TARGET, key: str = v.KEY, seed: int = 42, name: str = "split"
) -> DataFrame:
    """Adds ``split``: within each class exactly round(share * n) rows are ``test``."""
    cut = _half_up(test_share)
    split = _with_part(df, lambda n: [cut(n)], key, [label], [test_share], seed)
    return split.withColumn(name, F.when(F.col("_part") == 0, "test").otherwise("train")).drop("_part")


def three_way_split(
    df: DataFrame, test_share: float = 0.2, validation_share: float = 0.2, label: str = v.TARGET, key: str = v.KEY,
    seed: int = 42, name: str = "split",
) -> DataFrame:
    """Adds ``split``: test, then validation as a share of the rest, then train (64/16/20 by default)."""
    first = _half_up(test_share)

    def cuts(n: Column) -> list[Column]:
        test = first(n)
        return [test, test + _half_up(validation_share)(n - test)]

    shares = [test_share, test_share + (1 - test_share) * validation_share]
    split = _with_part(df, cuts, key, [label], shares, seed)
    names = F.when(F.col("_part") == 0, "test").when(F.col("_part") == 1, "validation").otherwise("train")
    return split.withColumn(name, names).drop("_part")


def stratified_folds(
    df: DataFrame, k: int = 5, label: str = v.TARGET, key: str = v.KEY, seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Adds ``fold`` 0..k-1; the folds of a class differ by at most one row."""
    cuts = lambda n: [F.floor(n * i / k).cast("bigint") for i in range(1, k)]
    split = _with_part(df, cuts, key, [label], [i / k for i in range(1, k)], seed)
    return split.withColumnRenamed("_part", name)


def class_weights(df: DataFrame, label: str = v.TARGET) -> DataFrame:
    """Rows (label, n, weight): balanced weights n / (classes * n_c)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_classes"))
    weight = F.col("_all").cast("double") / (F.col("_classes") * F.col("n"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", weight.alias("weight"))  # one row


def with_class_weight(df: DataFrame, label: str = v.TARGET, name: str = "weight") -> DataFrame:
    weights = small_side(class_weights(df, label).select(label, F.col("weight").alias(name)))
    return df.join(weights, label, "left")
