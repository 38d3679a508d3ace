"""Joins, ranks and components that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.runtime import pin

#: a key with at least 1/HOT_SHARE of all rows is hot, so there are at most HOT_SHARE hot keys
HOT_SHARE = 1_000


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"__{k}"]) for k in keys])


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per key and ``rows``, the key's rows in ``left``.

    Keys with at least 1/HOT_SHARE of the rows (so at most HOT_SHARE of them) are joined by
    broadcast and never shuffled; all others by a shuffle in which no key has more than that
    share.  NULL keys match each other.  ``rows`` is dropped.
    """
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    hot = F.col(rows) * HOT_SHARE >= F.lit(total)
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    heavy, light = F.broadcast(renamed.filter(hot).drop(rows)), renamed.filter(~hot).drop(rows)
    drop = [f"__{k}" for k in keys]
    rest = left.join(heavy, _match(left, heavy, keys), "left_anti")
    return left.join(heavy, _match(left, heavy, keys)).drop(*drop).unionByName(
        rest.join(light, _match(rest, light, keys)).drop(*drop)
    )


def numbered(df: DataFrame, keys: Sequence[Column], name: str) -> DataFrame:
    """``df`` with its rank (from 0) in the total order of ``keys``, without one sort of everything.

    Rows are cut into ranges, ranked within their range, and shifted by the sizes of the
    ranges before; the sizes are one row per partition.
    """
    parts = pin(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(F.col("__part").alias("__of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__shift"))
    ranked = parts.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1)
    return ranked.join(F.broadcast(shifts), F.col("__part") == F.col("__of")).withColumn(
        name, F.col("__rank") + F.col("__shift")
    ).drop("__part", "__of", "__rank", "__shift")


def components(links: DataFrame) -> DataFrame:
    """Smallest vertex reachable from each vertex of ``links`` (a, b): columns v, label.

    Labels take the smallest label among neighbours and then the label of their label, so
    the rounds grow with the logarithm of the longest chain.  Every round is written.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = pin(both.filter("a <> b").distinct())
    labels = pin(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = pin(
            edges.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("seen"))
        )
        lower = pin(labels.join(near, "v").select("v", "label", F.least("label", "seen").alias("now")))
        target = lower.select(F.col("v").alias("now"), F.col("now").alias("jump"))
        moved = pin(lower.join(target, "now").select("v", F.col("jump").alias("to"), (F.col("jump") != F.col("label")).alias("changed")))
        labels = moved.select("v", F.col("to").alias("label"))
        if moved.filter("changed").limit(1).count() == 0:
            return labels
