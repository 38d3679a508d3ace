"""Shapley attributions of a scoring model against a small background, as a Spark job."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.operators.matching import single_row
from riskloom.operators.ordered import small_side

# fixed values: sizes of the explained sample and of the background
SAMPLE_ROWS = 100
BACKGROUND_ROWS = 50


def hash_sample(df: DataFrame, n: int, key: str = v.KEY, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash of the key: a sample that does not depend on partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def shapley(
    rows: DataFrame, background: DataFrame, features: Sequence[str], score: Callable[[DataFrame], DataFrame],
    orders: int = 4, key: str = v.KEY, seed: int = 42,
) -> DataFrame:
    """Rows (key, feature, attribution) by sampled feature orders.

    A feature order walks from a background row to the explained row one feature at a time;
    the score change at a feature's step is its contribution.  The walks are rows, the model
    scores them all in one pass, and the contributions are averaged per row and feature: a state
    counts for the feature that led to it and against the next one, so walks need no order and
    are summed where they are made.  ``rows`` may be a whole table with one row per key; the
    background is small.  ``score`` adds a ``score`` column.
    """
    names = list(features)
    m = len(names)
    target = rows.select(F.col(key), F.array(*[F.col(f).cast("double") for f in names]).alias("_x"))
    base = background.select(
        F.col(key).alias("_b"), F.array(*[F.col(f).cast("double") for f in names]).alias("_y")
    )
    turns = F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("_order")
    # a few rows make many states, so rows are dealt out by key first
    dealt = target.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    walks = dealt.crossJoin(small_side(base)).select("*", turns)

    def place(i: int):
        return F.struct(F.xxhash64(F.col(key), F.col("_b"), F.col("_order"), F.lit(i), F.lit(seed)).alias("h"), F.lit(i).alias("i"))

    order = F.transform(F.array_sort(F.array(*[place(i) for i in range(m)])), lambda e: e["i"])
    steps = walks.withColumn("_turn", order).select("*", F.explode(F.sequence(F.lit(0), F.lit(m))).alias("_step"))
    switched = F.slice("_turn", F.lit(1), F.col("_step"))
    mixed = [
        F.when(F.array_contains(switched, i), F.col("_x")[i]).otherwise(F.col("_y")[i]).alias(f)
        for i, f in enumerate(names)
    ]
    changed = F.when(F.col("_step") > 0, F.element_at("_turn", F.greatest(F.col("_step"), F.lit(1))))
    coming = F.when(F.col("_step") < m, F.element_at("_turn", F.least(F.col("_step") + 1, F.lit(m))))
    states = steps.select(key, changed.alias("_changed"), coming.alias("_coming"), *mixed)
    sides = F.array(
        F.struct(F.col("_changed").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("_coming").alias("at"), F.lit(-1).alias("sign"))
    )
    gains = score(states).select(key, "score", F.explode(sides).alias("_side")).where(F.col("_side.at").isNotNull())
    label = F.element_at(F.array(*[F.lit(f) for f in names]), F.col("_side.at") + 1)
    mean = F.sum(F.col("_side.sign") * F.col("score")) / F.count_if(F.col("_side.sign") > 0)
    return gains.groupBy(key, label.alias("feature")).agg(mean.alias("attribution"))


def linear_shapley(rows: DataFrame, background: DataFrame, weights: Mapping[str, float], key: str = v.KEY) -> DataFrame:
    """Rows (key, feature, attribution) of a score that is linear in its features, e.g. log-odds.

    Every feature order gives a feature the same gain there, its weight times the distance from
    the background's mean, so this is what ``shapley`` tends to with all orders, without a scored
    state.  The attributions of a row add up to its score less the background's mean score.  A
    NULL value has a NULL attribution; so has everything against an empty background.
    """
    names = list(weights)
    means = single_row(background.agg(*[F.avg(F.col(f"`{f}`").cast("double")).alias(f"_mean_{i}") for i, f in enumerate(names)]))
    gains = [
        F.struct(F.lit(f).alias("feature"), (F.lit(float(weights[f])) * (F.col(f"`{f}`").cast("double") - F.col(f"_mean_{i}"))).alias("attribution"))
        for i, f in enumerate(names)
    ]
    return rows.crossJoin(F.broadcast(means)).select(key, F.inline(F.array(*gains)))


def attribution_ranking(attributions: DataFrame) -> DataFrame:
    """Rows (feature, mean_abs) by falling mean absolute attribution."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs")).orderBy(
        F.desc("mean_abs"), "feature"
    )


def top_attributions(attributions: DataFrame, k: int = 5, key: str = v.KEY) -> DataFrame:
    """The k strongest features of each row, for audit."""
    strongest = Window.partitionBy(key).orderBy(F.desc(F.abs("attribution")), "feature")
    return attributions.withColumn("position", F.row_number().over(strongest)).where(F.col("position") <= k)
