"""Top rows, rankings and stacked comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordered import join_groups, quantiles, running_totals


def by_score(df: DataFrame, score: str = "score", key: str = "ID") -> DataFrame:
    """All rows by falling score: a range-partitioned sort."""
    return df.orderBy(F.desc(score), F.asc(key))


def top_rows(df: DataFrame, column: str, k: int, tie: str) -> DataFrame:
    """The k rows with the largest value, by name on ties."""
    return df.orderBy(F.desc(column), F.asc(tie)).limit(k)


def preview(df: DataFrame, n: int = 20, order: Sequence[str] = ("ID",)) -> DataFrame:
    """The first n rows of a total order."""
    return df.orderBy(*order).limit(n)


def best_run(runs: DataFrame, metric: str = "auc_roc", ascending: bool = False) -> DataFrame:
    """Per experiment the run with the best value of a metric map entry, the earlier run on ties."""
    value = F.try_element_at("metrics", F.lit(metric))
    known = runs.withColumn("_value", value).where(F.col("_value").isNotNull())
    signed = F.col("_value") if ascending else -F.col("_value")
    return known.groupBy("experiment").agg(
        F.min_by("run_id", F.struct(signed.alias("v"), F.col("run_id"))).alias("run_id"),
        (F.min("_value") if ascending else F.max("_value")).alias("value"),
    )


# fixed values: ranking metrics, most important first
RANKING_METRICS = ["auc_roc", "ks_statistic", "expected_savings"]


def rank_models(models: DataFrame, metrics: Sequence[str] = tuple(RANKING_METRICS)) -> DataFrame:
    """Models with their rank by several metrics in turn; equal rows share a rank."""
    key = F.struct(*[(-F.col(m)).alias(m) for m in metrics])
    keyed = models.withColumn("_key", key)
    points = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    places = running_totals(points, "_key", ["_n"])
    ranks = places.select("_key", (F.col("_n_below") + 1).cast("int").alias("rank"))
    return join_groups(keyed, ranks, ["_key"]).drop("_key")


def compare_models(tables: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Metric rows of several models stacked, with the chosen columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).select(*columns)


def lowest(df: DataFrame, column: str, tie: str) -> DataFrame:
    """The row with the least value (e.g. the calibration with the lowest Brier score)."""
    return df.agg(F.min_by(F.struct(*df.columns), F.struct(column, tie)).alias("_row")).select("_row.*")


# fixed values: names of the quarter groups
QUARTERS = ["Q1 (Jóvenes)", "Q2", "Q3", "Q4 (Mayores)"]


def has_many_values(df: DataFrame, column: str, most: int) -> bool:
    """Whether a column has more than ``most`` distinct values.

    More than ``most`` distinct hash residues prove it at the cost of a bounded set per task.
    Only otherwise, when hardly any values exist, are they counted themselves.
    """
    known = df.select(F.col(column).alias("_v")).where(F.col("_v").isNotNull())
    residues = known.agg(F.size(F.collect_set(F.pmod(F.xxhash64("_v"), F.lit(4096))))).first()[0]
    return residues > most or known.distinct().count() > most


def with_value_groups(
    df: DataFrame, column: str, name: str = "group", most_values: int = 10, labels: Sequence[str] = tuple(QUARTERS)
) -> DataFrame:
    """Quartile groups of a column with many values, else one group per value.

    Quartiles are right-closed and take the minimum into the first group, so equal values
    never part.
    """
    if not has_many_values(df, column, most_values):
        return df.withColumn(name, F.concat(F.lit("Grupo "), F.col(column).cast("string")))
    edges = quantiles(df, [column], [0.25, 0.5, 0.75]).select("q")
    value = F.col(column).cast("double")
    quarter = F.when(value <= F.col("q")[0], labels[0])
    quarter = quarter.when(value <= F.col("q")[1], labels[1]).when(value <= F.col("q")[2], labels[2])
    quarter = quarter.when(value.isNotNull(), labels[3])
    return df.crossJoin(F.broadcast(edges)).withColumn(name, quarter).drop("q")  # one row
