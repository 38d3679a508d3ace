"""Reliability tables and calibration error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.operators.ordered import join_groups, quantiles


def equal_edges(bins: int = 10) -> list[float]:
    """Interior edges of equal-width bins on [0, 1]."""
    return [i * (1.0 / bins) for i in range(1, bins)]


def edges_below(value: Column, edges: Sequence[float] | Column, inclusive: bool, count: int | None = None) -> Column:
    """How many edges lie below ``value`` (or at it, if inclusive): the bin number.

    ``edges`` is a list or an array column of ``count`` entries; either way the result is a
    sum of plain comparisons, which compiles.
    """
    each = [edges[i] for i in range(count)] if isinstance(edges, Column) else list(edges)
    tests = [(value >= e) if inclusive else (value > e) for e in each]
    return sum((t.cast("int") for t in tests), F.lit(0))


def _reliability(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_score").alias("mean_score"),
        F.avg(F.col("_label").cast("double")).alias("positive_share"),
    )


def _scored(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.select(*by, F.col(score).cast("double").alias("_score"), F.col(label).alias("_label"))


def reliability(
    df: DataFrame, bins: int = 10, score: str = "score", label: str = v.TARGET, by: Sequence[str] = ()
) -> DataFrame:
    """Rows (by, bin, n, mean_score, positive_share) of the non-empty right-closed equal-width bins."""
    rows = _scored(df, score, label, by)
    return _reliability(rows.withColumn("bin", edges_below(F.col("_score"), equal_edges(bins), False)), by)


def quantile_reliability(df: DataFrame, bins: int = 10, score: str = "score", label: str = v.TARGET) -> DataFrame:
    """The same over bins between score quantiles."""
    shares = [i / bins for i in range(1, bins)]
    edges = quantiles(df.where(F.col(label).isNotNull()), [score], shares).select("q")
    rows = _scored(df, score, label, ()).crossJoin(F.broadcast(edges))  # one row
    return _reliability(rows.withColumn("bin", edges_below(F.col("_score"), F.col("q"), False, bins - 1)), ())


def calibration_error(
    df: DataFrame, bins: int = 10, score: str = "score", label: str = v.TARGET, by: Sequence[str] = (),
    compat: bool = False,
) -> DataFrame:
    """Expected calibration error per group.

    Each bin is weighted by its own rows.  ``compat`` pairs the k-th non-empty bin with the
    k-th bin of a left-closed histogram instead, as older reports did, which misplaces the
    weights once a bin is empty.
    """
    if not compat:
        table = reliability(df, bins, score, label, by)
        off = F.abs(F.col("positive_share") - F.col("mean_score")) * F.col("n")
        return table.groupBy(*by).agg((F.sum(off) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))

    edges = equal_edges(bins)
    rows = _scored(df, score, label, by).withColumns(
        {"bin": edges_below(F.col("_score"), edges, False), "_left": edges_below(F.col("_score"), edges, True)}
    )
    cells = rows.groupBy(*by, "bin", "_left").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_score").alias("_scores"), F.sum("_label").alias("_positives")
    )
    # at most bins x 2 cells per group from here on
    sums = cells.groupBy(*by, "bin").agg(
        F.sum("n").alias("_rows"), F.sum("_scores").alias("_scores"), F.sum("_positives").alias("_positives")
    )
    histogram = cells.groupBy(*by).agg(
        F.sum("n").alias("_all"),
        F.array(*[F.sum(F.when(F.col("_left") == b, F.col("n")).otherwise(0)) for b in range(bins)]).alias("_histogram"),
    )
    place = F.row_number().over(Window.partitionBy(*by).orderBy("bin"))
    ranked = sums.withColumn("_place", place)
    off = F.abs((F.col("_positives") - F.col("_scores")) / F.col("_rows"))
    weighted = F.element_at("_histogram", F.col("_place")) / F.col("_all") * off
    return join_groups(ranked, histogram, by).groupBy(*by).agg(
        F.sum(weighted).alias("ece"), F.max("_all").alias("n")
    )
