"""Batch summaries, distributions, histograms and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.functions.decisions import ratio
from riskloom.operators.matching import single_row, with_share
from riskloom.operators.ordered import join_groups, long_form, median


def prediction_summary(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The 14 batch figures of a prediction table, per group."""
    p, called, limit = "default_probability", "default_prediction", "suggested_credit_limit_mxn"
    counts = {b: F.count_if(F.col("risk_band") == b) for b in v.BANDS}
    n = F.count(F.lit(1))
    totals = predictions.groupBy(*by).agg(
        n.alias("total_predictions"),
        F.avg(p).alias("avg_default_probability"),
        F.stddev_samp(p).alias("std_default_probability"),
        F.sum(called).alias("total_defaults_predicted"),
        F.avg(F.col(called).cast("double")).alias("default_rate"),
        *[c.alias(f"count_{b.lower()}") for b, c in counts.items()],
        *[(F.try_divide(c, n) * 100).alias(f"pct_{b.lower()}") for b, c in counts.items()],
        F.avg(limit).alias("avg_credit_limit"),
        F.sum(limit).alias("total_credit_exposure"),
    )
    return join_groups(totals, median(predictions, p, by, "median_default_probability"), by, "left" if by else "inner")


def band_distribution(predictions: DataFrame) -> DataFrame:
    """Rows (band, clients, percent) for all three bands in order; absent bands are 0."""
    total = F.count(F.lit(1))
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(b).alias("band"),
            F.count_if(F.col("risk_band") == b).alias("clients"),
            F.round(ratio(F.count_if(F.col("risk_band") == b), total) * 100, 1).alias("percent"),
        )
        for i, b in enumerate(v.BANDS)
    ]
    return predictions.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def review_workload(
    bands: DataFrame, savings: DataFrame, minutes: float = 15.0, hourly_cost: float = 50.0
) -> DataFrame:
    """Hours and cost of manual review, and what is left of the savings."""
    reviewed = bands.where(F.col("band") == "REVISION").agg(F.coalesce(F.sum("clients"), F.lit(0)).alias("reviews"))
    hours = F.col("reviews") * F.lit(minutes) / 60.0
    both = reviewed.crossJoin(F.broadcast(single_row(savings.select("expected_savings"))))  # one row each
    return both.withColumns({"review_hours": hours, "review_cost": hours * hourly_cost}).withColumn(
        "net_savings", F.col("expected_savings") - F.col("review_cost")
    )


def value_shares(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by, value, n, share)."""
    return with_share(df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n")), "n", by)


def category_target_counts(df: DataFrame, columns: Sequence[str], target: str = v.TARGET) -> DataFrame:
    """Rows (column, value, target, n) for several category columns in one pass."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("int").alias("value")) for c in columns]
    return df.select(F.col(target).alias("target"), F.inline(F.array(*pairs))).groupBy("column", "value", "target").agg(
        F.count(F.lit(1)).alias("n")
    )


def segment_rates(df: DataFrame, segments: Sequence[str], label: str = v.TARGET) -> DataFrame:
    """Rows (segment, value, n, share, default_rate), all segments by grouping sets in one pass."""
    total = len(segments)
    grouped = df.groupingSets([[c] for c in segments], *segments).agg(
        F.grouping_id(*segments).alias("_set"), F.count(F.lit(1)).alias("n"),
        F.avg(F.col(label).cast("double")).alias("default_rate"),
    )
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(segments):
        only = F.col("_set") == (2**total - 1) ^ (1 << (total - 1 - i))
        name, value = F.when(only, c).otherwise(name), F.when(only, F.col(c).cast("string")).otherwise(value)
    rows = grouped.select(name.alias("segment"), value.alias("value"), "n", "default_rate")
    return with_share(rows, "n", ["segment"])


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """Rows (feature, bin, low, high, n): equal-width bins from minimum to maximum, last one closed.

    A constant column gets unit width around its value.
    """
    ends = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"_min_{c}") for c in columns],
        *[F.max(F.col(c).cast("double")).alias(f"_max_{c}") for c in columns],
    )
    rows = [
        F.struct(F.lit(c).alias("feature"), F.col(f"_min_{c}").alias("low"), F.col(f"_max_{c}").alias("high"))
        for c in columns
    ]
    flat = F.col("low") == F.col("high")
    spans = ends.select(F.inline(F.array(*rows))).where("low IS NOT NULL").select(
        "feature", F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("start"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("stop"),
    ).withColumn("width", (F.col("stop") - F.col("start")) / bins)
    start, width, value = F.col("start"), F.col("width"), F.col("value")
    guess = F.least(F.floor((value - start) / width), F.lit(bins - 1)).cast("int")
    edge = lambda k: start + k * width
    bin_number = (
        F.when(value < edge(F.col("_guess")), F.col("_guess") - 1)
        .when((F.col("_guess") < bins - 1) & (value >= edge(F.col("_guess") + 1)), F.col("_guess") + 1)
        .otherwise(F.col("_guess"))
    )
    counts = (
        long_form(df, columns).join(F.broadcast(spans), "feature")  # one row per column
        .withColumn("_guess", guess).withColumn("_bin", bin_number)
        .groupBy("feature", "start", "width", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    return (
        counts.select("*", every).groupBy("feature", "start", "width", "bin")
        .agg(F.sum(F.when(F.col("_bin") == F.col("bin"), F.col("_n")).otherwise(0)).alias("n"))
        .select("feature", "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), "n")
    )


def correlations(df: DataFrame, columns: Sequence[str], pairwise: bool = True) -> DataFrame:
    """Rows (left, right, r) of the Pearson matrix, from one aggregate.

    Each pair uses the rows where both are present; without ``pairwise`` a row with any gap
    is left out of all pairs.
    """
    names = list(columns)
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    if not pairwise:
        numbers = numbers.na.drop(subset=names)
    half = {(i, j): F.corr(names[i], names[j]).alias(f"_{i}_{j}") for i in range(len(names)) for j in range(i, len(names))}
    cells = [
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_{min(i, j)}_{max(i, j)}").alias("r"))
        for i, a in enumerate(names) for j, b in enumerate(names)
    ]
    return numbers.agg(*half.values()).select(F.inline(F.array(*cells)))


def target_correlations(df: DataFrame, columns: Sequence[str], target: str = v.TARGET) -> DataFrame:
    """Rows (feature, r, position) by falling absolute correlation with the target."""
    label = F.col(target).cast("double")
    one = df.agg(*[F.corr(F.col(c).cast("double"), label).alias(c) for c in columns])
    pairs = [F.struct((-F.abs(F.col(c))).alias("weight"), F.lit(c).alias("feature"), F.col(c).alias("r")) for c in columns]
    ranked = one.select(F.posexplode(F.array_sort(F.filter(F.array(*pairs), lambda x: x["r"].isNotNull()))))
    return ranked.select("col.feature", "col.r", (F.col("pos") + 1).alias("position"))
