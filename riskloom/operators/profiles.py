"""A reference profile that is stored, so that monitoring reads production only.

Two forms, both one row per feature: the exact one keeps deciles and bin counts of one reference
table; the mergeable one keeps a quantile sketch per feature and period, so that days are added
and old ones dropped without reading the reference again.  ``index_from_profile`` compares a
production table with either.  Sketches of size ``k`` place a value within about 2.3 / k**0.9 of its
rank (0.13 % for 4096; exact up to k values), with 99 % confidence.

NULL and NaN values are left out, as in ``drift``; a feature without values has no row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.operators import drift
from riskloom.operators.calibration import edges_below
from riskloom.runtime import pin

SKETCH = 4096


def _number(column: str) -> Column:
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


def sketch_profile(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), k: int = SKETCH) -> DataFrame:
    """Rows (by, feature, n, sketch): all columns of all periods in one scan, with partial aggregation."""
    wide = [x for i, f in enumerate(features) for x in (F.count(_number(f)).alias(f"_n{i}"), F.kll_sketch_agg_double(_number(f), k).alias(f"_s{i}"))]
    rows = df.groupBy(*by).agg(*wide)
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f"_n{i}").alias("n"), F.col(f"_s{i}").alias("sketch")) for i, f in enumerate(features)]
    return rows.select(*by, F.inline(F.array(*cells))).where("n > 0")


def save_profile(profile: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Write a profile; with ``by`` a period that is written again replaces itself, others stay."""
    writer = profile.write.mode("overwrite")
    (writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic") if by else writer).parquet(path)


def load_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(profile: DataFrame, by: Sequence[str] = (), k: int = SKETCH) -> DataFrame:
    """Rows (by, feature, n, sketch): the sketches of several periods as one."""
    return profile.groupBy(*by, "feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def binned(sketches: DataFrame, bins: int = 10) -> DataFrame:
    """Rows (feature, n, edges, expected) of a sketch profile: interior quantiles, and values per left-closed bin."""
    edges = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(i / bins)) for i in range(1, bins)])
    placed = pin(sketches.withColumn("edges", edges))

    def expected(points: Sequence[float]) -> Column:
        # a rank counts values up to and with a point; those below an edge are the ones up to the number before it
        below = [F.kll_sketch_get_rank_double("sketch", F.lit(math.nextafter(e, -math.inf))) for e in points]
        shares = zip([F.lit(0.0), *below], [*below, F.lit(1.0)])
        return F.array(*[(high - low) * F.col("n") for low, high in shares])

    # a rank is asked at a literal, so the edges of each feature travel inside the plan
    each = [F.when(F.col("feature") == r["feature"], expected(r["edges"])) for r in placed.select("feature", "edges").collect()]
    held = F.coalesce(*each) if each else F.array().cast("array<double>")
    return placed.select("feature", "n", "edges", held.alias("expected"))


def exact_profile(reference: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """Rows (feature, n, edges, expected) from exact quantiles and counts of one reference table."""
    edges = drift.bin_edges(reference, features, bins)
    counts = drift.bin_counts(reference, reference.limit(0), features, bins)
    held = counts.groupBy("feature").agg(
        F.sum("expected").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("bin", "expected"))), lambda c: c["expected"].cast("double")).alias("expected")
    )
    return held.join(F.broadcast(edges), "feature").select("feature", "n", "edges", "expected")  # a row per feature


def index_from_profile(
    profile: DataFrame, production: DataFrame, features: Sequence[str] | None = None, eps: float = v.PSI_EPSILON
) -> DataFrame:
    """Rows (feature, psi, n_expected, n_actual) of production against a binned profile, in one scan of production.

    The profile has one row per feature, so its edges travel inside the plan.  Features that either side lacks are
    skipped.
    """
    asked = production.columns if features is None else features
    known = {r["feature"]: r for r in profile.where(F.col("feature").isin(list(asked))).select("feature", "edges").collect()}
    present = [f for f in asked if f in known and f in production.columns]
    cells = [F.struct(F.lit(f).alias("feature"), edges_below(_number(f), list(known[f]["edges"]), True).alias("bin"), _number(f).isNotNull().alias("some")) for f in present]
    spine = profile.where(F.col("feature").isin(present)).select("feature", F.posexplode("expected").alias("bin", "expected"))
    if not cells:
        return drift.index_of_counts(spine.withColumn("actual", F.lit(0)), eps=eps)
    actual = production.select(F.inline(F.array(*cells))).where("some").groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("actual"))
    counts = spine.join(F.broadcast(actual), ["feature", "bin"], "left").fillna(0, ["actual"])  # bins rows a feature
    rows = drift.index_of_counts(counts, eps=eps)
    return rows.withColumn("n_expected", F.round("n_expected").cast("bigint"))
