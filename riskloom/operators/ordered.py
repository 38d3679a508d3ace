"""Global order without one big task: running totals and exact order statistics.

Everything that needs a total order (AUC, KS, curves, percentiles, exact splits)
first collapses equal values with a map-side combined ``groupBy`` and then uses
one of the two operators here.  A hot value is therefore one row, and a crowded
value range is divided by quantile cuts, so no task sees more than its share.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.runtime import pin

ONE_TASK_ROWS = 200_000
SHORTEST_RANGE = 16  # ranges this long or longer are fewer than their points, so levels come to an end

# Quantile brackets: the sketch is off by at most 1/ACCURACY of the ranks, and below
# FEW_ROWS every value is kept, so a bracket of +-MARGIN always holds its target.
ACCURACY = 5_000
MARGIN = 1e-3
FEW_ROWS = 4_000


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition in which NULL group values match each other."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


SMALL_TABLE_ROWS = 100_000


def small_side(table: DataFrame) -> DataFrame:
    """``table`` with a broadcast hint, if its counted rows allow one."""
    table = pin(table)
    return F.broadcast(table) if table.count() <= SMALL_TABLE_ROWS else table


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group columns, NULL groups included; without groups ``right`` is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})  # keeps a broadcast hint
    match = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return left.join(renamed, match, how).drop(*[f"__{k}" for k in keys])


def running_totals(
    points: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    carry: Sequence[str] = (),
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Add ``<s>_below`` (sum over smaller ``order`` values) and ``<s>_total`` per group.

    ``points`` holds one row per (group, order value).  ``carry`` columns also get
    ``<c>_prev``, the value on the next smaller row.

    Groups of up to ``one_task_rows`` points (counted, not guessed) are each sorted in one
    task.  Beyond that the points are cut into ranges of (group, order) of about half that
    size, as many as it takes; each range is summed on its own and shifted by the totals of
    the ranges before it.  Those totals are points of the same kind, one per group and range,
    and are summed by the same rule, so neither ranges nor levels have an upper bound.
    """
    by = list(by)
    points = pin(points)
    length = max(one_task_rows, SHORTEST_RANGE)
    if _largest_group(points, by) <= length:
        return _totals_in_groups(points, order, sums, by, carry)

    place = f"{order}_range"  # another name at each level
    ranges = 2 * math.ceil(points.count() / length)
    cut = pin(
        points.repartitionByRange(ranges, *by, order).withColumn(place, F.spark_partition_id().cast("bigint"))
    )
    local = _totals_in_groups(cut, order, sums, [*by, place], carry)
    local = local.drop(*[f"{s}_total" for s in sums])

    per_bucket = cut.groupBy(*by, place).agg(
        *[F.sum(s).alias(f"_{s}") for s in sums],
        *[F.max_by(c, order).alias(f"_{c}_last") for c in carry],
    )
    above = running_totals(
        per_bucket, place, [f"_{s}" for s in sums], by, carry=[f"_{c}_last" for c in carry], one_task_rows=one_task_rows
    ).select(
        *by, place, *[f"_{s}_below" for s in sums], *[F.col(f"_{s}_total").alias(f"{s}_total") for s in sums],
        *[f"_{c}_last_prev" for c in carry],
    )
    joined = join_groups(local, small_side(above), [*by, place])
    shifted = {f"{s}_below": F.col(f"{s}_below") + F.col(f"_{s}_below") for s in sums}
    bridged = {f"{c}_prev": F.coalesce(f"{c}_prev", f"_{c}_last_prev") for c in carry}
    return joined.withColumns({**shifted, **bridged}).drop(
        place, *[f"_{s}_below" for s in sums], *[f"_{c}_last_prev" for c in carry]
    )


def _largest_group(points: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group of a pinned table."""
    size = points.count()
    if not by or size <= SHORTEST_RANGE:
        return size
    return points.groupBy(*by).count().agg(F.max("count")).first()[0]


def _totals_in_groups(points: DataFrame, order: str, sums: Sequence[str], by: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Sums below, totals and previous values, each group sorted in one task."""
    ordered = Window.partitionBy(*by).orderBy(order)
    before, whole = ordered.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    below = {f"{s}_below": F.coalesce(F.sum(s).over(before), F.lit(0)) for s in sums}
    previous = {f"{c}_prev": F.lag(c).over(ordered) for c in carry}
    return points.withColumns({**below, **previous}).withColumns({f"{s}_total": F.sum(s).over(whole) for s in sums})


def _candidates(values: DataFrame, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Collapse (by, spread, key) rows to those that may hold one of the target ranks.

    A quantile sketch gives a narrow bracket around each share.  Rows inside a bracket
    keep their key; all others only count towards the gap they fall into, so about
    0.2 % of the rows per share are shuffled, and the ranks stay exact.
    """
    m = len(shares)
    low = [max(0.0, p - MARGIN) for p in shares]
    high = [min(1.0, p + MARGIN) for p in shares]
    sketch = values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("spread", low + high, ACCURACY).alias("_ends")
    )
    infinity = F.lit(math.inf)
    few = F.col("_n") < FEW_ROWS
    lower = [F.when(few | F.lit(low[i] <= 0), -infinity).otherwise(F.col("_ends")[i]) for i in range(m)]
    upper = [F.when(few | F.lit(high[i] >= 1), infinity).otherwise(F.col("_ends")[m + i]) for i in range(m)]
    brackets = sketch.select(*by, F.array(*lower).alias("_lower"), F.array(*upper).alias("_upper"))
    # one row per column is bounded by the schema; with more groups the rows are counted
    brackets = F.broadcast(brackets) if set(by) <= {"feature"} else small_side(brackets)
    placed = join_groups(values, brackets, by)
    spread = F.col("spread")
    inside = reduce(
        lambda a, b: a | b, [(F.col("_lower")[i] <= spread) & (spread <= F.col("_upper")[i]) for i in range(m)]
    )
    passed = [F.when(F.col("_upper")[i] < spread, F.col("_upper")[i]).otherwise(-infinity) for i in range(m)]
    gap_start = F.greatest(*passed) if m > 1 else passed[0]
    return (
        placed.select(*by, "spread", "key", inside.alias("_inside"), gap_start.alias("_gap_start"))
        .select(
            *by,
            F.when(F.col("_inside"), spread).otherwise(F.col("_gap_start")).alias("spread"),
            (~F.col("_inside")).alias("gap"),
            F.when(F.col("_inside"), F.col("key")).alias("key"),
        )
        .groupBy(*by, "spread", "gap", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("order", F.struct("spread", "gap", "key"))
    )


def keys_at_ranks(values: DataFrame, by: Sequence[str], shares: Sequence[float], ranks) -> DataFrame:
    """Exact keys at given 0-based ranks: one row per group with ``n`` and array ``keys``.

    ``values`` has the group columns, ``key`` (sortable) and ``spread`` (its numeric image).
    ``ranks(n)`` gives the rank columns in terms of the group size; each must lie within
    one row of ``share * n`` for one of the ``shares``.
    """
    ranked = running_totals(
        _candidates(values, by, shares), "order", ["n"], by
    ).withColumn("_rank", F.array(*ranks(F.col("n_total"))))
    count = len(ranks(F.lit(0)))

    def pick(i: int) -> Column:
        rank = F.col("_rank")[i]
        here = (F.col("n_below") <= rank) & (rank < F.col("n_below") + F.col("n"))
        missed = F.raise_error(F.lit("order statistic fell outside its bracket"))
        return F.max(F.when(here & F.col("gap"), missed).when(here, F.col("key")))

    return ranked.groupBy(*by).agg(
        F.max("n_total").alias("n"), F.array(*[pick(i) for i in range(count)]).alias("keys")
    )


def long_form(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows (by, feature, value) of the non-null numbers in ``columns``."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    rows = df.select(*by, F.inline(F.array(*pairs)))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float],
    by: Sequence[str] = (),
    method: str = "exact",
) -> DataFrame:
    """Linear-interpolated quantiles of several columns: rows (by, feature, n, q array).

    ``exact`` reads the data twice and shuffles only bracket rows; ``approx`` reads it
    once and returns observed values within 1/10000 of the asked rank.
    """
    values = long_form(df, columns, by)
    groups = [*by, "feature"]
    if method == "approx":
        return values.groupBy(*groups).agg(
            F.count(F.lit(1)).alias("n"), F.percentile_approx("value", list(shares), 10_000).alias("q")
        )
    if method != "exact":
        raise ValueError(f"unknown quantile method {method!r}")

    def ranks(n: Column) -> list[Column]:
        at = [(n - 1).cast("double") * F.lit(float(p)) for p in shares]
        floors = [F.floor(h) for h in at]
        return floors + [F.least(f + 1, n - 1) for f in floors]

    keyed = values.select(*groups, F.col("value").alias("key"), F.col("value").alias("spread"))
    found = keys_at_ranks(keyed, groups, shares, ranks)
    m = len(shares)

    def between(i: int) -> Column:
        position = (F.col("n") - 1).cast("double") * F.lit(float(shares[i]))
        low, high = F.col("keys")[i], F.col("keys")[i + m]
        return low + (high - low) * (position - F.floor(position))

    return found.select(*groups, "n", F.array(*[between(i) for i in range(m)]).alias("q"))


def quantile_columns(df: DataFrame, columns: Sequence[str], shares: Sequence[float], method="exact") -> DataFrame:
    """One row with a map ``quantile`` from column name to its quantile array."""
    rows = quantiles(df, columns, shares, method=method)
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("feature", "q"))).alias("quantile"))


def median(df: DataFrame, column: str, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    """Exact median per group, as column ``name``."""
    return quantiles(df, [column], [0.5], by).select(*by, F.col("q")[0].alias(name))
