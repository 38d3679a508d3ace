"""Column naming, coercion, imputation and profiling of client tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import vocab as v
from riskloom.operators.ordered import join_groups, long_form, quantile_columns, quantiles, small_side


def standardize_columns(df: DataFrame, require_target: bool = True) -> DataFrame:
    """Trimmed names with ``_`` for spaces, ``PAY_1`` as ``PAY_0``, the first known target alias as the target."""
    names = [c.strip().replace(" ", "_") for c in df.columns]
    names = ["PAY_0" if n == "PAY_1" and "PAY_0" not in names else n for n in names]
    aliases = [a.replace(" ", "_") for a in v.TARGET_ALIASES]
    target = next((a for a in aliases if a in names), None)
    if target is None and require_target:
        raise ValueError(f"no target column among {v.TARGET_ALIASES}")
    return df.toDF(*[v.TARGET if n == target else n for n in names])


def drop_targets(df: DataFrame, key: bool = False) -> DataFrame:
    """Remove every target alias (and the key if asked) before scoring."""
    return df.drop(*v.TARGET_ALIASES, *([v.KEY] if key else []))


def missing_columns(df: DataFrame, required: Sequence[str] = tuple(v.REQUIRED)) -> list[str]:
    return [c for c in required if c not in df.columns]


def _total_nulls(columns: Sequence[str]) -> Column:
    return sum((F.count_if(F.col(f"`{c}`").isNull()) for c in columns), F.lit(0))


def basic_checks(df: DataFrame, required: Sequence[str] = tuple(v.REQUIRED)) -> DataFrame:
    """Fail on missing columns; else one row of shape and total nulls."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        _total_nulls(df.columns).cast("bigint").alias("total_nulls"),
    )


def raw_inputs(df: DataFrame, keep: Sequence[str] = (v.KEY,)) -> DataFrame:
    """Project the raw columns of batch scoring; fail if some are absent."""
    missing = missing_columns(df, v.RAW_FEATURES)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(*keep, *v.RAW_FEATURES)


def coerce_numbers(
    df: DataFrame, columns: Sequence[str], whole: Sequence[str] = (), on_fraction: str = "error"
) -> DataFrame:
    """Text to numbers, unreadable text to NULL.  A fraction in a ``whole`` column is an error (or NULL)."""
    def read(c: str) -> Column:
        number = F.col(f"`{c}`").try_cast("double")
        number = F.when(~F.isnan(number), number)
        if c not in whole:
            return number
        fault = F.raise_error(F.lit(f"column {c} holds a fraction")).cast("int") if on_fraction == "error" else None
        return F.when(number == F.floor(number), number.cast("int")).when(number.isNotNull(), fault)

    return df.withColumns({c: read(c) for c in columns})


def binarize_target(df: DataFrame, target: str = v.TARGET) -> DataFrame:
    """Target as 0/1 integer, unreadable or absent as 0."""
    return df.withColumn(target, F.coalesce(F.col(target).try_cast("double"), F.lit(0.0)).cast("int"))


def impute_median(df: DataFrame, columns: Sequence[str], method: str = "exact") -> DataFrame:
    """Numeric columns as doubles with NULL replaced by the column median."""
    middle = quantile_columns(df, columns, [0.5], method)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col("quantile")[c][0]) for c in columns}
    return df.crossJoin(F.broadcast(middle)).withColumns(filled).drop("quantile")  # one row


def modes(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value per text column, smallest on ties: rows (by, feature, mode)."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns]
    counts = (
        df.select(*by, F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
        .groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy(*by, "feature").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns with NULL replaced by the most frequent value."""
    common = modes(df, columns).agg(F.map_from_entries(F.collect_list(F.struct("feature", "mode"))).alias("_mode"))
    filled = {c: F.coalesce(F.col(c), F.col("_mode")[c]) for c in columns}
    return df.crossJoin(F.broadcast(common)).withColumns(filled).drop("_mode")  # one row


def clean(df: DataFrame, method: str = "exact") -> DataFrame:
    """Coercion, imputation and target binarisation of a standardised table."""
    columns = [c for c in df.columns if c not in (v.TARGET, v.KEY)]
    whole = [c for c in columns if c in v.WHOLE_NUMBERS]
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)
            and f.name in columns and f.name not in v.RAW_FEATURES]
    numbers = [c for c in columns if c not in text]
    ready = impute_median(coerce_numbers(df, numbers, whole), numbers, method)
    ready = impute_mode(ready, text) if text else ready
    return binarize_target(ready) if v.TARGET in df.columns else ready


def null_counts(df: DataFrame) -> DataFrame:
    """Rows (column, type, nulls), from one aggregation."""
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = [
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                 F.col(f"`{f.name}`").alias("nulls"))
        for f in df.schema
    ]
    return counted.select(F.inline(F.array(*pairs)))


def _normalized(df: DataFrame) -> list[Column]:
    zero = {T.DoubleType(), T.FloatType()}  # so that -0.0 and 0.0 hash alike, as they compare
    return [F.col(f"`{f.name}`") + 0.0 if f.dataType in zero else F.col(f"`{f.name}`") for f in df.schema]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row with the number of rows beyond the first of each set of equal rows.

    Only an 8-byte hash per row is shuffled; rows whose hash repeats are then compared in
    full, so a hash collision cannot change the count.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*_normalized(df)))
    repeated = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    suspects = hashed.join(small_side(repeated), "_hash", "left_semi")
    sets = suspects.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return sets.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"))


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), method: str = "exact") -> DataFrame:
    """Rows (by, feature, count, mean, std, min, q25, q50, q75, max) with n-1 deviation."""
    keys = [*by, "feature"]
    spread = quantiles(df, columns, [0.25, 0.5, 0.75], by, method)
    moments = long_form(df, columns, by).groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    both = join_groups(moments, spread.drop("n"), keys)
    q = {f"q{p}": F.col("q")[i] for i, p in enumerate((25, 50, 75))}
    return both.withColumns(q).select(*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def winsorize(
    df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99, method: str = "exact"
) -> DataFrame:
    """Clip columns to their own low and high quantiles."""
    bounds = quantile_columns(df, columns, [low, high], method)
    clipped = {
        c: F.greatest(F.col("quantile")[c][0], F.least(F.col("quantile")[c][1], F.col(c).cast("double")))
        for c in columns
    }
    clipped = {c: F.when(F.col(c).isNotNull(), x) for c, x in clipped.items()}
    return df.crossJoin(F.broadcast(bounds)).withColumns(clipped).drop("quantile")  # one row


def standard_scale(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Centre and divide by the population deviation; a constant column becomes 0."""
    source = df if fitted_on is None else fitted_on
    moments = source.agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_std_{c}") for c in columns]
    )
    scaled = {
        c: (F.col(c) - F.col(f"_mean_{c}")) / F.when(F.col(f"_std_{c}") > 0, F.col(f"_std_{c}")).otherwise(1.0)
        for c in columns
    }
    used = [f"_{kind}_{c}" for kind in ("mean", "std") for c in columns]
    return df.crossJoin(F.broadcast(moments)).withColumns(scaled).drop(*used)  # one row
