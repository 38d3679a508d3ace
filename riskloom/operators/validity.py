"""Row-level rules, batch gates and quality scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.operators.cleaning import duplicate_rows
from riskloom.operators.ordered import join_groups


def range_faults(rules: Sequence[tuple] = tuple(v.VALID_RANGES)) -> Column:
    """Array of reasons why a row is invalid: absent values and values out of bounds."""
    faults = []
    for column, low, high in rules:
        value = F.col(column)
        faults.append(F.when(value.isNull(), f"{column} missing"))
        if low is not None:
            faults.append(F.when(value < low, f"{column} below {low}"))
        if high is not None:
            faults.append(F.when(value > high, f"{column} above {high}"))
    return F.array_compact(F.array(*faults))


def is_valid(rules: Sequence[tuple] = tuple(v.VALID_RANGES)) -> Column:
    """Whether a row breaks no rule: one plain predicate, which filters and counts can use cheaply."""
    tests = []
    for column, low, high in rules:
        tests.append(F.col(column).isNotNull())
        tests += [F.col(column) >= low] if low is not None else []
        tests += [F.col(column) <= high] if high is not None else []
    return reduce(lambda a, b: a & b, tests)


def accepted(df: DataFrame) -> DataFrame:
    return df.where(is_valid())


def rejected(df: DataFrame) -> DataFrame:
    """Invalid rows with the reasons in ``faults``."""
    return df.where(~is_valid()).withColumn("faults", range_faults())


def gate_batches(df: DataFrame, batch: str = "batch_id", limit: int = 100) -> DataFrame:
    """Per batch: size, invalid rows, and whether the whole batch is taken."""
    return (
        df.groupBy(batch)
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(~is_valid()).alias("invalid_rows"))
        .withColumn("accepted", (F.col("invalid_rows") == 0) & (F.col("rows") <= limit))
    )


def rows_of_accepted_batches(df: DataFrame, batch: str = "batch_id", limit: int = 100) -> DataFrame:
    """Keep the rows of batches that pass as a whole."""
    return df.join(gate_batches(df, batch, limit).where("accepted").select(batch), batch, "left_semi")


# fixed values: documented expectations (name, test)
EXPECTATIONS = [
    ("LIMIT_BAL between 10000 and 1000000", "LIMIT_BAL BETWEEN 10000 AND 1000000"),
    ("SEX in {1, 2}", "SEX IN (1, 2)"),
    ("default_flag not null", "default_flag IS NOT NULL"),
]


def check_expectations(df: DataFrame, rules: Sequence[tuple[str, str]] = tuple(EXPECTATIONS)) -> DataFrame:
    """Rows (expectation, rows, passed, pass_rate, success), all rules in one scan; NULL fails."""
    passed = [F.count_if(F.coalesce(F.expr(test), F.lit(False))).alias(f"_{i}") for i, (_, test) in enumerate(rules)]
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *passed)
    entries = [F.struct(F.lit(name).alias("expectation"), F.col(f"_{i}").alias("passed")) for i, (name, _) in enumerate(rules)]
    return counted.select("rows", F.inline(F.array(*entries))).select(
        "expectation", "rows", "passed",
        F.coalesce(F.try_divide("passed", "rows"), F.lit(1.0)).alias("pass_rate"),
        (F.col("passed") == F.col("rows")).alias("success"),
    )


# fixed values: documented category codes
DOCUMENTED_CODES = {"SEX": [1, 2], "EDUCATION": [1, 2, 3, 4], "MARRIAGE": [1, 2, 3]}


def quality_scores(df: DataFrame) -> DataFrame:
    """One row: completeness, validity, consistency and uniqueness, each in 0..1."""
    cells = F.count(F.lit(1)) * len(df.columns)
    empty = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
    documented = sum(
        (F.count_if(F.col(c).isin(codes)) for c, codes in DOCUMENTED_CODES.items()), F.lit(0)
    )
    rows = F.count(F.lit(1))
    scores = df.agg(
        rows.alias("rows"),
        F.try_divide(cells - empty, cells).alias("completeness"),
        F.try_divide(F.count_if(is_valid()), rows).alias("validity"),
        F.try_divide(documented, rows * len(DOCUMENTED_CODES)).alias("consistency"),
    )
    unique = join_groups(scores, duplicate_rows(df), [])
    return unique.withColumn(
        "uniqueness", F.try_divide(F.col("rows") - F.col("duplicate_rows"), F.col("rows"))
    ).drop("duplicate_rows")
