"""Feature derivation from the raw client columns.

The same ratios exist in several flavours that differ only in edge behaviour; each
flavour is a ``FeatureRules`` value, so none is silently merged with another.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import vocab as v


@dataclass(frozen=True)
class FeatureRules:
    limit_must_be_positive: bool = False  # else only a zero limit gives 0
    bill_must_be_positive: bool = False  # else only a zero bill is replaced
    no_bill_ratio: float = 0.0  # pay ratio where the bill does not count
    cap: float | None = None  # clip both ratios to [0, cap]
    nulls_as_zero: bool = False  # raw inputs: NULL counts as 0
    age_dummies: str | None = None  # "bins", "ranges" or None
    other_education: Sequence[int] | None = (0, 5, 6)  # codes joined into 4


# fixed values: the five flavours
VARIANTS = {
    "ingest": FeatureRules(other_education=None),
    "notebook": FeatureRules(cap=5.0, age_dummies="bins"),
    "script": FeatureRules(limit_must_be_positive=True, bill_must_be_positive=True, no_bill_ratio=1.0),
    "online": FeatureRules(
        limit_must_be_positive=True, bill_must_be_positive=True, age_dummies="ranges", other_education=(0, 4, 5, 6)
    ),
    "table": FeatureRules(nulls_as_zero=True, age_dummies="ranges", other_education=(0, 4, 5, 6)),
}


def _number(name: str, rules: FeatureRules) -> Column:
    number = F.col(name).cast("double")
    return F.coalesce(number, F.lit(0.0)) if rules.nulls_as_zero else number


def _clipped(ratio: Column, cap: float | None) -> Column:
    return ratio if cap is None else F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), ratio))


def utilization(rules: FeatureRules, month: int = 1) -> Column:
    """Billed amount over credit limit; 0 where there is no limit."""
    bill, limit = _number(f"BILL_AMT{month}", rules), _number("LIMIT_BAL", rules)
    if rules.limit_must_be_positive:
        return F.when(limit > 0, _clipped(bill / limit, rules.cap)).otherwise(0.0)
    return _clipped(F.coalesce(F.try_divide(bill, limit), F.lit(0.0)), rules.cap)


def payment_ratio(rules: FeatureRules, month: int) -> Column:
    """Paid amount over billed amount, by the flavour's rule for empty bills."""
    paid, bill = _number(f"PAY_AMT{month}", rules), _number(f"BILL_AMT{month}", rules)
    if rules.bill_must_be_positive:
        return F.when(bill > 0, _clipped(paid / bill, rules.cap)).otherwise(rules.no_bill_ratio)
    return _clipped(F.coalesce(F.try_divide(paid, bill), F.lit(rules.no_bill_ratio)), rules.cap)


# fixed values: age groups, right-closed, and their labels
AGE_EDGES = [0, 25, 35, 45, 60, 120]
AGE_LABELS = ["<=25", "26-35", "36-45", "46-60", "60+"]


def age_bucket(age: Column | str = "AGE") -> Column:
    """Age group label, (0,25] (25,35] (35,45] (45,60] (60,120]; NULL outside."""
    years = F.col(age) if isinstance(age, str) else age
    label = F.when(years <= AGE_EDGES[0], F.lit(None).cast("string"))
    for upper, name in zip(AGE_EDGES[1:], AGE_LABELS):
        label = label.when(years <= upper, name)
    return label


def one_hot(value: Column, levels: Sequence[str], prefix: str) -> dict[str, Column]:
    """0/1 columns ``<prefix>_<level>`` for all but the first level; NULL gives all zeros.

    The levels are part of the model, so they are given rather than read from the data.
    """
    return {f"{prefix}_{name}": F.coalesce((value == name).cast("int"), F.lit(0)) for name in levels[1:]}


def age_range_dummies(rules: FeatureRules) -> dict[str, Column]:
    """0/1 columns by inclusive whole-year ranges."""
    years = _number("AGE", rules)
    inside = [years.between(26, 35), years.between(36, 45), years.between(46, 60), years > 60]
    return {name: F.coalesce(test.cast("int"), F.lit(0)) for name, test in zip(v.AGE_DUMMIES, inside)}


def grouped_education(codes: Sequence[int], rules: FeatureRules = VARIANTS["notebook"]) -> Column:
    level = _number("EDUCATION", rules).cast("int")
    return F.when(level.isin(list(codes)), 4).otherwise(level)


def grouped_marriage(rules: FeatureRules = VARIANTS["notebook"]) -> Column:
    status = _number("MARRIAGE", rules).cast("int")
    return F.when(status == 0, 3).otherwise(status)


def with_features(df: DataFrame, variant: str = "notebook") -> DataFrame:
    """Add the derived columns of one flavour in a single projection."""
    rules = VARIANTS[variant]
    if variant == "script":
        new = {f"UTIL_RATIO_{m}": utilization(rules, m) for m in range(1, 7)}
        new |= {f"PAY_RATIO_{m}": payment_ratio(rules, m) for m in range(1, 7)}
        new |= {"EDUCATION_CAT": grouped_education(rules.other_education, rules), "MARRIAGE_CAT": grouped_marriage(rules)}
        return df.withColumns(new)

    new = {"utilization_1": utilization(rules)}
    new |= {f"payment_ratio_{m}": payment_ratio(rules, m) for m in range(1, 7)}
    if rules.other_education is not None:
        new["EDUCATION_grouped"] = grouped_education(rules.other_education, rules)
        new["MARRIAGE_grouped"] = grouped_marriage(rules)
    if rules.age_dummies == "bins":
        new["AGE_bin"] = age_bucket()
        new |= one_hot(age_bucket(), AGE_LABELS, "AGE_bin")
    elif rules.age_dummies == "ranges":
        new |= age_range_dummies(rules)
    return df.withColumns(new)


def align(df: DataFrame, features: Sequence[str] = tuple(v.MODEL_FEATURES), keep: Sequence[str] = ()) -> DataFrame:
    """The model's columns in the model's order; missing ones are 0, others dropped."""
    have = set(df.columns)
    return df.select(*keep, *[F.col(f"`{c}`") if c in have else F.lit(0).alias(c) for c in features])


def with_trend_features(df: DataFrame) -> DataFrame:
    """Six-month trends and interactions.

    Month 6 is the oldest, so the billing slope is taken along 6, 5, ... 1 with
    least-squares weights (t - 3.5) / 17.5.
    """
    slope = sum(F.col(f"BILL_AMT{7 - t}") * F.lit((t - 3.5) / 17.5) for t in range(1, 7))
    ratios = [payment_ratio(VARIANTS["notebook"], m) for m in range(1, 7)]
    delays = [F.col(c) for c in v.DELAYS]
    return df.withColumns(
        {
            "billing_slope": slope,
            "avg_payment_ratio": sum(ratios[1:], ratios[0]) / F.lit(6.0),
            "avg_delay": sum(delays[1:], delays[0]).cast("double") / F.lit(6.0),
            "delay_change": F.col("PAY_0") - F.col("PAY_6"),
            "delay_x_utilization": F.col("PAY_0") * utilization(VARIANTS["notebook"]),
            "age_x_limit": F.col("AGE") * F.col("LIMIT_BAL"),
        }
    )
