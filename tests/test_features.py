import json
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.functions import decisions, features, texts


def client(spark, **changes):
    row = {c: 0.0 for c in v.RAW_FEATURES} | {"ID": 1, "LIMIT_BAL": 100.0, "AGE": 30, "SEX": 1, "EDUCATION": 2, "MARRIAGE": 1}
    row |= changes
    schema = ", ".join(f"{c} {'bigint' if c == 'ID' else 'double'}" for c in row)
    return spark.createDataFrame([tuple(None if x is None else (x if c == "ID" else float(x)) for c, x in row.items())], schema)


CASES = [
    # zero limit
    *[(x, "utilization_1", {"LIMIT_BAL": 0, "BILL_AMT1": 50}, 0.0) for x in ("ingest", "notebook", "online", "table")],
    ("script", "UTIL_RATIO_1", {"LIMIT_BAL": 0, "BILL_AMT1": 50}, 0.0),
    # negative bill over limit
    *[(x, "utilization_1", {"BILL_AMT1": -50}, -0.5) for x in ("ingest", "online", "table")],
    ("script", "UTIL_RATIO_3", {"BILL_AMT3": -50}, -0.5),
    ("notebook", "utilization_1", {"BILL_AMT1": -50}, 0.0),
    ("notebook", "utilization_1", {"BILL_AMT1": 900}, 5.0),
    # pay ratio, bill 0
    *[(x, "payment_ratio_2", {"PAY_AMT2": 10}, 0.0) for x in ("ingest", "notebook", "online", "table")],
    ("script", "PAY_RATIO_2", {"PAY_AMT2": 10}, 1.0),
    # pay ratio, bill < 0
    *[(x, "payment_ratio_2", {"PAY_AMT2": 10, "BILL_AMT2": -20}, -0.5) for x in ("ingest", "table")],
    ("notebook", "payment_ratio_2", {"PAY_AMT2": 10, "BILL_AMT2": -20}, 0.0),
    ("online", "payment_ratio_2", {"PAY_AMT2": 10, "BILL_AMT2": -20}, 0.0),
    ("script", "PAY_RATIO_2", {"PAY_AMT2": 10, "BILL_AMT2": -20}, 1.0),
    # upper bound
    ("notebook", "payment_ratio_1", {"PAY_AMT1": 100, "BILL_AMT1": 10}, 5.0),
    ("online", "payment_ratio_1", {"PAY_AMT1": 100, "BILL_AMT1": 10}, 10.0),
    # nulls
    ("table", "utilization_1", {"BILL_AMT1": None}, 0.0),
    ("script", "UTIL_RATIO_1", {"LIMIT_BAL": None, "BILL_AMT1": 5}, 0.0),
    ("script", "PAY_RATIO_1", {"BILL_AMT1": None, "PAY_AMT1": 5}, 1.0),
    # regrouping
    *[("notebook", "EDUCATION_grouped", {"EDUCATION": e}, 4) for e in (0, 4, 5, 6)],
    *[("online", "EDUCATION_grouped", {"EDUCATION": e}, 4) for e in (0, 4, 5, 6)],
    ("online", "EDUCATION_grouped", {"EDUCATION": 3}, 3),
    ("script", "MARRIAGE_CAT", {"MARRIAGE": 0}, 3),
    # ages at the borders
    *[("online", "AGE_bin_26-35", {"AGE": a}, x) for a, x in ((22, 0), (26, 1), (30, 1), (35, 1), (36, 0))],
    *[("online", "AGE_bin_60+", {"AGE": a}, x) for a, x in ((60, 0), (65, 1), (130, 1))],
    *[("notebook", "AGE_bin_60+", {"AGE": a}, x) for a, x in ((60, 0), (61, 1), (120, 1), (121, 0))],
    *[("notebook", "AGE_bin", {"AGE": a}, x) for a, x in ((0, None), (1, "<=25"), (25, "<=25"), (45, "36-45"), (121, None))],
]


@pytest.mark.parametrize("variant", list(features.VARIANTS))
def test_variants_keep_their_edges(spark, variant):
    cases = [(i, *case[1:]) for i, case in enumerate(CASES) if case[0] == variant]
    rows = reduce(DataFrame.unionByName, [client(spark, **{"ID": i, **changes}) for i, _, changes, _ in cases])
    made = {r["ID"]: r for r in features.with_features(rows, variant).collect()}
    for i, column, changes, expected in cases:
        assert made[i][column] == expected, (column, changes)


def test_aligned_table_has_the_model_columns(spark):
    made = features.align(features.with_features(client(spark), "notebook"), keep=["ID"])
    assert made.columns == ["ID", *v.MODEL_FEATURES] and len(v.MODEL_FEATURES) == 36


@pytest.mark.parametrize("p,band", [(0.0, "APROBADO"), (0.1999, "APROBADO"), (0.20, "REVISION"), (0.4999, "REVISION"), (0.50, "RECHAZO"), (1.0, "RECHAZO")])
def test_band_borders(spark, p, band):
    assert spark.range(1).select(decisions.risk_band(F.lit(p))).first()[0] == band


@pytest.mark.parametrize("p,limit", [(0.10, 45000.0), (0.20, 30000.0), (0.35, 25000.0), (0.50, 0.0)])
def test_limits(spark, p, limit):
    assert spark.range(1).select(decisions.credit_limit(F.lit(p))).first()[0] == pytest.approx(limit)


def test_flatten(spark):
    df = spark.sql("SELECT named_struct('a', 1, 'b', named_struct('c', date'2024-01-01', 'd', true)) AS x, 'k' AS y")
    row = texts.flatten(df).first().asDict()
    assert row == {"x_a": 1, "x_b_c": "2024-01-01", "x_b_d": True, "y": "k"}


def test_goal_percent(spark):
    rows = spark.createDataFrame([("auc_roc", 0.78), ("ks", 0.42), ("recall", 0.87), ("precision", 0.31), ("brier", 0.13)], "metric string, value double")
    row = decisions.goals_met(decisions.check_goals(rows)).first()
    assert (row["met"], row["goals"], row["percent"]) == (4, 5, 80.0)


def test_body_without_maps(spark):
    body = spark.range(1).select(texts.alert_body(
        F.lit("T"), F.lit("m"), F.lit("info"), F.lit("now"), F.create_map().cast("map<string,string>"), F.lit(None).cast("map<string,string>")
    )).first()[0]
    assert body.endswith("**Severity:** INFO\n") and json.dumps(body)
