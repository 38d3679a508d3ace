"""A sample of the registered queries against their SQL, and the shape of the registry."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SAMPLE = [
    "read_client_csv", "impute_median", "rejected_rows", "describe_order_lines", "features_notebook", "prediction_summary",
    "order_line_metrics", "threshold_comparison", "reliability_quantile", "histograms_30", "csi_order_lines", "score_monitoring",
    "stratified_split_sizes", "fairness_by_age", "suppressed_repeats", "escalations", "stream_error_rates",
    "stream_psi_per_day", "stream_proxies_per_day", "stream_error_rates_sliding", "stream_suppress_since_kept", "stream_rate_limit",
    "stream_escalations", "alert_log", "training_alerts", "performance_alerts",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def cell(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else (x + 0.0 if isinstance(x, float) else x)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, db, name):
    df = contract.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((str([cell(r[c]) for c in columns]) for r in df.collect()))
    answer = db.execute(contract.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(str([cell(r[i]) for i in order]) for r in answer.fetchall())


def test_registry_is_consistent(spark):
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150 and len(sql) > 130


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert sorted(r["period"] for r in rows) == [0, 1] and sum(r["total_predictions"] for r in rows) == 150
