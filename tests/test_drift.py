import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskloom.operators import drift
from riskloom.plans.monitoring import drift_report


def column(spark, values, name="score"):
    return spark.createDataFrame([(float(x),) for x in values], f"{name} double")


def numpy_psi(expected, actual, eps=1e-4):
    edges = np.quantile(expected, [i / 10 for i in range(1, 10)])
    e = np.bincount(np.searchsorted(edges, expected, "right"), minlength=10)
    a = np.bincount(np.searchsorted(edges, actual, "right"), minlength=10)
    e, a = (e + eps) / len(expected), (a + eps) / len(actual)
    return float(((a - e) * np.log(a / e)).sum())


@pytest.mark.parametrize("shift,low,high", [(0, 0, 0.15), (3, 0.25, 100)])
def test_psi_of_normals(spark, shift, low, high):
    draw = np.random.default_rng(42)
    a, b = draw.normal(0, 1, 1000), draw.normal(shift, 1, 1000)
    got = drift.psi(column(spark, a), column(spark, b)).first()["psi"]
    assert low <= got < high and got == pytest.approx(numpy_psi(a, b), rel=1e-9)


def test_psi_of_itself_is_zero(spark):
    x = column(spark, np.random.default_rng(3).random(500))
    assert drift.psi(x, x).first()["psi"] == 0


def test_repeated_edges_keep_their_empty_bins(spark):
    a, b = [0.0] * 80 + list(range(1, 21)), [0.0] * 30 + list(range(1, 61))
    got = drift.psi(column(spark, a), column(spark, b)).first()["psi"]
    assert got == pytest.approx(numpy_psi(np.array(a, float), np.array(b, float)), rel=1e-9)
    assert drift.bin_counts(column(spark, a), column(spark, b), ["score"]).count() == 10


def test_psi_with_more_rows_than_the_sketch_keeps(spark):
    draw = np.random.default_rng(9)
    a, b = draw.gamma(2, size=12000), draw.gamma(2.2, size=9000)
    assert drift.psi(column(spark, a), column(spark, b)).first()["psi"] == pytest.approx(numpy_psi(a, b), rel=1e-9)


def test_csi_covers_features_in_one_table(spark, caplog):
    draw = np.random.default_rng(1)
    frame = lambda shift: spark.createDataFrame(
        [(float(x), float(y), float(z)) for x, y, z in zip(draw.normal(size=1000), draw.normal(shift, 1, 1000), draw.poisson(5, 1000))],
        "feature1 double, feature2 double, feature3 double")
    reference, current = frame(0), frame(2).withColumn("extra", F.lit(1.0))
    rows = {r["feature"]: r["csi"] for r in drift.csi(reference, current, ["feature1", "feature2", "feature3", "extra", "gone"]).collect()}
    assert set(rows) == {"feature1", "feature2", "feature3", "extra"} and rows["extra"] == 0.0
    assert rows["feature1"] < 0.1 and rows["feature3"] < 0.1 and rows["feature2"] > 0.25
    assert "extra" in caplog.text
    report = drift.feature_report(drift.csi(reference, current, ["feature1", "feature2"]))
    assert drift.drifted_features(report).first()["drifted_features"] == ["feature2"]


def test_two_sample_ks(spark):
    assert drift.two_sample_ks(column(spark, [1, 2, 3]), column(spark, [4, 5, 6])).first()["ks"] == 1
    a, b = np.random.default_rng(2).random(400), np.random.default_rng(4).random(300) ** 2
    grid = np.concatenate([a, b])
    expected = max(abs((a <= x).mean() - (b <= x).mean()) for x in grid)
    for limit in (200_000, 50):  # one sort, and cut into buckets
        got = drift.two_sample_ks(column(spark, a), column(spark, b), one_task_rows=limit).first()["ks"]
        assert got == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize("value,status", [(0.0999, "OK"), (0.10, "WARNING"), (0.2499, "WARNING"), (0.25, "CRITICAL")])
def test_psi_cuts(spark, value, status):
    from riskloom.functions.decisions import psi_status

    assert spark.range(1).select(psi_status(F.lit(value))).first()[0] == status


def test_monitor_without_and_with_labels(spark, scored):
    production = scored.where("ID % 2 = 0")
    row = drift.monitor_scores(scored, production).first()
    assert row["n_samples"] == 300 and row["ks_status"] is None and row["alerts"] == []
    labelled = drift.monitor_scores(scored, production, label="default_flag").first()
    assert labelled["baseline"] > 0 and labelled["ks_status"] in ("OK", "ALERT")
    compat = drift.monitor_scores(scored, production, label="default_flag", compat=True).first()
    assert compat["baseline"] == 1.0 and compat["ks_status"] == "ALERT"
    assert compat["alerts"][-1].startswith("KS decay significativo (")


@pytest.mark.parametrize("psi,ks,drifted,status", [
    ("CRITICAL", None, 0, "CRITICAL"), ("OK", "ALERT", 0, "CRITICAL"), ("WARNING", "OK", 0, "WARNING"),
    ("OK", "OK", 4, "WARNING"), ("OK", "OK", 3, "HEALTHY"), ("OK", None, 0, "HEALTHY"),
])
def test_overall_status(spark, psi, ks, drifted, status):
    df = spark.createDataFrame([(psi, ks, drifted)], "psi_status string, ks_status string, drifted_count int")
    row = df.select(drift.overall_status().alias("s"), drift.recommendation(drift.overall_status()).alias("r")).first()
    assert row["s"] == status and row["r"] == drift.RECOMMENDATIONS[status]


def test_report_has_all_parts(scored):
    row = drift_report(scored, scored.where("ID % 2 = 1"), ["score", "ID"], label="default_flag").first().asDict()
    assert {"psi", "features", "drifted_features", "overall_status", "total_alerts", "recommendation"} <= row.keys()
    assert set(row["features"]) == {"score", "ID"}


def test_empty_side_is_an_error(scored):
    with pytest.raises(PySparkException):
        drift.service_check(scored, scored.where("ID < 0")).collect()


def test_p_value(spark):
    row = spark.createDataFrame([(0.0, 100, 100), (0.5, 100, 100), (0.1, 100, 100)], "ks double, n_reference bigint, n_production bigint")
    p = [r["p_value"] for r in drift.with_ks_p_value(row).collect()]
    assert p[0] == 1 and p[1] < 1e-9 and p[2] == pytest.approx(0.6994, abs=1e-3)


def test_proxies(spark):
    row = drift.monitor_proxies(column(spark, [0.1] * 9 + [0.9])).first()
    assert row["alerts"] == ["high_risk_share", "approval_share"] and row["mean_score"] == pytest.approx(0.18)


def test_grouped_indices_equal_one_index_per_group(scored):
    reference = scored.where("ID % 2 = 0")
    rows = {r["grp"]: r for r in drift.indices_by(reference, scored, ["score"], ["grp"]).collect()}
    for g in ("a", "b"):
        one = drift.psi(reference, scored.where(F.col("grp") == g)).first()
        assert rows[g]["psi"] == pytest.approx(one["psi"], rel=1e-9) and rows[g]["n_actual"] == one["n_actual"]


def test_equal_width_index_with_empty_bins(spark):
    at = lambda values: spark.createDataFrame([(float(x),) for x in values], ["x"])
    full, gaps = at(range(10)), at([0, 0, 9, 9])
    assert drift.equal_width_psi(full, full, "x").first()["psi"] == pytest.approx(0)
    assert drift.equal_width_psi(gaps, gaps, "x").first()["psi"] == pytest.approx(0)
    for pair in ((full, gaps), (gaps, full)):
        assert drift.equal_width_psi(*pair, "x").first()["psi"] == float("inf")
        assert 0 < drift.equal_width_psi(*pair, "x", eps=1e-4).first()["psi"] < 20
