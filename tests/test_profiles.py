"""Stored reference profiles, and a saved model with its calibration and threshold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.operators import drift, profiles
from riskloom.plans import calibrated, training


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    draw, path = np.random.default_rng(3), tmp_path_factory.mktemp("tables")

    def made(n, shift):
        rows = [
            (i % 5, float(draw.normal(shift, 1)), float(draw.integers(-2, 3)), None if i % 7 == 0 else float(draw.exponential(1 + shift)), float("nan") if i % 3 else 1.0)
            for i in range(n)
        ]
        return spark.createDataFrame(rows, "day int, x double, code double, gap double, empty double").withColumn("none", F.lit(None).cast("double"))

    made(20_000, 0.0).write.parquet(f"{path}/reference")
    made(3_000, 0.3).write.parquet(f"{path}/production")
    return spark.read.parquet(f"{path}/reference"), spark.read.parquet(f"{path}/production")


FEATURES = ["x", "code", "gap"]


def index(rows):
    return {r["feature"]: (r["psi"], r["n_expected"], r["n_actual"]) for r in rows.collect()}


def test_stored_profile_equals_the_exact_index(spark, tables, tmp_path):
    reference, production = tables
    profiles.save_profile(profiles.exact_profile(reference, FEATURES), f"{tmp_path}/p")
    rows = profiles.index_from_profile(profiles.load_profile(spark, f"{tmp_path}/p"), production, [*FEATURES, "nowhere"])
    got, want = index(rows), index(drift.feature_indices(reference, production, FEATURES))
    assert set(got) == set(FEATURES)
    for f in FEATURES:
        assert got[f][0] == pytest.approx(want[f][0], abs=1e-12) and got[f][1:] == want[f][1:]
    plan = rows._jdf.queryExecution().optimizedPlan().toString() + " ".join(rows.inputFiles())
    assert "/reference" not in plan and rows.inputFiles()


def test_merged_days_are_near_the_exact_index(spark, tables, tmp_path):
    reference, production = tables
    profiles.save_profile(profiles.sketch_profile(reference, FEATURES, ["day"], 2048), f"{tmp_path}/days", ["day"])
    days = profiles.load_profile(spark, f"{tmp_path}/days")
    assert days.count() == 15
    whole = profiles.binned(profiles.merged(days, k=2048))
    exact = {r["feature"]: r for r in profiles.exact_profile(reference, FEATURES).collect()}
    for r in whole.collect():
        n = exact[r["feature"]]["n"]
        assert r["n"] == n and sum(r["expected"]) == pytest.approx(n)
        if r["feature"] == "x":  # each edge lies within the stated error of its rank
            ranks = reference.agg(*[F.avg((F.col("x") < e).cast("double")) for e in r["edges"]]).first()
            assert all(abs(rank - (i + 1) / 10) < 0.004 for i, rank in enumerate(ranks))
        if r["feature"] == "code":
            assert list(r["edges"]) == list(exact["code"]["edges"])
            assert np.allclose(r["expected"], exact["code"]["expected"], atol=0.006 * n)
    got, want = index(profiles.index_from_profile(whole, production, FEATURES)), index(drift.feature_indices(reference, production, FEATURES))
    for f in FEATURES:
        assert got[f][0] == pytest.approx(want[f][0], rel=0.1, abs=0.01) and got[f][2] == want[f][2]


def test_a_day_written_again_replaces_itself(spark, tables, tmp_path):
    reference, _ = tables
    for part in (reference, reference.where("day = 2").limit(10)):
        profiles.save_profile(profiles.sketch_profile(part, ["x"], ["day"]), f"{tmp_path}/days", ["day"])
    sizes = {r["day"]: r["n"] for r in profiles.load_profile(spark, f"{tmp_path}/days").collect()}
    assert sizes == {0: 4000, 1: 4000, 2: 10, 3: 4000, 4: 4000}


def test_columns_without_values_have_no_row(tables):
    reference, production = tables
    assert {r["feature"] for r in profiles.sketch_profile(reference, ["x", "none", "empty"]).collect()} == {"x", "empty"}
    profile = profiles.exact_profile(reference, ["x", "none"])
    assert set(index(profiles.index_from_profile(profile, production, ["x", "none"]))) == {"x"}
    assert index(profiles.index_from_profile(profile, production.limit(0), ["x"])) == {}


@pytest.mark.parametrize("method", ["isotonic", "sigmoid", "none"])
def test_loaded_model_decides_like_the_unsaved_one(spark, tmp_path, method):
    draw = np.random.default_rng(5)
    rows = [(i, int(draw.random() < 1 / (1 + np.exp(2 - x))), float(x), float(draw.normal())) for i, x in enumerate(draw.normal(1, 2, 600))]
    df = spark.createDataFrame(rows, "ID bigint, default_flag int, a double, b double")
    result = training.train(df, "logistic_regression", method, features=["a", "b"], runs=f"{tmp_path}/runs", maxIter=50)
    model = calibrated.calibrated_model(result)
    training.save_model(model, f"{tmp_path}/model")
    loaded = training.load_model(spark, f"{tmp_path}/model")
    assert calibrated.threshold_of(loaded) == result["threshold"]
    one, two = (sorted(map(tuple, calibrated.decided(m, df).collect())) for m in (model, loaded))
    assert one == two and len(one) == 600
    known = {r["ID"]: r["score"] for r in result["scored"].collect()}
    assert all(known[i] == pytest.approx(score, abs=1e-12) and decision == (score >= result["threshold"]) for i, score, decision in one)
    run = spark.read.parquet(f"{tmp_path}/runs").first()
    assert run["metrics"]["threshold"] == result["threshold"] and {"train_auc_roc", "val_optimal_recall", "test_brier"} <= set(run["metrics"])
    assert run["params"]["calibration"] == method and run["status"] == "success"
    record = training.model_record(result["scored"], 2, run["params"], metrics=run["metrics"]).first()["record"]
    assert '"test_auc_roc"' in record and v.TARGET not in record
