import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.functions.features import with_features
from riskloom.operators import attribution
from riskloom.plans import scoring, training
from riskloom.runtime import pin


@pytest.fixture(scope="module")
def clients(spark):
    draw = np.random.default_rng(4)
    n = 400
    delay = draw.integers(-2, 6, n)
    label = (draw.random(n) < 1 / (1 + np.exp(2.0 - 0.9 * delay))).astype(int)
    rows = []
    for i in range(n):
        row = {c: 0.0 for c in v.RAW_FEATURES} | {
            "LIMIT_BAL": float(draw.integers(1, 50) * 10000), "SEX": float(draw.integers(1, 3)), "EDUCATION": float(draw.integers(0, 7)),
            "MARRIAGE": float(draw.integers(0, 4)), "AGE": float(draw.integers(21, 70)), "PAY_0": float(delay[i]),
            "BILL_AMT1": float(draw.integers(0, 90000)), "PAY_AMT1": float(draw.integers(0, 9000)),
        }
        rows.append((i, int(label[i]), *row.values()))
    schema = "ID bigint, default_flag int, " + ", ".join(f"{c} double" for c in v.RAW_FEATURES)
    return pin(with_features(spark.createDataFrame(rows, schema), "notebook"))


def test_target_and_key_never_reach_the_model(clients):
    table = training.prepare(clients.withColumn("default", F.col("default_flag")), [*v.MODEL_FEATURES, "default", "ID", "default_flag"])
    assert set(table.columns) == {"ID", "default_flag", *training.plain_features()}


def test_training_learns_and_reports_every_split(clients):
    result = training.train(clients, "logistic_regression", "sigmoid", maxIter=30)
    rows = {(r["split"], r["threshold"]): r for r in result["metrics"].collect()}
    assert {s for s, _ in rows} == {"train", "validation", "test"} and len(rows) == 6
    assert rows[("train", 0.5)]["auc_roc"] > 0.7
    assert 0.01 <= result["threshold"] <= 0.99
    names = {r["metric"] for r in training.named_credit_metrics(result["metrics"], result["threshold"]).collect()}
    assert {"train_auc_roc", "val_optimal_recall", "test_optimal_f1"} <= names


def test_isotonic_scores_rise_and_stay_in_range(clients, spark):
    rows = clients.select("ID", v.TARGET, (F.col("PAY_0") / 10).alias("raw"))
    fitted = training.fit_calibrator(rows, "isotonic", "raw").apply(rows).orderBy("raw").collect()
    scores = [r["score"] for r in fitted]
    assert all(a <= b + 1e-12 for a, b in zip(scores, scores[1:])) and 0 <= scores[0] and scores[-1] <= 1
    assert np.mean(scores) == pytest.approx(np.mean([r[v.TARGET] for r in fitted]), abs=1e-9)


def test_saved_model_scores_alike(clients, spark, tmp_path):
    model = training.fit_model(training.prepare(clients), "random_forest", training.plain_features(), numTrees=3, maxDepth=3)
    training.save_model(model, f"{tmp_path}/m")
    raw = clients.select("ID", v.TARGET, *v.RAW_FEATURES)
    a, b = (scoring.score_batch(m, raw, variant="notebook").drop("prediction_timestamp").orderBy("ID").collect()
            for m in (model, training.load_model(spark, f"{tmp_path}/m")))
    assert a == b and len(a) == 400
    with pytest.raises(FileNotFoundError):
        training.load_model(spark, f"{tmp_path}/none")


def test_unknown_kinds(clients):
    with pytest.raises(ValueError):
        training.estimator("oracle")
    with pytest.raises(ValueError):
        training.fit_calibrator(clients, "magic", "PAY_0")


def test_search_space_is_respected():
    draws = training.sample_settings(50)
    assert draws == training.sample_settings(50)
    for name, low, high, _ in training.SEARCH_SPACE:
        assert all(low <= d[name] <= high for d in draws)


def test_attributions_add_up(clients):
    names = ["PAY_0", "AGE", "LIMIT_BAL"]
    rows = clients.select("ID", *names)
    value = lambda df: df.withColumn("score", F.col("PAY_0") * 2.0 + F.col("AGE") * F.col("LIMIT_BAL") / 1e6)
    sample, background = pin(attribution.hash_sample(rows, 6)), pin(attribution.hash_sample(rows, 5, seed=1))
    found = attribution.shapley(sample, background, names, value, orders=3)
    total = {r["ID"]: r["t"] for r in found.groupBy("ID").agg(F.sum("attribution").alias("t")).collect()}
    base = value(background).agg(F.avg("score")).first()[0]
    for r in value(sample).collect():
        assert total[r["ID"]] == pytest.approx(r["score"] - base, abs=1e-9)
    top = attribution.top_attributions(found, 2)
    assert top.count() == 12


def test_linear_attributions_equal_all_orders(clients):
    weights = {"PAY_0": 2.0, "AGE": -0.5, "LIMIT_BAL": 1e-5, "BILL_AMT1": 3e-4}
    names = list(weights)
    rows = clients.select("ID", *names)
    sample, background = pin(attribution.hash_sample(rows, 3)), pin(attribution.hash_sample(rows, 4, seed=1))
    found = {(r["ID"], r["feature"]): r["attribution"] for r in attribution.linear_shapley(sample, background, weights).collect()}
    value = lambda row: sum(weights[f] * float(row[f]) for f in names)
    orders = list(itertools.permutations(names))
    for row in sample.collect():
        gains = dict.fromkeys(names, 0.0)
        for base in background.collect():
            for order in orders:
                state = {f: base[f] for f in names}
                for f in order:
                    before = value(state)
                    state[f] = row[f]
                    gains[f] += (value(state) - before) / (4 * len(orders))
        for f in names:
            assert found[row["ID"], f] == pytest.approx(gains[f], abs=1e-7)


@pytest.mark.parametrize("scale", [True, False])
def test_linear_attributions_explain_the_log_odds_of_a_model(clients, scale):
    names = ["PAY_0", "AGE", "LIMIT_BAL"]
    model = training.fit_model(clients, "logistic_regression", names, scale=scale)
    background = pin(attribution.hash_sample(clients, 20))
    found = attribution.linear_shapley(clients, background, training.linear_weights(model, names))
    total = {r["ID"]: r["t"] for r in found.groupBy("ID").agg(F.sum("attribution").alias("t")).collect()}
    base = training.scored(model, background, margin="m").agg(F.avg("m")).first()[0]
    margins = training.scored(model, clients, margin="m").select("ID", "m").collect()
    assert len(margins) == len(total) > 0
    assert all(total[r["ID"]] == pytest.approx(r["m"] - base, abs=1e-6) for r in margins)


def test_search_in_parallel_equals_one_trial_at_a_time(clients):
    small = {"trials": 3, "k": 2, "maxIter": 2, "maxDepth": 2}
    tables = [training.search(clients, training.plain_features(["AGE", "PAY_0"]), parallelism=p, **small).collect() for p in (1, 3)]
    assert tables[0] == tables[1] and [r["trial"] for r in tables[0]] != [] and len(tables[0]) == 3
    assert [r["cv_auc"] for r in tables[0]] == sorted((r["cv_auc"] for r in tables[0]), reverse=True)


def test_a_failing_trial_ends_the_search(clients):
    with pytest.raises(Exception, match="maxDepth"):
        training.search(clients, ["AGE"], trials=3, k=2, maxIter=1, maxDepth=99)


def trees(model):
    return model.stages[-1].toDebugString.split("\n", 1)[1]  # without the uid


def test_boosting_reads_rows_without_their_lineage_and_is_the_same(clients, monkeypatch):
    seen, fit = [], training.GBTClassifier._fit
    monkeypatch.setattr(training.GBTClassifier, "_fit", lambda self, df: seen.append(df) or fit(self, df))
    rows, names = pin(training.prepare(clients).coalesce(1)), training.plain_features()
    model = training.fit_model(rows, "gradient_boosting", names, maxIter=3, maxDepth=3)
    lineage = seen[0]._jdf.queryExecution().toRdd().toDebugString()
    assert "CheckpointRDD" in lineage and "FileScan" not in lineage
    assert trees(model) == trees(training.fit_model(rows, "gradient_boosting", names, cut=False, maxIter=3, maxDepth=3))
    assert len(model.stages) == 2 and training.scored(model, rows).count() == 400


def test_training_scores_its_rows_once(clients, monkeypatch):
    read, fit = [], training.fit_calibrator
    monkeypatch.setattr(training, "fit_calibrator", lambda df, *rest: read.append(df) or fit(df, *rest))
    training.train(clients, "random_forest", "sigmoid", numTrees=2, maxDepth=2)
    plan = read[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "margin" in plan and "UDF(" not in plan  # stored scores, not the model over the rows
