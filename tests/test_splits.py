import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import resampling, splits


def sizes(df, *by):
    return {tuple(r[c] for c in by): r["count"] for r in df.groupBy(*by).count().collect()}


@pytest.mark.parametrize("n", [3, 600, 9000])
def test_split_sizes_are_exact_per_class(spark, n):
    df = spark.range(n).select(F.col("id").alias("ID"), (F.col("id") % 3 == 0).cast("int").alias("default_flag"))
    total = {r["default_flag"]: r["count"] for r in df.groupBy("default_flag").count().collect()}
    got = sizes(splits.stratified_split(df), "default_flag", "split")
    for c, m in total.items():
        assert got.get((c, "test"), 0) == int(m * 0.2 + 0.5)
    three = sizes(splits.three_way_split(df), "default_flag", "split")
    assert sum(three.values()) == n
    folds = sizes(splits.stratified_folds(df), "default_flag", "fold")
    for c in total:
        counts = [folds.get((c, k), 0) for k in range(5)]
        assert max(counts) - min(counts) <= 1 and sum(counts) == total[c]


def test_split_depends_on_keys_and_seed_only(spark):
    df = spark.range(5000).select(F.col("id").alias("ID"), (F.col("id") % 7 == 0).cast("int").alias("default_flag"))
    rows = lambda d, **o: {r["ID"]: r["split"] for r in splits.stratified_split(d, **o).collect()}
    first = rows(df.repartition(1))
    assert first == rows(df.repartition(64)) and first != rows(df, seed=7)


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "default_flag int")
    assert {r["default_flag"]: r["weight"] for r in splits.class_weights(df).collect()} == {0: 4 / 6, 1: 2.0}


def test_fold_stability_of_equal_folds(spark):
    folds = spark.createDataFrame([(0, 0.8, 0.5, 0.6, 0.7), (1, 0.8, 0.7, 0.6, 0.7)], "fold int, recall double, precision double, f1 double, auc_roc double")
    rows = {r["metric"]: r for r in resampling.fold_stability(folds).collect()}
    assert rows["recall"]["cv"] == 0 and rows["recall"]["label"] == "stable"
    assert rows["precision"]["std"] == pytest.approx(0.1414214, abs=1e-6) and rows["precision"]["label"] == "unstable"


def brute_bootstrap(rows, replicates, threshold):
    draw = np.random.default_rng(0)
    score, label = np.array([r["score"] for r in rows]), np.array([r["default_flag"] for r in rows])
    out = []
    for _ in range(replicates):
        i = draw.integers(0, len(rows), len(rows))
        s, y = score[i], label[i]
        tp, fp = ((s >= threshold) & (y == 1)).sum(), ((s >= threshold) & (y == 0)).sum()
        wins = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
        out.append((tp / y.sum(), tp / (tp + fp), wins))
    return np.array(out)


@pytest.mark.parametrize("cells_per_task, children", [(20_000, 1000), (10, 1000), (3, 3)])  # one, two and several levels
def test_bootstrap_has_the_distribution_of_plain_resampling(scored, cells_per_task, children):
    got = resampling.bootstrap_replicates(
        scored, 300, threshold=0.4, cells_per_task=cells_per_task, children=children
    ).toPandas()
    assert sorted(got["replicate"]) == list(range(300))
    plain = brute_bootstrap(scored.collect(), 300, 0.4)
    for i, c in enumerate(("recall", "precision", "auc_roc")):
        assert got[c].mean() == pytest.approx(plain[:, i].mean(), abs=0.01)
        assert got[c].std() == pytest.approx(plain[:, i].std(), rel=0.3)


def test_bootstrap_of_nothing(scored):
    assert resampling.bootstrap_replicates(scored.where("false"), 5).count() == 0
    with pytest.raises(ValueError):
        resampling.bootstrap_replicates(scored, 5, children=1)


def test_bootstrap_does_not_depend_on_partitioning(scored):
    runs = [resampling.bootstrap_replicates(scored.repartition(p), 60, 0.4).orderBy("replicate").collect() for p in (1, 16)]
    for a, b in zip(*runs):
        assert tuple(a) == pytest.approx(tuple(b), abs=1e-12)
    row = {r["metric"]: r for r in resampling.percentile_intervals(resampling.bootstrap_replicates(scored, 60, 0.4)).collect()}
    assert all(r["low"] <= r["mean"] <= r["high"] for r in row.values())
