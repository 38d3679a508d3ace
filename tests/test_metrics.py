import pytest
from pyspark.sql import functions as F

from riskloom.operators import calibration, classifier, curves, fairness, ranking, summaries, sweep

# the ten-row demo: all positives above all negatives
DEMO = list(zip(
    [0, 0, 1, 1, 0, 1, 0, 1, 1, 0], [0.1, 0.2, 0.8, 0.4, 0.3, 0.9, 0.2, 0.7, 0.85, 0.15],
))


@pytest.fixture(scope="module")
def demo(spark):
    return spark.createDataFrame(DEMO, "default_flag int, score double")


@pytest.fixture(scope="module")
def recorded(spark):
    return spark.createDataFrame([(2110, 2563, 172, 1155)], "tn bigint, fp bigint, fn bigint, tp bigint")


def test_demo_metrics(demo):
    row = classifier.classification_metrics(demo, [0.5]).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (4, 0, 1, 5)
    assert row["precision"] == 1 and row["recall"] == 0.8 and row["specificity"] == 1
    assert row["f1"] == pytest.approx(0.888889, abs=1e-6)
    assert row["auc_roc"] == 1 and row["ks"] == 1 and row["brier"] == pytest.approx(0.0725)
    money = classifier.business_metrics(classifier.confusion(demo, 0.5)).first()
    assert (money["total_cost"], money["baseline_cost"], money["expected_savings"], money["savings_percentage"]) == (10000, 50000, 40000, 80)


def test_recorded_cells(recorded):
    rates = classifier.cell_metrics(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    row = recorded.select(*[x.alias(n) for n, x in rates.items()]).first()
    assert row["recall"] == pytest.approx(0.8703843255463452)
    assert row["precision"] == pytest.approx(0.3106508875739645)
    assert row["f1"] == pytest.approx(0.4578790882061447)
    assert row["accuracy"] == pytest.approx(0.5441666666666667)


def test_recorded_savings(spark):
    at = lambda fp, fn: fp * 500 + fn * 10000
    assert at(255, 834) - at(2563, 172) == 5466000
    cells = spark.createDataFrame([(2563, 172, 1155, 2110)], "fp bigint, fn bigint, tp bigint, tn bigint")
    assert classifier.business_metrics(cells, 500).first()["total_cost"] == 3001500


def brute_auc(rows):
    pos, neg = [s for _, s, y, _ in rows if y], [s for _, s, y, _ in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_and_ks_by_brute_force(scored):
    rows = scored.collect()
    got = classifier.ranking_metrics(scored).first()
    assert got["auc_roc"] == pytest.approx(brute_auc(rows), abs=1e-12)
    pos, neg = [s for _, s, y, _ in rows if y], [s for _, s, y, _ in rows if not y]
    gaps = [sum(p >= t for p in pos) / len(pos) - sum(n >= t for n in neg) / len(neg) for t in {r[1] for r in rows}]
    assert got["ks"] == pytest.approx(max(0, *gaps)) and got["ks_two_sided"] == pytest.approx(max(map(abs, gaps)))


def test_auc_of_reversed_score(scored):
    flipped = scored.withColumn("score", 1 - F.col("score"))
    a, b = (classifier.ranking_metrics(df).first()["auc_roc"] for df in (scored, flipped))
    assert a + b == pytest.approx(1)


def test_metrics_do_not_depend_on_partitioning(scored):
    rows = [classifier.classification_metrics(scored.repartition(p), [0.4], by=["grp"]).orderBy("grp").collect() for p in (1, 64)]
    for a, b in zip(*rows):
        assert a.asDict().keys() == b.asDict().keys()
        assert all(x == y or x == pytest.approx(y, abs=1e-12) for x, y in zip(a, b))


def test_one_class_gives_zero_cells_and_no_auc(spark):
    df = spark.createDataFrame([(0.2, 0), (0.6, 0)], "score double, default_flag int")
    row = classifier.classification_metrics(df, [0.5]).first()
    assert (row["tp"], row["fn"], row["fp"], row["tn"]) == (0, 0, 1, 1) and row["auc_roc"] is None and row["recall"] == 0


def test_sweep_equals_separate_passes(scored):
    swept = {r["threshold"]: r for r in sweep.sweep(scored).collect()}
    assert len(swept) == 99
    for t in (0.01, 0.3, sweep.HUNDREDTHS[34], 0.99):
        cells = classifier.confusion(scored, t).first()
        assert all(swept[t][c] == cells[c] for c in ("tn", "fp", "fn", "tp"))
    assert all(r["tn"] + r["fp"] + r["fn"] + r["tp"] == 600 for r in swept.values())


def test_score_on_a_threshold_counts_as_positive(spark):
    df = spark.createDataFrame([(0.3, 1), (0.12, 1)], "score double, default_flag int")
    rows = {r["threshold"]: r["tp"] for r in sweep.sweep(df, sweep.NINETY).collect()}
    assert rows[sweep.NINETY[25]] == (1 if 0.3 >= sweep.NINETY[25] else 0)
    assert sweep.NINETY[7] == 0.12000000000000001 and rows[sweep.NINETY[7]] == 1  # 0.12 lies just below


def test_cheapest_threshold_is_the_first(spark):
    df = spark.createDataFrame([(0.5, 1), (0.1, 0)], "score double, default_flag int")
    assert sweep.cost_optimal_threshold(df).first()["optimal_threshold"] == sweep.HUNDREDTHS[10]


def test_unreachable_recall_falls_back(spark):
    rows = spark.createDataFrame(
        [(0.1, 0.6, 0.2, 5.0, 0.3), (0.2, 0.5, 0.9, 4.0, 0.6)], "threshold double, recall double, precision double, total_cost double, f1 double"
    )
    found = {r["rule"]: r["threshold"] for r in sweep.chosen_thresholds(rows).collect()}
    assert found == {"min_cost": 0.2, "max_f1": 0.2, "recall_target": 0.1}
    assert sweep.final_threshold(rows).first()["met"] == "cost"


def test_empty_bins_are_dropped_and_weights_fit(spark):
    df = spark.createDataFrame([(0.05, 0), (0.1, 1), (0.95, 1)], "score double, default_flag int")
    table = {r["bin"]: r["n"] for r in calibration.reliability(df).collect()}
    assert table == {0: 2, 9: 1}  # 0.1 belongs to the first bin, right-closed
    own = calibration.calibration_error(df).first()["ece"]
    assert own == pytest.approx((2 * abs(0.5 - 0.075) + abs(1 - 0.95)) / 3)
    # the compatible form pairs bin 9 with the left-closed bin [0.1, 0.2)
    assert calibration.calibration_error(df, compat=True).first()["ece"] == pytest.approx((abs(0.5 - 0.075) + abs(1 - 0.95)) / 3)


def test_roc_without_collinear_points(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 1), (0.2, 0), (0.1, 0)], "score double, default_flag int")
    thresholds = sorted((r["threshold"] for r in curves.roc_points(df, drop_collinear=True).collect()), reverse=True)
    assert thresholds == [float("inf"), 0.9, 0.7, 0.1]
    areas = curves.curve_areas(df).first()
    assert areas["roc_area"] == pytest.approx(1) and areas["pr_area"] == pytest.approx(1)


def test_fairness_without_positives_has_fnr_one(spark):
    df = spark.createDataFrame([(0.9, 0, "x"), (0.1, 0, "x"), (0.9, 1, "y"), (0.1, 1, "y")], "score double, default_flag int, g string")
    rows = {r["group"]: r for r in fairness.group_fairness(df, "g", 0.5).collect()}
    assert rows["x"]["fnr"] == 1 and rows["x"]["fpr"] == 0.5 and rows["y"]["fnr"] == 0.5 and rows["y"]["fpr"] == 0
    impact = fairness.disparate_impact(fairness.group_fairness(df, "g", 0.5)).first()
    assert impact["disparate_impact"] == 1 and not impact["biased"]


def test_few_values_are_groups_of_their_own(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(40)], "ID bigint, few int, many double")
    assert {r[0] for r in ranking.with_value_groups(df, "few").select("group").collect()} == {"Grupo 0", "Grupo 1", "Grupo 2"}
    sizes = {r["group"]: r["count"] for r in ranking.with_value_groups(df, "many").groupBy("group").count().collect()}
    assert set(sizes) == set(ranking.QUARTERS) and set(sizes.values()) == {10}


def test_histogram_counts_every_row(scored):
    rows = summaries.histograms(scored, ["score"], 30).collect()
    assert len(rows) == 30 and sum(r["n"] for r in rows) == 600


def test_constant_column_histogram(spark):
    rows = summaries.histograms(spark.createDataFrame([(2.0,)] * 5, "x double"), ["x"], 4).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [0, 0, 5, 0] and rows[0]["low"] == 1.5


def test_absent_band_is_zero(spark):
    rows = summaries.band_distribution(spark.createDataFrame([("RECHAZO",)], "risk_band string")).collect()
    assert [(r["band"], r["clients"], r["percent"]) for r in rows] == [("APROBADO", 0, 0.0), ("REVISION", 0, 0.0), ("RECHAZO", 1, 100.0)]


def test_many_values_is_decided_exactly(spark):
    df = spark.range(2000).select((F.col("id") % 10).alias("ten"), (F.col("id") % 11).alias("eleven"), "id")
    assert [ranking.has_many_values(df, c, 10) for c in ("ten", "eleven", "id")] == [False, True, True]


def test_fairness_leaves_out_rows_without_score_or_label(spark):
    df = spark.createDataFrame(
        [("a", 0.9, 1), ("a", 0.1, 0), ("a", None, 1), ("a", 0.9, None)], "g string, score double, default_flag int")
    row = fairness.group_fairness(df, "g", 0.5).first()
    assert (row["n"], row["selection_rate"], row["recall"]) == (2, 0.5, 1.0)


def test_correlations_with_gaps(spark):
    rows = [(1.0, 2.0, 1.0), (2.0, 4.0, None), (3.0, 7.0, 2.0), (4.0, None, 5.0), (5.0, 9.0, 4.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    for pairwise, frame in ((True, df.toPandas()), (False, df.na.drop().toPandas())):
        got = {(r["left"], r["right"]): r["r"] for r in summaries.correlations(df, "xyz", pairwise).collect()}
        assert got == {(a, b): pytest.approx(r) for a, rest in frame.corr().to_dict().items() for b, r in rest.items()}
