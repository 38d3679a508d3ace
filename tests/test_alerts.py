import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import alerting, operations
from riskloom.streaming import monitors

START = dt.datetime(2024, 1, 1)


def make(spark, n=1500, seed=1, hours=72):
    """Alerts in which one key holds a third of all rows."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if draw.random() < 1 / 3 else f"k{draw.randrange(25)}"
        rows.append((i, START + dt.timedelta(seconds=draw.randrange(hours * 3600)), key, draw.choice(["info", "warning", "critical"])))
    return spark.createDataFrame(rows, "alert_id bigint, ts timestamp, key string, severity string"), rows


def ids(df):
    return {r["alert_id"] for r in df.collect()}


def test_suppression_by_brute_force(spark):
    df, rows = make(spark)
    expected, last = set(), {}
    for alert, ts, key, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if key not in last or ts - last[key] >= dt.timedelta(minutes=60):
            expected.add(alert)
        last[key] = ts
    assert ids(alerting.suppress_repeats(df)) == expected


def test_rate_limits_by_brute_force(spark):
    df, rows = make(spark)
    hour, day, expected = {}, {}, set()
    for alert, ts, _, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        h, d = ts.replace(minute=0, second=0), ts.date()
        hour[h] = hour.get(h, 0) + 1
        if hour[h] <= 10:
            day[d] = day.get(d, 0) + 1
            if day[d] <= 50:
                expected.add(alert)
    assert ids(alerting.limit_rate(df)) == expected


def test_rate_limit_drops_surplus_before_the_shuffle(spark, capsys):
    df, _ = make(spark, 50)
    alerting.limit_rate(df).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_escalations_by_brute_force(spark):
    df, rows = make(spark, 900)
    solved = [(r[2], r[1]) for r in rows if r[3] == "info"]
    expected = {
        a for a, ts, key, s in rows if s == "critical"
        and not any(k == key and ts < t <= ts + dt.timedelta(hours=4) for k, t in solved)
    }
    got = alerting.escalations(df.where("severity = 'critical'"), df.where("severity = 'info'").select("key", "ts"))
    assert ids(got) == expected
    assert got.where(F.unix_micros("escalate_at") - F.unix_micros("ts") != 4 * 3600 * 10**6).count() == 0


def test_quiet_hours(spark):
    rows = [(i, dt.datetime(2024, 1, 1, h), "k", s) for i, (h, s) in enumerate(
        [(3, "error"), (4, "error"), (4, "critical"), (13, "error"), (14, "error"), (20, "info")])]
    df = spark.createDataFrame(rows, "alert_id bigint, ts timestamp, key string, severity string")
    # Mexico City is six hours behind: 03:00 is 21:00 there, 04:00 is 22:00, 14:00 is 08:00
    assert ids(alerting.quiet_filter(df)) == {0, 2, 4, 5}


@pytest.mark.parametrize("current,expected,severity,degradation", [(0.7, 0.8, "warning", 12.5), (0.5, 0.8, "error", 37.5), (0.9, 0.8, "warning", 12.5)])
def test_performance_severity(spark, current, expected, severity, degradation):
    at = lambda x: spark.createDataFrame([("recall", x)], "metric string, value double")
    row = alerting.performance_alerts(at(current), at(expected)).first()
    assert row["severity"] == severity and row["degradation"] == pytest.approx(degradation)


def test_drift_severity(spark):
    df = spark.createDataFrame([("a", 0.2), ("b", 0.25), ("c", 0.3)], "feature string, csi double")
    assert {r["title"][-1]: r["severity"] for r in alerting.drift_alerts(df).collect()} == {"b": "warning", "c": "critical"}


def test_disabled_channels_get_nothing(spark):
    df, _ = make(spark, 3)
    off = spark.createDataFrame([("slack", False), ("email", False)], "channel string, enabled boolean")
    assert alerting.route(df, off).count() == 0
    asked = alerting.route(df, off, ["slack", "fax"]).select("channel", "known").distinct().collect()
    assert {tuple(r) for r in asked} == {("slack", True), ("fax", False)}


def test_latency_targets(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "latency_ms double")
    row = operations.latency_report(df).first()
    assert (row["p50"], row["within_targets"]) == (50.5, True)
    assert row["p95"] == pytest.approx(95.05) and row["p99"] == pytest.approx(99.01)


def shuffled(df, path, files):
    """Rows in files whose order has nothing to do with time; a micro-batch each."""
    for i in range(files):
        df.where(F.pmod(F.xxhash64("alert_id"), F.lit(files)) == i).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("files", [1, 2, 5])
def test_streams_equal_batch_whatever_the_order(spark, tmp_path, files):
    df, rows = make(spark, 600)
    folder = shuffled(df, f"{tmp_path}/in", files)

    def stream():
        return monitors.read_table_stream(spark, folder, files_per_trigger=1)

    expected, kept = set(), {}
    for alert, ts, key, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if key not in kept or ts - kept[key] >= dt.timedelta(minutes=60):
            expected.add(alert)
            kept[key] = ts
    disorder = "80 hours"
    assert ids(monitors.run_suppression(monitors.suppress_since_kept(stream(), watermark=disorder), f"{tmp_path}/kept")) == expected
    for by in ([], ["key"]):
        got = monitors.run_rate_limit(stream(), by, per_hour=2, per_day=9, path=f"{tmp_path}/limit{len(by)}")
        assert ids(got) == ids(alerting.limit_rate(df, per_hour=2, per_day=9, by=by))
    rates = monitors.window_error_rates(stream(), F.col("severity") == "critical", watermark=disorder)
    got = monitors.run_windows(rates, path=f"{tmp_path}/rates")
    batch = df.groupBy(F.window("ts", "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "n")
    assert sorted(map(tuple, got.select("window_start", "window_end", "n").collect())) == sorted(map(tuple, batch.collect()))


def test_versions_of_windows_fold(spark, tmp_path):
    day = dt.timedelta(days=1)
    rows = [(i, START + day * (i % 5), i) for i in range(44)]  # every window changes again and again
    for i in range(22):
        part = spark.createDataFrame(rows[2 * i : 2 * i + 2], "id int, ts timestamp, n int").coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/in")
        if i == 12:  # the stream ends in the middle and goes on later
            first = run_daily(spark, tmp_path)
            assert sum(r["n"] for r in first.collect()) == 26
    out = run_daily(spark, tmp_path)
    assert sorted(r["n"] for r in out.collect()) == [8, 9, 9, 9, 9]
    numbers = {kind: monitors._numbered(spark, f"{tmp_path}/out", kind) for kind in ("batch", "fold")}
    assert len(numbers["batch"]) <= 8 and len(numbers["fold"]) <= 2 and max(numbers["batch"]) >= 20
    stale = monitors._standing(spark, f"{tmp_path}/out", numbers["fold"][-1])  # as if the last fold were repeated
    assert len(stale[1]) == 1 + sum(n > stale[0] for n in numbers["batch"])


def run_daily(spark, folder):
    stream = monitors.read_table_stream(spark, f"{folder}/in", files_per_trigger=1).withWatermark("ts", "60 days")
    counts = stream.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    windows = counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
    return monitors.run_windows(windows, path=f"{folder}/out", fold_every=4)


def test_one_table_of_alerts(spark):
    training = spark.createDataFrame([("r1", "success", {"auc": 0.5}), ("r2", "failed", None)], "run_id string, status string, metrics map<string,double>")
    old = dt.datetime(2024, 1, 1)
    drifted = alerting.drift_alerts(spark.createDataFrame([("AGE", 0.4)], "feature string, csi double"), model="m").withColumn("ts", F.lit(old))
    records = alerting.alert_records([alerting.training_alerts(training), drifted], F.lit(START))
    got = {r["title"]: r for r in alerting.with_bodies(records).collect()}
    assert len(got) == 3 and got["Data Drift Detected: AGE"]["ts"] == old
    assert got["Data Drift Detected: AGE"]["metadata"] == {"alert_type": "data_drift", "model": "m"}
    failed = got["Model Training Failed"]
    assert failed["metrics"] == {} and failed["metadata"] == {"alert_type": "training", "status": "failed"}
    assert "**Metrics:**" not in failed["body"] and "- status: failed" in failed["body"]
    assert "- auc: 0.5" in got["Model Training Completed Successfully"]["body"]


def test_suppression_settles_and_forgets_as_time_goes_on(spark, tmp_path):
    df, rows = make(spark, 300)
    for i in range(3):  # files that follow each other, so that the watermark moves
        low, high = START + dt.timedelta(hours=24 * i), START + dt.timedelta(hours=24 * (i + 1))
        df.where((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    expected, kept = set(), {}
    for alert, ts, key, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if key not in kept or ts - kept[key] >= dt.timedelta(minutes=60):
            expected.add(alert)
            kept[key] = ts
    stream = monitors.read_table_stream(spark, f"{tmp_path}/in", files_per_trigger=1)
    out = monitors.run_suppression(monitors.suppress_since_kept(stream), f"{tmp_path}/out")
    assert ids(out) == expected


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/Mexico_City", "Asia/Kolkata"])
def test_hours_do_not_follow_the_session_zone(spark, zone):
    seconds = [(0, 1_704_135_600), (1, 1_704_169_800), (2, 1_704_171_000)]  # 13:00, 22:30 and 22:50 in Mexico City
    df = spark.createDataFrame(seconds, "alert_id bigint, s bigint").selectExpr(
        "alert_id", "timestamp_seconds(s) AS ts", "'k' AS key", "'error' AS severity")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert ids(alerting.quiet_filter(df)) == {0}
        assert ids(alerting.limit_rate(df, per_hour=1)) == {0, 1}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
