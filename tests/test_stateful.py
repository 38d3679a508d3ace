"""Stateful alert rules against their batch forms, in any order of files, with state that stays small."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import alerting
from riskloom.streaming import monitors, stateful

START = dt.datetime(2024, 1, 1)
SHAPE = "alert_id bigint, ts timestamp, key string"


def made(spark, n, days=3, seed=1, keys="abbbbb"):
    draw = random.Random(seed)
    rows = [(i, START + dt.timedelta(seconds=draw.randrange(days * 86_400)), draw.choice(keys)) for i in range(n)]
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], None), (n + 2, None, "a"), (None, rows[0][1], "a")]
    return spark.createDataFrame(rows, SHAPE)


def ids(df):
    return sorted(r["alert_id"] for r in df.collect())


def streamed(spark, df, path, files, by_time=False):
    part = F.floor(F.rank().over(Window.orderBy("ts")) * files / (df.count() + 1)) if by_time else F.pmod(F.xxhash64("alert_id"), F.lit(files))
    numbered = df.withColumn("part", part).collect()
    for i in range(files):
        rows = [tuple(r)[:-1] for r in numbered if r["part"] == i]
        spark.createDataFrame(rows, df.schema).coalesce(1).write.mode("append").parquet(path)
    return lambda: monitors.read_table_stream(spark, path, files_per_trigger=1)


@pytest.mark.parametrize("by", [[], ["key"]])
def test_rate_limit_equals_batch(spark, tmp_path, by):
    df = made(spark, 900)
    stream = streamed(spark, df, f"{tmp_path}/in", 3)
    got = stateful.run_closed(lambda end: stateful.limit_rate(stream(), by, per_hour=3, per_day=20, watermark="80 hours", end=end), spark, f"{tmp_path}/out")
    known = df.where("ts IS NOT NULL AND alert_id IS NOT NULL")
    assert got.columns == [*by, "alert_id", "ts"]
    assert ids(got) == ids(alerting.limit_rate(known, per_hour=3, per_day=20, by=by))


def test_escalations_equal_batch(spark, tmp_path):
    df, solved = made(spark, 500), made(spark, 60, seed=2).select("ts", "key")
    stream, answers = streamed(spark, df, f"{tmp_path}/in", 2), streamed(spark, solved.withColumn("alert_id", F.monotonically_increasing_id()), f"{tmp_path}/res", 2)
    got = stateful.run_closed(lambda end: stateful.escalate(stream(), answers(), watermark="80 hours", end=end), spark, f"{tmp_path}/out")
    known = df.where("ts IS NOT NULL AND alert_id IS NOT NULL")
    want = alerting.escalations(known.where("key IS NOT NULL"), solved.where("ts IS NOT NULL AND key IS NOT NULL"))
    none = {r["alert_id"] for r in known.where("key IS NULL").collect()}
    assert sorted(set(ids(got)) - none) == ids(want) and set(ids(got)) & none == {
        r["alert_id"] for r in known.where("key IS NULL").collect()
        if not any(r["ts"] < s["ts"] <= r["ts"] + dt.timedelta(hours=4) for s in solved.where("key IS NULL AND ts IS NOT NULL").collect())
    }


@pytest.mark.parametrize("hours", [0.5, 4])
def test_own_resolution_in_time_or_not(spark, tmp_path, hours):
    df = made(spark, 200).where("ts IS NOT NULL AND alert_id IS NOT NULL")
    delay = {0: 0, 1: 1, 2: hours, 3: hours + 1 / 3600, 4: 9}
    solved = [(r["alert_id"], r["ts"] + dt.timedelta(hours=delay[r["alert_id"] % 6])) for r in df.collect() if r["alert_id"] % 6 in delay]
    stream = streamed(spark, df, f"{tmp_path}/in", 2)
    answers = streamed(spark, spark.createDataFrame(solved, "alert_id bigint, ts timestamp"), f"{tmp_path}/res", 2)
    got = stateful.run_closed(lambda end: stateful.escalate_unanswered(stream(), answers(), hours=hours, watermark="90 hours", end=end), spark, f"{tmp_path}/out")
    in_time = {m for m, d in delay.items() if d <= hours}
    assert ids(got) == sorted(r["alert_id"] for r in df.collect() if r["alert_id"] % 6 not in in_time)


def test_alerts_leave_when_their_time_is_up_and_state_stays_small(spark, tmp_path):
    df = made(spark, 1_500, days=10).where("ts IS NOT NULL AND alert_id IS NOT NULL AND key IS NOT NULL")
    stream = streamed(spark, df, f"{tmp_path}/in", 25, by_time=True)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for name, build, most in (
            ("limit", lambda end: stateful.limit_rate(stream(), ["key"], per_hour=3, per_day=20, end=end), 200),
            ("late", lambda end: stateful.escalate(stream(), stream().where("alert_id % 5 = 0"), end=end), 30),
        ):
            reports = []
            got = stateful.run_closed(build, spark, f"{tmp_path}/{name}", reports)
            held = [p["stateOperators"][0]["numRowsTotal"] for p in reports if p["stateOperators"]]
            assert len(held) >= 25 and max(held) <= most and held[-1] == 0
            assert got.select(F.input_file_name()).distinct().count() > 12  # not all at the end
            want = alerting.limit_rate(df, per_hour=3, per_day=20, by=["key"]) if name == "limit" else alerting.escalations(df, df.where("alert_id % 5 = 0"))
            assert ids(got) == ids(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
