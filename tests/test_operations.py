from datetime import date, datetime

from pyspark.sql import functions as F

from riskloom.operators import operations

NOW = datetime(2024, 3, 10, 15, 30)


def log(spark, days):
    """Three records at different hours of each day, as days before NOW."""
    at = F.to_timestamp(F.lit("2024-03-10 00:00:00")) - F.make_interval(days=F.col("d"), hours=-F.col("h") * 11)
    rows = spark.createDataFrame([(d, h) for d in days for h in range(3)], "d int, h int")
    return rows.select(at.alias("ts"), F.concat_ws(":", "d", "h").alias("record"))


def test_expired_days_are_removed_and_others_untouched(spark, tmp_path):
    path = f"{tmp_path}/log"
    days = [0, 1, 400, 730, 731, 732, 900, 1500]
    records = log(spark, days).unionByName(spark.createDataFrame([(None, "no time")], "ts timestamp, record string"))
    operations.save_audit(records, path)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "log").rglob("*.parquet")}
    kept = sorted(r["record"] for r in operations.retained(records, F.lit(NOW)).collect())

    gone = operations.expire_audit(spark, path, NOW)
    assert gone == sorted(gone) and all(d < date(2022, 3, 10) for d in gone) and len(gone) == 3
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "log").rglob("*.parquet")}
    assert after == {f: t for f, t in before.items() if f in after} and len(after) < len(before)
    left = operations.read_audit_log(spark, path)
    assert sorted(r["record"] for r in left.where("ts IS NOT NULL").collect()) == kept
    assert left.where("ts IS NULL").count() == 1
    assert operations.expire_audit(spark, path, NOW) == []


def test_other_folders_are_not_read(spark, tmp_path):
    path = f"{tmp_path}/log"
    operations.save_audit(log(spark, range(20)), path)
    rows = operations.read_audit_log(spark, path, date(2024, 3, 5), date(2024, 3, 7))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: ["):].split("]")[0]
    assert "audit_day" in filters and ">=" in filters and "<" in filters
    assert {r["audit_day"] for r in rows.collect()} == {date(2024, 3, 5), date(2024, 3, 6)}


def test_a_repeated_batch_replaces_its_days_only(spark, tmp_path):
    path = f"{tmp_path}/log"
    operations.save_audit(log(spark, [1, 2, 5]), path)
    again = log(spark, [2]).where("record = '2:0'").withColumn("record", F.lit("new"))
    for _ in range(2):
        operations.save_audit(again, path, replace=True)
    day = again.select(F.to_date("ts").alias("d")).first()["d"]
    rows = operations.read_audit_log(spark, path)
    assert [r["record"] for r in rows.where(F.col("audit_day") == F.lit(day)).collect()] == ["new"]
    untouched = log(spark, [1, 2, 5]).where(F.to_date("ts") != F.lit(day))
    assert rows.where(F.col("audit_day") != F.lit(day)).count() == untouched.count()
