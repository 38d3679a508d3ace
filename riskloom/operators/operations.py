"""Figures about the running service: counters, latency, reports, audit records."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.ordered import quantiles

#: column of an audit log that names the folder of a day
DAY = "audit_day"

def request_counts(requests: DataFrame, by: Sequence[str] = ("method", "endpoint", "status")) -> DataFrame:
    return requests.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"))


def prediction_counts(predictions: DataFrame, mode: str = "mode") -> DataFrame:
    return predictions.groupBy(mode).agg(F.count(F.lit(1)).alias("predictions"))


# fixed values: latency targets in milliseconds and load targets
LATENCY_TARGETS = {"p50": 100.0, "p95": 200.0, "p99": 500.0}
REQUESTS_PER_SECOND = 10.0
PREDICTIONS_PER_DAY = 1000


def latency_report(
    requests: DataFrame, by: Sequence[str] = (), latency: str = "latency_ms", method: str = "exact"
) -> DataFrame:
    """Rows (by, n, p50, p95, p99, within_targets)."""
    rows = quantiles(requests, [latency], [0.50, 0.95, 0.99], by, method)
    rows = rows.select(*by, "n", *[F.col("q")[i].alias(p) for i, p in enumerate(LATENCY_TARGETS)])
    inside = [F.col(p) < limit for p, limit in LATENCY_TARGETS.items()]
    return rows.withColumn("within_targets", inside[0] & inside[1] & inside[2])


def throughput(requests: DataFrame, ts: str = "ts", seconds: int = 86400) -> DataFrame:
    """Per time window: requests, requests per second, and whether the daily and rate targets hold."""
    rows = requests.groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(
        F.col("w.start").alias("window_start"), "n", (F.col("n") / float(seconds)).alias("per_second"),
        (F.col("n") / float(seconds) > REQUESTS_PER_SECOND).alias("rate_met"),
        (F.col("n") * 86400.0 / seconds > PREDICTIONS_PER_DAY).alias("daily_met"),
    )


def weekly_report(
    requests: DataFrame, proxies: DataFrame, indices: DataFrame | None = None, ts: str = "ts", latency: str = "latency_ms"
) -> DataFrame:
    """Long rows (week, section, metric, value): load, proxies and stability indices per ISO week.

    ``proxies`` and ``indices`` carry ``week``; the sections are stacked, not joined.
    """
    week = F.date_trunc("week", ts).alias("week")
    load = requests.groupBy(week).agg(F.avg(latency).alias("avg_latency"), F.count(F.lit(1)).cast("double").alias("total_predictions"))

    def stack(df: DataFrame, section: str, metrics: Sequence[str]) -> DataFrame:
        pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        return df.select("week", F.lit(section).alias("section"), F.inline(F.array(*pairs)))

    rows = stack(load, "service", ["avg_latency", "total_predictions"]).unionByName(
        stack(proxies, "proxies", ["high_risk_share", "mean_score", "approval_share"])
    )
    if indices is not None:
        rows = rows.unionByName(
            indices.select("week", F.lit("drift").alias("section"), F.col("feature").alias("metric"), F.col("psi").alias("value"))
        )
    return rows


def audit_records(
    decided: DataFrame, inputs: Sequence[str], at: Column, request_id: Column, version: str = "1.0.0",
    latency: Column | None = None,
) -> DataFrame:
    """One JSON record per prediction: inputs, decision, model version and latency."""
    decision = ["probability", "prediction", "risk_band", "threshold_used"]
    body = F.struct(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), request_id.cast("string").alias("request_id"),
        F.lit(version).alias("model_version"), F.struct(*inputs).alias("input"),
        F.struct(*decision).alias("prediction"), (F.lit(None).cast("double") if latency is None else latency).alias("latency_ms"),
    )
    return decided.select(at.alias("ts"), F.to_json(body).alias("record"))


def read_audit(records: DataFrame, schema: str) -> DataFrame:
    """Audit records back to columns."""
    return records.select("ts", F.from_json("record", schema).alias("r")).select("ts", "r.*")


def retained(records: DataFrame, now: Column, ts: str = "ts", years: int = 2) -> DataFrame:
    """Records inside the retention period."""
    return records.where(F.col(ts) >= F.add_months(now, -12 * years))


def save_audit(records: DataFrame, path: str, ts: str = "ts", replace: bool = False) -> None:
    """Write audit records below ``path``, one folder per day.

    Rows are rebalanced by day, so a quiet day is one file and a busy one is split over tasks.  With
    ``replace`` the days that occur in ``records`` are written anew and all others stay, so a batch
    can be repeated; else rows are appended.
    """
    days = records.withColumn(DAY, F.to_date(ts)).hint("rebalance", DAY)
    mode = "overwrite" if replace else "append"
    days.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def read_audit_log(spark: SparkSession, path: str, since: date | None = None, until: date | None = None) -> DataFrame:
    """Stored audit records from day ``since`` up to, not including, ``until``; other folders are not read."""
    rows = spark.read.parquet(path)
    if since is not None:
        rows = rows.where(F.col(DAY) >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col(DAY) < F.lit(until))
    return rows


def expire_audit(spark: SparkSession, path: str, now: datetime, years: int = 2) -> list[date]:
    """Remove the day folders of an audit log that are past the retention period; the days removed, in order.

    What stays is what ``retained`` keeps, which cuts at whole days too.  No record is read, folders
    without a day are left alone, and a run that was cut short can be repeated.
    """
    first = spark.range(1).select(F.add_months(F.lit(now), -12 * years)).first()[0]
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for entry in system.listStatus(root):  # one entry per day
        name, _, value = entry.getPath().getName().partition("=")
        if not entry.isDirectory() or name != DAY:
            continue
        try:
            day = date.fromisoformat(value)
        except ValueError:  # records without a time
            continue
        if day < first and system.delete(entry.getPath(), True):
            gone.append(day)
    return sorted(gone)
