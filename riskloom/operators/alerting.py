"""Which alerts follow from metric tables, and which of them go out.

Sending is left to others; everything here is a table of alerts in, a table of alerts out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import texts
from riskloom.functions.decisions import rule_table
from riskloom.operators.ordered import join_groups, small_side

# fixed values: rules, channels and limits of the alert settings
DRIFT_THRESHOLD = 0.2
DRIFT_CRITICAL = 0.3
PERFORMANCE_ERROR = 20.0
PERFORMANCE_RULES = [("auc_roc", 0.75, "error"), ("ks_statistic", 0.30, "error"), ("recall", 0.70, "warning")]
CHANNELS = ["slack", "teams", "email", "webhook"]
SUPPRESS_MINUTES = 60
PER_HOUR = 10
PER_DAY = 50
QUIET_FROM, QUIET_UNTIL, QUIET_ZONE = 22, 8, "America/Mexico_City"
ESCALATE_HOURS = 4
ESCALATION_CHANNELS = ["teams", "email"]
REJECT_SHARE = 30.0
ERROR_RATE = 0.05
MODEL_NAME = "credit-risk-model"


def _text(number: Column) -> Column:
    return number.cast("string")


def _metadata(kind: str, **entries: Column) -> Column:
    pairs = {"alert_type": F.lit(kind), **entries}
    return F.create_map(*[x for name, value in pairs.items() for x in (F.lit(name), value)]).alias("metadata")


def drift_alerts(
    indices: DataFrame, threshold: float = DRIFT_THRESHOLD, critical: float = DRIFT_CRITICAL, model: str = MODEL_NAME
) -> DataFrame:
    """One alert per feature whose index exceeds the threshold."""
    limit = F.lit(float(threshold))
    entries = F.create_map(
        F.lit("drift_score"), _text(F.col("csi")), F.lit("threshold"), _text(limit), F.lit("feature"), F.col("feature")
    )
    return indices.where(F.col("csi") > threshold).select(
        texts.drift_title(F.col("feature")).alias("title"),
        texts.drift_message(F.col("csi"), limit).alias("message"),
        F.when(F.col("csi") < critical, "warning").otherwise("critical").alias("severity"),
        entries.alias("metrics"),
        _metadata("data_drift", model=F.lit(model)),
    )


def performance_alerts(
    current: DataFrame, expected: DataFrame, error: float = PERFORMANCE_ERROR, model: str = MODEL_NAME
) -> DataFrame:
    """One alert per metric, by its relative distance from the expected value.

    The distance has no sign: a gain is reported just as a loss is.
    """
    both = current.select("metric", F.col("value").alias("current")).join(
        expected.select("metric", F.col("value").alias("expected")), "metric"
    )
    change = F.try_divide(F.abs(F.col("current") - F.col("expected")), F.col("expected")) * 100
    metric, now, then, degradation = [F.col(c) for c in ("metric", "current", "expected", "degradation")]
    entries = F.create_map(
        F.lit("metric"), metric, F.lit("current_value"), _text(now), F.lit("expected_value"), _text(then),
        F.lit("degradation_pct"), F.format_string("%.2f%%", degradation),
    )
    return both.withColumn("degradation", change).select(
        "metric", "degradation",
        texts.performance_title(metric).alias("title"),
        texts.performance_message(metric, now, degradation, then).alias("message"),
        F.when(degradation < error, "warning").otherwise("error").alias("severity"),
        entries.alias("metrics"), _metadata("performance_degradation", model=F.lit(model)),
    )


def training_alerts(runs: DataFrame) -> DataFrame:
    """One alert per training run from its ``status``, with its map ``metrics`` of numbers if it has one."""
    good = F.col("status") == "success"
    none = F.create_map().cast("map<string,string>")
    entries = F.coalesce(F.col("metrics").cast("map<string,string>"), none) if "metrics" in runs.columns else none
    return runs.select(
        "run_id", "status",
        F.when(good, "Model Training Completed Successfully").otherwise("Model Training Failed").alias("title"),
        F.when(good, "New model trained and ready for deployment.")
        .otherwise("Training pipeline encountered an error. Check logs for details.").alias("message"),
        F.when(good, "info").otherwise("error").alias("severity"),
        entries.alias("metrics"), _metadata("training", status=F.col("status")),
    )


RECORD = ["title", "message", "severity", "ts", "metrics", "metadata"]


def alert_records(tables: Sequence[DataFrame], at: Column) -> DataFrame:
    """Alerts of any kinds as one table (title, message, severity, ts, metrics, metadata).

    ``at`` is the time of alerts that have no ``ts`` of their own.
    """
    def record(table: DataFrame) -> DataFrame:
        own = F.coalesce(F.col("ts"), at) if "ts" in table.columns else at
        return table.select(*[own.alias(c) if c == "ts" else F.col(c) for c in RECORD])

    return reduce(DataFrame.unionByName, [record(t) for t in tables])


def with_bodies(records: DataFrame) -> DataFrame:
    """Alert records with their full message as ``body``."""
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    columns = [F.col(c) for c in ("title", "message", "severity")]
    return records.withColumn("body", texts.alert_body(*columns, time, F.col("metrics"), F.col("metadata")))


def route(alerts: DataFrame, channels: DataFrame, asked: Sequence[str] | None = None) -> DataFrame:
    """Rows (alert, channel): enabled channels, or those asked for; unknown ones are marked undelivered.

    ``channels`` has ``channel`` and ``enabled``; it is the short list of channel kinds.
    """
    if asked is None:
        targets = channels.where("enabled").select("channel", F.lit(True).alias("known"))
    else:
        wanted = rule_table(alerts.sparkSession, [(c,) for c in asked], "channel string")
        known = channels.select("channel", F.lit(True).alias("known"))
        targets = wanted.join(known, "channel", "left").fillna(False, ["known"])
    return alerts.crossJoin(small_side(targets))


def rule_breaches(metrics: DataFrame, rules: Sequence[tuple] = tuple(PERFORMANCE_RULES)) -> DataFrame:
    """Metric rows below their minimum, with the rule's severity."""
    table = rule_table(metrics.sparkSession, list(rules), "metric string, minimum double, severity string")
    return metrics.join(F.broadcast(table), "metric").where(F.col("value") < F.col("minimum"))


def _slot(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000)).cast("bigint")


def suppress_repeats(
    alerts: DataFrame, key: Sequence[str] = ("key",), ts: str = "ts", order: str = "alert_id",
    minutes: int = SUPPRESS_MINUTES,
) -> DataFrame:
    """Keep an alert when the same key had none in the ``minutes`` before it.

    Time is cut into slots of that length.  Within a slot only the first alert can qualify,
    and only the last alert of the slot before can stop it.  So the alerts are reduced to one
    row per (key, slot) with map-side combine before any ordering: a key that floods costs no
    more than a quiet one.
    """
    rest = [c for c in alerts.columns if c not in key]
    slots = alerts.withColumn("_slot", _slot(ts, minutes * 60)).groupBy(*key, "_slot").agg(
        F.min_by(F.struct(*rest), F.struct(ts, order)).alias("_first"), F.max(ts).alias("_last")
    )
    before = F.lag("_last").over(Window.partitionBy(*key).orderBy("_slot"))
    age = F.unix_micros(F.col(f"_first.{ts}")) - F.unix_micros(F.col("_before"))
    free = F.col("_before").isNull() | (age >= minutes * 60_000_000)
    return slots.withColumn("_before", before).where(free).select(*key, "_first.*").select(*alerts.columns)


def first_in_unit(alerts: DataFrame, seconds: int, n: int, by: Sequence[str], ts: str, order: str) -> DataFrame:
    """The first ``n`` alerts of each stretch of ``seconds`` (in UTC), for each value of ``by``."""
    in_turn = Window.partitionBy(*by, "_unit").orderBy(ts, order)
    return (
        alerts.withColumn("_unit", _slot(ts, seconds))
        .withColumn("_turn", F.row_number().over(in_turn)).where(F.col("_turn") <= n).drop("_unit", "_turn")
    )


def limit_rate(
    alerts: DataFrame, ts: str = "ts", order: str = "alert_id", per_hour: int = PER_HOUR, per_day: int = PER_DAY,
    by: Sequence[str] = (),
) -> DataFrame:
    """The first ``per_hour`` alerts of each hour, and of those the first ``per_day`` of each day (both in UTC).

    The limits hold for all alerts, or for each value of ``by``.  A filter on the row number
    lets Spark drop the surplus of an hour before the shuffle.
    """
    return first_in_unit(first_in_unit(alerts, 3_600, per_hour, by, ts, order), 86_400, per_day, by, ts, order)


def quiet_filter(
    alerts: DataFrame, ts: str = "ts", start: int = QUIET_FROM, end: int = QUIET_UNTIL, zone: str = QUIET_ZONE,
    allowed: Sequence[str] = ("critical",),
) -> DataFrame:
    """Drop alerts in the quiet hours of a time zone, save for the allowed severities, in any session time zone."""
    seconds = F.unix_seconds(F.col(ts).cast("timestamp")).cast("decimal(18,6)")
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    hour = F.hour(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc))
    quiet = (hour >= start) | (hour < end) if start > end else (hour >= start) & (hour < end)
    return alerts.where(~quiet | F.col("severity").isin(list(allowed)))


def escalations(
    alerts: DataFrame, resolutions: DataFrame, key: Sequence[str] = ("key",), ts: str = "ts", order: str = "alert_id",
    hours: int = ESCALATE_HOURS,
) -> DataFrame:
    """Alerts with no resolution of their key within ``hours``; they become critical.

    The next resolution after an alert lies in the alert's own minute or is the first of a
    later minute.  The first kind is found inside (key, minute) groups; the second from one
    row per key and minute, which is all a busy key leaves to be put in order.  Alerts and
    resolutions are never paired with each other.
    """
    minute = 60
    raised = alerts.withColumn("_slot", _slot(ts, minute))
    solved = (
        resolutions.select(*key, F.col(ts).alias("_resolved")).withColumn("_slot", _slot("_resolved", minute))
        .dropDuplicates()
    )
    first = solved.groupBy(*key, "_slot").agg(F.min("_resolved").alias("_first"))
    asked = raised.select(*key, "_slot").distinct().withColumn("_first", F.lit(None).cast("timestamp"))
    minutes = first.unionByName(asked).groupBy(*key, "_slot").agg(F.min("_first").alias("_first"))
    ahead = Window.partitionBy(*key).orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    following = minutes.select(*key, "_slot", F.min("_first").over(ahead).alias("_next"))

    marks = solved.withColumn(ts, F.col("_resolved")).withColumn("_mark", F.lit(True))
    timeline = (
        raised.withColumn("_resolved", F.lit(None).cast("timestamp")).withColumn("_mark", F.lit(False))
        .unionByName(marks, allowMissingColumns=True)
    )
    later = Window.partitionBy(*key, "_slot").orderBy(F.desc(ts), F.asc("_mark")).rowsBetween(Window.unboundedPreceding, -1)
    seen = timeline.withColumn("_own", F.min("_resolved").over(later)).where("NOT _mark")
    found = F.least("_own", "_next")
    limit = hours * 3_600_000_000
    late = found.isNull() | (F.unix_micros(found) - F.unix_micros(F.col(ts)) > limit)
    due = F.timestamp_micros(F.unix_micros(F.col(ts)) + limit)
    return join_groups(seen, following, [*key, "_slot"], "left").where(late).select(
        *alerts.columns, due.alias("escalate_at"), F.lit("critical").alias("escalated_to")
    )


def reject_share_alerts(
    decisions: DataFrame, ts: str = "ts", hours: int = 6, limit: float = REJECT_SHARE
) -> DataFrame:
    """Windows in which the share of rejected applications exceeds the limit (percent)."""
    window = F.window(ts, f"{hours} hours")
    share = F.avg((F.col("risk_band") == "RECHAZO").cast("double")) * 100
    rows = decisions.groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("n"), share.alias("reject_percent"))
    return rows.where(F.col("reject_percent") > limit).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "reject_percent"
    )


def error_rate_alerts(
    requests: DataFrame, is_error: Column, ts: str = "ts", minutes: int = 15, limit: float = ERROR_RATE
) -> DataFrame:
    """Windows in which the share of failed requests exceeds the limit."""
    rows = requests.groupBy(F.window(ts, f"{minutes} minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(is_error.cast("double")).alias("error_rate")
    )
    return rows.where(F.col("error_rate") > limit).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "error_rate"
    )
