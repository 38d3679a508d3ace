"""Alert decisions and operational figures over events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from registry.cleaning import long_sql, psi_ctes
from registry.common import APP, panel, plain_time, quantile_sql, query, requests, rounded, rounded_sql
from registry.drifting import ITEM_FEATURES, PANEL_FEATURES, grouped_psi_ctes, item_psi, item_sides, sides
from registry.metrics import RATES, cells_sql, point_ctes

from riskloom.functions.decisions import with_decisions, with_online_response
from riskloom.operators import alerting, drift, operations
from riskloom.operators.classifier import classification_metrics, to_long
from riskloom.runtime import scratch_path

ALERTS_SQL = """al AS (SELECT event_id AS alert_id, ts, CAST(user_id AS VARCHAR) AS key,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' WHEN 'view' THEN 'info' ELSE 'error' END AS severity FROM events)"""


def alerts(spark, folder):
    kind = F.col("event_type")
    severity = F.when(kind == "error", "critical").when(kind == "purchase", "warning").when(kind == "view", "info").otherwise("error")
    return requests(spark, folder).select(
        F.col("event_id").alias("alert_id"), "ts", F.col("user_id").cast("string").alias("key"), severity.alias("severity")
    )


@query("drift_alerts", f"""WITH {APP}, x AS ({long_sql(PANEL_FEATURES)}), {psi_ctes('x')}, h AS (SELECT feature, round(psi*20,4) AS csi FROM psi)
    SELECT 'Data Drift Detected: ' || feature AS title, printf('Drift score (%.4f) exceeds threshold (%.4f). Consider retraining the model.', csi, 0.2e0) AS message,
    CASE WHEN csi<0.3e0 THEN 'warning' ELSE 'critical' END AS severity, 'data_drift' AS alert_type FROM h WHERE csi>0.2e0""")
def _(spark, folder):
    indices = drift.csi(*sides(spark, folder), PANEL_FEATURES).withColumn("csi", F.round(F.col("csi") * 20, 4))
    return alerting.drift_alerts(indices).select("title", "message", "severity", F.col("metadata")["alert_type"].alias("alert_type"))


EXPECTED = [("auc_roc", 0.95), ("ks", 0.42), ("recall", 0.87), ("precision", 0.31)]
EXPECTED_SQL = f"ex AS (SELECT unnest({[m for m, _ in EXPECTED]!r}) AS metric, unnest({[x for _, x in EXPECTED]!r}) AS expected)"
CURRENT_SQL = f"""cu AS (SELECT unnest(['auc_roc','ks','recall','precision']) AS metric,
    unnest([auc_roc, ks, {RATES['recall']}, {RATES['precision']}]) AS value FROM om, cells)"""


@query("performance_alerts", rounded_sql(
    ["degradation"], """SELECT metric, degradation, 'Model Performance Degradation: ' || metric AS title,
    printf('Current %s (%.4f) is %.1f%% below expected (%.4f). Investigate immediately.', metric, value, degradation, expected) AS message,
    CASE WHEN degradation<20 THEN 'warning' ELSE 'error' END AS severity
    FROM (SELECT metric, value, CAST(expected AS DOUBLE) AS expected, abs(value-expected)/expected*100 AS degradation FROM cu JOIN ex USING (metric))""",
    ctes=f"{point_ctes('app')}, {cells_sql('app', '[0.12e0]')}, {CURRENT_SQL}, {EXPECTED_SQL}",
))
def _(spark, folder):
    metrics = to_long(classification_metrics(panel(spark, folder)), [m for m, _ in EXPECTED])
    found = alerting.performance_alerts(metrics, spark.createDataFrame(EXPECTED, "metric string, value double"))
    return rounded(found.drop("metrics", "metadata"))


@query("training_alerts", f"""WITH {APP}, {point_ctes('app', 'fold')}, r AS (SELECT 'run-' || fold AS run_id, CASE WHEN auc_roc>=0.85e0 THEN 'success' ELSE 'failed' END AS status FROM om)
    SELECT run_id, status, CASE status WHEN 'success' THEN 'Model Training Completed Successfully' ELSE 'Model Training Failed' END AS title,
    CASE status WHEN 'success' THEN 'New model trained and ready for deployment.' ELSE 'Training pipeline encountered an error. Check logs for details.' END AS message,
    CASE status WHEN 'success' THEN 'info' ELSE 'error' END AS severity FROM r""")
def _(spark, folder):
    rows = classification_metrics(panel(spark, folder), by=["fold"])
    status = F.when(F.col("auc_roc") >= 0.85, "success").otherwise("failed")
    runs = rows.select(F.concat(F.lit("run-"), F.col("fold").cast("string")).alias("run_id"), status.alias("status"))
    return alerting.training_alerts(runs).drop("metrics", "metadata")


def channels(spark):
    return spark.createDataFrame([(c, c in ("slack", "email")) for c in alerting.CHANNELS], "channel string, enabled boolean")


def entries_sql(title, **entries):
    lines = " || ".join(f"E'  - {k}: ' || {x} || E'\\n'" for k, x in sorted(entries.items()))
    return f"E'\\n**{title}:**\\n' || {lines}"


DRIFT_RECORDS = f"""WITH {APP}, x AS ({long_sql(PANEL_FEATURES)}), {psi_ctes('x')}, h AS (SELECT feature, round(psi*20,4) AS csi FROM psi)
    SELECT 'Data Drift Detected: ' || feature AS title, printf('Drift score (%.4f) exceeds threshold (%.4f). Consider retraining the model.', csi, 0.2e0) AS message,
    CASE WHEN csi<0.3e0 THEN 'warning' ELSE 'critical' END AS severity,
    {entries_sql('Metrics', drift_score='CAST(csi AS VARCHAR)', threshold="'0.2'", feature='feature')} AS m,
    {entries_sql('Metadata', alert_type="'data_drift'", model="'credit-risk-model'")} AS d FROM h WHERE csi>0.2e0"""
PERFORMANCE_RECORDS = f"""WITH {APP}, {point_ctes('app')}, {cells_sql('app', '[0.12e0]')}, {CURRENT_SQL}, {EXPECTED_SQL},
    p AS (SELECT metric, now, expected, abs(now-expected)/expected*100 AS off FROM (SELECT metric, round(value,4) AS now, CAST(expected AS DOUBLE) AS expected FROM cu JOIN ex USING (metric)))
    SELECT 'Model Performance Degradation: ' || metric AS title, printf('Current %s (%.4f) is %.1f%% below expected (%.4f). Investigate immediately.', metric, now, off, expected) AS message,
    CASE WHEN off<20 THEN 'warning' ELSE 'error' END AS severity,
    {entries_sql('Metrics', metric='metric', current_value='CAST(now AS VARCHAR)', expected_value='CAST(expected AS VARCHAR)', degradation_pct="printf('%.2f%%', off)")} AS m,
    {entries_sql('Metadata', alert_type="'performance_degradation'", model="'credit-risk-model'")} AS d FROM p"""
TRAINING_RECORDS = f"""WITH {APP}, {point_ctes('app', 'fold')}, r AS (SELECT round(auc_roc,4) AS auc, auc_roc>=0.85e0 AS good FROM om)
    SELECT CASE WHEN good THEN 'Model Training Completed Successfully' ELSE 'Model Training Failed' END AS title,
    CASE WHEN good THEN 'New model trained and ready for deployment.' ELSE 'Training pipeline encountered an error. Check logs for details.' END AS message,
    CASE WHEN good THEN 'info' ELSE 'error' END AS severity, {entries_sql('Metrics', auc_roc='CAST(auc AS VARCHAR)')} AS m,
    {entries_sql('Metadata', alert_type="'training'", status="CASE WHEN good THEN 'success' ELSE 'failed' END")} AS d FROM r"""


@query("alert_log", f"""SELECT title, message, severity, TIMESTAMP '2024-01-31 00:00:00' AS ts, unnest(['slack','email']) AS channel, TRUE AS known,
    CASE severity WHEN 'info' THEN 'ℹ️' WHEN 'warning' THEN '⚠️' WHEN 'error' THEN '❌' ELSE '🚨' END || ' **' || title || E'**\\n\\n' || message
    || E'\\n\\n**Timestamp:** 2024-01-31 00:00:00\\n**Severity:** ' || upper(severity) || E'\\n' || m || d AS body
    FROM (SELECT * FROM ({DRIFT_RECORDS}) UNION ALL SELECT * FROM ({PERFORMANCE_RECORDS}) UNION ALL SELECT * FROM ({TRAINING_RECORDS}))""")
def _(spark, folder):
    """Drift, performance and training alerts as one table, routed to the enabled channels with their full messages."""
    indices = drift.csi(*sides(spark, folder), PANEL_FEATURES).withColumn("csi", F.round(F.col("csi") * 20, 4))
    metrics = to_long(classification_metrics(panel(spark, folder)), [m for m, _ in EXPECTED])
    per_fold = classification_metrics(panel(spark, folder), by=["fold"])
    runs = per_fold.select(
        F.concat(F.lit("run-"), F.col("fold").cast("string")).alias("run_id"),
        F.when(F.col("auc_roc") >= 0.85, "success").otherwise("failed").alias("status"),
        F.create_map(F.lit("auc_roc"), F.round("auc_roc", 4)).alias("metrics"),
    )
    records = alerting.alert_records([
        alerting.drift_alerts(indices),
        alerting.performance_alerts(
            metrics.withColumn("value", F.round("value", 4)), spark.createDataFrame(EXPECTED, "metric string, value double")
        ),
        alerting.training_alerts(runs),
    ], F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    return alerting.route(alerting.with_bodies(records), channels(spark)).drop("metrics", "metadata")


@query("alert_routing", f"WITH {ALERTS_SQL} SELECT alert_id, unnest(['slack','email']) AS channel, TRUE AS known FROM al WHERE severity='critical'")
def _(spark, folder):
    return alerting.route(alerts(spark, folder).where("severity = 'critical'").select("alert_id"), channels(spark))


@query("alert_routing_asked_channels", f"WITH {ALERTS_SQL} SELECT alert_id, unnest(['teams','pager']) AS channel, unnest([TRUE,FALSE]) AS known FROM al")
def _(spark, folder):
    return alerting.route(alerts(spark, folder).select("alert_id"), channels(spark), ["teams", "pager"])


@query("metric_rule_breaches", rounded_sql(
    ["value"], """SELECT metric, value, minimum, severity FROM cu JOIN (SELECT unnest(['auc_roc','ks_statistic','recall']) AS metric,
    unnest([0.75e0,0.3e0,0.7e0]) AS minimum, unnest(['error','error','warning']) AS severity) USING (metric) WHERE value<minimum""",
    ctes=f"{point_ctes('app')}, {cells_sql('app', '[0.5e0]')}, {CURRENT_SQL}",
))
def _(spark, folder):
    metrics = to_long(classification_metrics(panel(spark, folder), [0.5]), ["auc_roc", "ks", "recall", "precision"])
    return rounded(alerting.rule_breaches(metrics))


@query("suppressed_repeats", f"""WITH {ALERTS_SQL} SELECT alert_id, ts, key, severity FROM
    (SELECT *, lag(ts) OVER (PARTITION BY key ORDER BY ts, alert_id) AS before FROM al) WHERE before IS NULL OR ts-before>=INTERVAL 60 MINUTE""")
def _(spark, folder):
    return plain_time(alerting.suppress_repeats(alerts(spark, folder)))


@query("suppressed_repeats_by_severity", f"""WITH {ALERTS_SQL} SELECT alert_id, ts, key, severity FROM
    (SELECT *, lag(ts) OVER (PARTITION BY severity ORDER BY ts, alert_id) AS before FROM al) WHERE before IS NULL OR ts-before>=INTERVAL 15 MINUTE""")
def _(spark, folder):
    return plain_time(alerting.suppress_repeats(alerts(spark, folder), key=["severity"], minutes=15))


@query("rate_limited_alerts", f"""WITH {ALERTS_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, alert_id) AS r FROM al),
    d AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, alert_id) AS s FROM h WHERE r<=10)
    SELECT alert_id, ts, key, severity FROM d WHERE s<=50""")
def _(spark, folder):
    return plain_time(alerting.limit_rate(alerts(spark, folder)))


@query("quiet_hours", f"""WITH {ALERTS_SQL} SELECT alert_id, ts, key, severity FROM al
    WHERE severity='critical' OR (hour(ts-INTERVAL 6 HOUR)>=8 AND hour(ts-INTERVAL 6 HOUR)<22)""")
def _(spark, folder):
    return plain_time(alerting.quiet_filter(alerts(spark, folder)))


@query("escalations", f"""WITH {ALERTS_SQL}, a AS (SELECT * FROM al WHERE severity='critical'), r AS (SELECT key, ts FROM al WHERE severity='warning')
    SELECT alert_id, ts, key, severity, ts+INTERVAL 4 HOUR AS escalate_at, 'critical' AS escalated_to FROM a
    WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.key=a.key AND r.ts>a.ts AND r.ts<=a.ts+INTERVAL 4 HOUR)""")
def _(spark, folder):
    rows = alerts(spark, folder)
    solved = rows.where("severity = 'warning'").select("key", "ts")
    return plain_time(alerting.escalations(rows.where("severity = 'critical'"), solved))




@query("reject_share_alerts", f"""WITH d AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, value>=50 AS rejected FROM events)
    SELECT window_start, window_start+INTERVAL 6 HOUR AS window_end, count(*) AS n, round(100*avg(CAST(rejected AS INT)),6) AS reject_percent
    FROM d GROUP BY window_start HAVING 100*avg(CAST(rejected AS INT))>30""")
def _(spark, folder):
    scored = requests(spark, folder).withColumn("score", F.col("latency_ms") / 100.0)
    decided = with_decisions(scored, keep=["ts"])
    return rounded(plain_time(alerting.reject_share_alerts(decided)))


@query("error_rate_alerts", """WITH d AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS window_start, event_type='error' AS failed FROM events)
    SELECT window_start, window_start+INTERVAL 15 MINUTE AS window_end, count(*) AS n, round(avg(CAST(failed AS INT)),6) AS error_rate
    FROM d GROUP BY window_start HAVING avg(CAST(failed AS INT))>0.05""")
def _(spark, folder):
    return rounded(plain_time(alerting.error_rate_alerts(requests(spark, folder), F.col("event_type") == "error")))


@query("request_counters", """SELECT CASE WHEN user_id%2=0 THEN 'GET' ELSE 'POST' END AS method, event_type AS endpoint,
    CAST(CASE WHEN event_type='error' THEN 500 ELSE 200 END AS INT) AS status, count(*) AS requests FROM events GROUP BY 1, 2, 3""")
def _(spark, folder):
    log = requests(spark, folder).select(
        F.when(F.col("user_id") % 2 == 0, "GET").otherwise("POST").alias("method"), F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
    )
    return operations.request_counts(log)


@query("prediction_counters", "SELECT CASE WHEN event_type='purchase' THEN 'batch' ELSE 'single' END AS mode, count(*) AS predictions FROM events GROUP BY 1")
def _(spark, folder):
    mode = F.when(F.col("event_type") == "purchase", "batch").otherwise("single")
    return operations.prediction_counts(requests(spark, folder).withColumn("mode", mode))


Q = {p: quantile_sql("list_sort(list(value))", s) for p, s in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))}


@query("latency_report", f"""SELECT event_type, n, round(p50,6) AS p50, round(p95,6) AS p95, round(p99,6) AS p99, p50<100 AND p95<200 AND p99<500 AS within_targets
    FROM (SELECT event_type, count(*) AS n, {", ".join(f"{e} AS {p}" for p, e in Q.items())} FROM events GROUP BY event_type)""")
def _(spark, folder):
    return rounded(operations.latency_report(requests(spark, folder), ["event_type"]))


@query("latency_report_per_day", f"""SELECT "day", n, round(p50,6) AS p50, round(p95,6) AS p95, round(p99,6) AS p99, p50<100 AND p95<200 AND p99<500 AS within_targets
    FROM (SELECT strftime(ts, '%Y-%m-%d') AS "day", count(*) AS n, {", ".join(f"{e} AS {p}" for p, e in Q.items())} FROM events GROUP BY 1)""")
def _(spark, folder):
    log = requests(spark, folder).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rounded(operations.latency_report(log, ["day"]))


@query("throughput", """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n, round(count(*)/86400e0,6) AS per_second,
    count(*)/86400e0>10 AS rate_met, count(*)>1000 AS daily_met FROM events GROUP BY 1""")
def _(spark, folder):
    return rounded(plain_time(operations.throughput(requests(spark, folder))))


WEEKLY = """w AS (SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, value, value/100e0 AS score FROM events),
  a AS (SELECT week, avg(value) AS avg_latency, CAST(count(*) AS DOUBLE) AS total_predictions, avg(CAST(score>0.5e0 AS INT)) AS high_risk_share,
    avg(score) AS mean_score, avg(CAST(score<0.2e0 AS INT)) AS approval_share FROM w GROUP BY week)"""


@query("weekly_report", f"""WITH {WEEKLY}, {grouped_psi_ctes("w", "week", "week='2024-01-01'", ["value"])}
    SELECT grp AS week, 'drift' AS section, 'latency_ms' AS metric, round(psi,6) AS value FROM gp UNION ALL SELECT week, unnest(['service','service','proxies','proxies','proxies']) AS section,
    unnest(['avg_latency','total_predictions','high_risk_share','mean_score','approval_share']) AS metric,
    round(unnest([avg_latency,total_predictions,high_risk_share,mean_score,approval_share]),6) AS value FROM a""")
def _(spark, folder):
    log = requests(spark, folder).withColumn("score", F.col("latency_ms") / 100.0)
    proxies = drift.monitor_proxies(log.withColumn("week", F.date_trunc("week", "ts")), ["week"])
    weeks = log.withColumn("week", F.date_trunc("week", "ts"))
    first = weeks.where(F.col("week") == F.lit("2024-01-01").cast("timestamp"))
    report = operations.weekly_report(log, proxies, drift.indices_by(first, weeks, ["latency_ms"], ["week"]))
    return rounded(report.withColumn("week", F.date_format("week", "yyyy-MM-dd")))


AUDIT = """au AS (SELECT ID, score, TIMESTAMP '2024-01-01'-to_days(CAST((ID%1000) AS INT)) AS ts FROM app)"""


def audited(spark, folder):
    app = panel(spark, folder)
    at = F.date_sub(F.lit("2024-01-01").cast("date"), (F.col("ID") % 1000).cast("int")).cast("timestamp")
    answered = with_online_response(app.withColumn("at", at), keep=["ID", "AGE", "LIMIT_BAL", "at"], at=at)
    return operations.audit_records(answered, ["AGE", "LIMIT_BAL"], F.col("at"), F.col("ID"), latency=F.col("AGE").cast("double"))


@query("audit_records", f"""WITH {APP} SELECT CAST(ID AS VARCHAR) AS request_id, AGE, LIMIT_BAL, round(score,4) AS probability,
    CASE WHEN score>=0.12e0 THEN 'DEFAULT' ELSE 'NO_DEFAULT' END AS prediction,
    CASE WHEN score<0.2e0 THEN 'APROBADO' WHEN score<0.5e0 THEN 'REVISION' ELSE 'RECHAZO' END AS risk_band, CAST(AGE AS DOUBLE) AS latency_ms FROM app""")
def _(spark, folder):
    schema = ("request_id string, input struct<AGE int, LIMIT_BAL double>, latency_ms double,"
              " prediction struct<probability double, prediction string, risk_band string>")
    back = operations.read_audit(audited(spark, folder), schema)
    return back.select("request_id", "input.*", "prediction.*", "latency_ms")


@query("audit_retention", f"WITH {APP}, {AUDIT} SELECT ts FROM au WHERE ts>=TIMESTAMP '2022-01-01'")
def _(spark, folder):
    kept = operations.retained(audited(spark, folder), F.lit("2024-01-01").cast("timestamp"))
    return plain_time(kept.select("ts"))


@query("audit_expiry", f"WITH {APP}, {AUDIT} SELECT ts, count(*) AS n FROM au WHERE ts>=TIMESTAMP '2022-01-01' GROUP BY ts")
def _(spark, folder):
    """The stored log, one folder per day, after the days past the retention period were removed."""
    path = scratch_path(spark, "audit")
    operations.save_audit(audited(spark, folder), path)
    operations.expire_audit(spark, path, datetime(2024, 1, 1))
    return plain_time(operations.read_audit_log(spark, path).groupBy("ts").agg(F.count(F.lit(1)).alias("n")))


@query("order_line_drift_alerts", f"""WITH {item_psi(ITEM_FEATURES)} SELECT feature, round(psi,6) AS csi,
    CASE WHEN psi<0.1e0 THEN 'OK' WHEN psi<0.25e0 THEN 'WARNING' ELSE 'CRITICAL' END AS status FROM psi""")
def _(spark, folder):
    rows = drift.csi(*item_sides(spark, folder), ITEM_FEATURES)
    status = drift.feature_report(rows).select("feature", "status")
    return rounded(rows.join(status, "feature").select("feature", "csi", "status"))
