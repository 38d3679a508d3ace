"""Streaming forms, run over all available input and compared with the batch result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.alerts import ALERTS_SQL
from registry.cleaning import FAULTS_SQL
from registry.common import APP, panel, plain_time, quantiles_sql, query, rounded, rounded_sql, table
from registry.drifting import PROXY_ALERTS, joined_alerts
from riskloom.operators import drift
from riskloom.operators.calibration import edges_below
from riskloom.runtime import scratch_path
from riskloom.streaming import monitors, stateful


def event_stream(spark, folder):
    stream = monitors.read_table_stream(spark, f"{folder}/events.parque*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def alert_stream(spark, folder):
    kind = F.col("event_type")
    severity = F.when(kind == "error", "critical").when(kind == "purchase", "warning").when(kind == "view", "info").otherwise("error")
    return event_stream(spark, folder).select(
        F.col("event_id").alias("alert_id"), "ts", F.col("user_id").cast("string").alias("key"), severity.alias("severity")
    )


FIRST_WEEK = "ts<TIMESTAMP '2024-01-08'"


@query("stream_psi_per_day", f"""WITH e AS (SELECT {quantiles_sql('list_sort(list(value))', [i / 10 for i in range(1, 10)])} AS edges FROM events WHERE {FIRST_WEEK}),
    b AS (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, ts, CAST(len(list_filter(edges, lambda q: q<=value)) AS INT) AS bin FROM events, e),
    r AS (SELECT g.range AS bin, count(b.bin) AS ne FROM range(10) g LEFT JOIN (SELECT * FROM b WHERE {FIRST_WEEK}) b ON b.bin=g.range GROUP BY g.range),
    w AS (SELECT DISTINCT window_start FROM b),
    c AS (SELECT w.window_start, r.bin, ne, (SELECT count(*) FROM b WHERE b.window_start=w.window_start AND b.bin=r.bin) AS na FROM w, r),
    s AS (SELECT window_start, (ne+0.0001e0)/sum(ne) OVER (PARTITION BY window_start) AS pe, (na+0.0001e0)/sum(na) OVER (PARTITION BY window_start) AS pa,
      ne, na FROM c),
    t AS (SELECT window_start, sum((pa-pe)*ln(pa/pe)) AS psi, CAST(sum(ne) AS BIGINT) AS n_expected, CAST(sum(na) AS BIGINT) AS n_actual FROM s GROUP BY window_start)
    SELECT window_start, round(psi,6) AS psi, n_expected, n_actual, CASE WHEN psi<0.1e0 THEN 'OK' WHEN psi<0.25e0 THEN 'WARNING' ELSE 'CRITICAL' END AS status FROM t""")
def _(spark, folder):
    reference = table(spark, folder, "events").where(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz"))
    edges = drift.bin_edges(reference, ["value"]).first()["edges"]
    expected = reference.groupBy(edges_below(F.col("value"), edges, True).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_e"), F.lit(0).alias("_a")
    )
    reference_counts = drift.spread_over_bins(expected, [], 10)
    counts = monitors.run_windows(
        monitors.window_bin_counts(event_stream(spark, folder), edges, "value"), ["window_start", "window_end", "bin"]
    )
    return rounded(plain_time(monitors.psi_per_window(counts, reference_counts)))




@query("stream_proxies_per_day", f"""SELECT window_start, window_end, n, round(high_risk_share,6) AS high_risk_share, round(mean_score,6) AS mean_score,
    round(approval_share,6) AS approval_share, {PROXY_ALERTS} FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, date_trunc('day', ts)::TIMESTAMP+INTERVAL 1 DAY AS window_end,
    count(*) AS n, avg(CAST(value/100e0>0.5e0 AS INT)) AS high_risk_share, avg(value/100e0) AS mean_score, avg(CAST(value/100e0<0.2e0 AS INT)) AS approval_share
    FROM events GROUP BY 1, 2)""")
def _(spark, folder):
    stream = event_stream(spark, folder).withColumn("score", F.col("value") / 100.0)
    rows = monitors.run_windows(monitors.window_proxies(stream))
    return rounded(plain_time(joined_alerts(rows)))


@query("stream_error_rates", """SELECT window_start, window_start+INTERVAL 15 MINUTE AS window_end, count(*) AS n, round(avg(CAST(event_type='error' AS INT)),6) AS error_rate,
    avg(CAST(event_type='error' AS INT))>0.05 AS alert FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS window_start FROM events)
    GROUP BY window_start""")
def _(spark, folder):
    rows = monitors.window_error_rates(event_stream(spark, folder), F.col("event_type") == "error")
    return rounded(plain_time(monitors.run_windows(rows)))


@query("stream_error_rates_sliding", """SELECT window_start, window_start+INTERVAL 60 MINUTE AS window_end, count(*) AS n, round(avg(CAST(event_type='error' AS INT)),6) AS error_rate,
    avg(CAST(event_type='error' AS INT))>0.05 AS alert FROM (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01')-to_minutes(CAST(30*k.range AS INT)) AS window_start FROM events, range(2) k)
    GROUP BY window_start""")
def _(spark, folder):
    rows = monitors.window_error_rates(event_stream(spark, folder), F.col("event_type") == "error", width="60 minutes", slide="30 minutes")
    return rounded(plain_time(monitors.run_windows(rows)))


@query("stream_suppress_since_kept", f"""WITH RECURSIVE {ALERTS_SQL}, kept AS (
      SELECT key, min(ts) AS ts FROM al GROUP BY key
      UNION ALL SELECT k.key, (SELECT min(a.ts) FROM al a WHERE a.key=k.key AND a.ts>=k.ts+INTERVAL 60 MINUTE) AS ts FROM kept k
      WHERE EXISTS (SELECT 1 FROM al a WHERE a.key=k.key AND a.ts>=k.ts+INTERVAL 60 MINUTE))
    SELECT kept.key, min(alert_id) AS alert_id, kept.ts FROM kept JOIN al ON al.key=kept.key AND al.ts=kept.ts GROUP BY kept.key, kept.ts""")
def _(spark, folder):
    return plain_time(monitors.run_suppression(monitors.suppress_since_kept(alert_stream(spark, folder))))


@query("stream_drop_repeats")
def _(spark, folder):
    return plain_time(monitors.run_to_table(monitors.drop_repeats(alert_stream(spark, folder))))


@query("stream_rate_limit", f"""WITH {ALERTS_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY key, date_trunc('hour', ts) ORDER BY ts, alert_id) AS r FROM al),
    d AS (SELECT *, row_number() OVER (PARTITION BY key, date_trunc('day', ts) ORDER BY ts, alert_id) AS s FROM h WHERE r<=1) SELECT key, alert_id, ts FROM d WHERE s<=2""")
def _(spark, folder):
    rows = monitors.run_rate_limit(alert_stream(spark, folder), ["key"], per_hour=1, per_day=2)
    return plain_time(rows.select("key", "alert_id", "ts"))


@query("stream_escalations", """SELECT event_id AS alert_id, ts FROM events WHERE event_type='error' AND event_id%3<>0""")
def _(spark, folder):
    errors = event_stream(spark, folder).where("event_type = 'error'").select(F.col("event_id").alias("alert_id"), "ts")
    solved = event_stream(spark, folder).where("event_type = 'error' AND event_id % 3 = 0").select(
        F.col("event_id").alias("alert_id"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts")
    )
    return plain_time(monitors.run_escalations(errors, solved))


@query("stream_rate_limit_timers", f"""WITH {ALERTS_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY severity, date_trunc('hour', ts) ORDER BY ts, alert_id) AS r FROM al),
    d AS (SELECT *, row_number() OVER (PARTITION BY severity, date_trunc('day', ts) ORDER BY ts, alert_id) AS s FROM h WHERE r<=10) SELECT severity, alert_id, ts FROM d WHERE s<=50""")
def _(spark, folder):
    return plain_time(stateful.run_closed(lambda end: stateful.limit_rate(alert_stream(spark, folder), ["severity"], end=end), spark))


@query("stream_escalation_timers", """SELECT CAST(a.user_id AS VARCHAR) AS key, a.event_id AS alert_id, a.ts FROM events a WHERE a.event_type='error' AND NOT EXISTS (
    SELECT 1 FROM events r WHERE r.event_type<>'error' AND r.user_id=a.user_id AND r.ts>a.ts AND r.ts<=a.ts+INTERVAL 4 HOUR)""")
def _(spark, folder):
    stream = event_stream(spark, folder).select(F.col("event_id").alias("alert_id"), "ts", F.col("user_id").cast("string").alias("key"), "event_type")
    errors, others = stream.where("event_type = 'error'"), stream.where("event_type <> 'error'")
    return plain_time(stateful.run_closed(lambda end: stateful.escalate(errors, others, end=end), spark))


@query("stream_escalations_late", """SELECT event_id AS alert_id, ts FROM events WHERE event_type='error' AND event_id%4 IN (2, 3)""")
def _(spark, folder):
    """Resolutions after one hour, after four (in time), after five (late), and none."""
    errors = event_stream(spark, folder).where("event_type = 'error'").select(F.col("event_id").alias("alert_id"), "ts")
    after = F.element_at(F.array(*[F.lit(h) for h in (1, 4, 5)]), (F.col("alert_id") % 4 + 1).cast("int"))
    solved = errors.where("alert_id % 4 < 3").withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + after * 3_600_000_000))
    return plain_time(stateful.run_closed(lambda end: stateful.escalate_unanswered(errors, solved, end=end), spark))


def client_stream(spark, folder):
    path = scratch_path(spark, "applications")
    panel(spark, folder).write.parquet(path)
    return monitors.read_table_stream(spark, path)


@query("stream_decisions", rounded_sql(
    ["suggested_credit_limit_mxn"], """SELECT ID, score AS default_probability, CAST(score>=0.12e0 AS INT) AS default_prediction,
    CASE WHEN score<0.2e0 THEN 'APROBADO' WHEN score<0.5e0 THEN 'REVISION' ELSE 'RECHAZO' END AS risk_band,
    CASE WHEN score<0.2e0 THEN 50000e0*(1e0-score/0.2e0*0.2e0) WHEN score<0.5e0 THEN 50000e0*(0.6e0-(score-0.2e0)/0.3e0*0.2e0) ELSE 0e0 END AS suggested_credit_limit_mxn
    FROM f WHERE faults=''""", 4, FAULTS_SQL,
))
def _(spark, folder):
    decided, _ = monitors.decisions(client_stream(spark, folder))
    return rounded(monitors.run_to_table(decided), 4)


@query("stream_rejects", f"WITH {APP}, {FAULTS_SQL} SELECT ID, faults FROM f WHERE faults<>''")
def _(spark, folder):
    _, refused = monitors.decisions(client_stream(spark, folder))
    rows = monitors.run_to_table(refused)
    return rows.select("ID", F.concat(F.array_join("faults", ";"), F.lit(";")).alias("faults"))
