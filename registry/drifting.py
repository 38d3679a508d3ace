"""Population and feature drift, reports and monitors."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.cleaning import long_sql, psi_ctes
from registry.common import APP, ITEMS, labelled_documents, panel, quantile_sql, quantiles_sql, query, rounded, rounded_sql, scored_items
from registry.metrics import RATES, cells_sql, items_sql, point_ctes
from riskloom import vocab as v
from riskloom.operators import classifier, drift, profiles, ranking
from riskloom.plans.monitoring import drift_report, monitoring_run, report_json
from riskloom.runtime import pin, scratch_path
from riskloom.sources.files import append_report, latest_report

CUT = "TIMESTAMP '1998-06-01'"
ITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PANEL_FEATURES = v.RAW_FEATURES


def sides(spark, folder):
    app = pin(panel(spark, folder))  # derived by joins and read several times, so written once
    return app.where("period = 0"), app.where("period = 1")


def item_sides(spark, folder):
    items = scored_items(spark, folder)
    late = F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz")
    return items.where(~late), items.where(late)


def item_psi(columns, eps="0.0001e0"):
    return f"{ITEMS}, x AS ({long_sql(columns, 'items', f'CAST(l_shipdate>={CUT} AS INT)')}), {psi_ctes('x', eps)}"


SIZES = "(SELECT count(*) FROM x WHERE side=0) AS n_expected, (SELECT count(*) FROM x WHERE side=1) AS n_actual"


@query("psi_scores", f"WITH {APP}, x AS ({long_sql(['score'])}), {psi_ctes('x')} SELECT round(psi,6) AS psi, {SIZES} FROM psi")
def _(spark, folder):
    return rounded(drift.psi(*sides(spark, folder)))


@query("psi_service_epsilon", f"WITH {APP}, x AS ({long_sql(['PAY_AMT1'])}), {psi_ctes('x', '1e-06')} SELECT round(psi,6) AS psi, {SIZES} FROM psi")
def _(spark, folder):
    return rounded(drift.psi(*sides(spark, folder), "PAY_AMT1", eps=v.SERVICE_PSI_EPSILON))


@query("csi_order_lines", f"WITH {item_psi(ITEM_FEATURES)} SELECT feature, round(psi,6) AS csi FROM psi")
def _(spark, folder):
    return rounded(drift.csi(*item_sides(spark, folder), ITEM_FEATURES))


PANEL_PSI = f"x AS ({long_sql(PANEL_FEATURES)}), {psi_ctes('x')}"


@query("csi_all_features", f"WITH {APP}, {PANEL_PSI} SELECT feature, round(psi,6) AS csi FROM psi UNION ALL SELECT 'absent_feature', 0e0")
def _(spark, folder):
    reference, production = sides(spark, folder)
    production = production.withColumn("absent_feature", F.lit(1.0))
    asked = [*PANEL_FEATURES, "absent_feature", "nowhere"]
    return rounded(drift.csi(reference, production, asked))


STATUS = "CASE WHEN psi<0.1e0 THEN 'OK' WHEN psi<0.25e0 THEN 'WARNING' ELSE 'CRITICAL' END"


@query("feature_monitoring", f"WITH {APP}, {PANEL_PSI} SELECT feature, round(psi,4) AS csi, {STATUS} AS status, psi>=0.1e0 AS drifted FROM psi")
def _(spark, folder):
    return drift.feature_report(drift.csi(*sides(spark, folder), PANEL_FEATURES))


@query("drifted_features", f"""WITH {APP}, {PANEL_PSI} SELECT coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (psi>=0.02e0), '') AS drifted_features,
    count(*) FILTER (psi>=0.02e0) AS drifted_count FROM psi""")
def _(spark, folder):
    report = drift.feature_report(drift.csi(*sides(spark, folder), PANEL_FEATURES), warning=0.02)
    return drift.drifted_features(report).withColumn("drifted_features", F.array_join("drifted_features", ","))


@query("top_drifted_features", f"WITH {APP}, {PANEL_PSI} SELECT feature, round(psi,6) AS csi FROM psi ORDER BY psi DESC, feature LIMIT 10")
def _(spark, folder):
    return rounded(ranking.top_rows(drift.csi(*sides(spark, folder), PANEL_FEATURES), "csi", 10, "feature"))


def ks_ctes(source: str, side: str, value: str) -> str:
    return f"""s0 AS (SELECT CAST({value} AS DOUBLE) AS score, CAST({side} AS INT) AS default_flag FROM {source}), {point_ctes('s0')},
    ks AS (SELECT max(abs(tpr-fpr)) AS ks, max(nt) AS n_reference, max(pt) AS n_production FROM cut)"""


@query("two_sample_ks", f"WITH {APP}, {ks_ctes('app', 'period', 'BILL_AMT1')} SELECT round(ks,6) AS ks, n_reference, n_production FROM ks")
def _(spark, folder):
    return rounded(drift.two_sample_ks(*sides(spark, folder), "BILL_AMT1"))


@query("two_sample_ks_order_lines", f"WITH {ITEMS}, {ks_ctes('items', f'l_shipdate>={CUT}', 'l_extendedprice')} SELECT round(ks,6) AS ks, n_reference, n_production FROM ks")
def _(spark, folder):
    return rounded(drift.two_sample_ks(*item_sides(spark, folder), "l_extendedprice"))


@query("ks_p_value", f"""WITH {APP}, {ks_ctes('app', 'period', 'BILL_AMT1')}, t AS (SELECT *, ks*sqrt(CAST(n_reference AS DOUBLE)*n_production/(n_reference+n_production)) AS z FROM ks),
    p AS (SELECT *, CASE WHEN z<0.2e0 THEN 1e0 ELSE greatest(0e0, least(1e0, (SELECT 2*sum(CASE WHEN k%2=1 THEN 1e0 ELSE -1e0 END*exp(-2e0*k*k*z*z)) FROM range(1,101) r(k)))) END AS p_value FROM t)
    SELECT round(ks,6) AS ks, n_reference, n_production, round(p_value,6) AS p_value,
      CASE WHEN p_value<0.01e0 THEN 'severe' WHEN p_value<0.05e0 THEN 'drift' ELSE 'none' END AS p_status FROM p""")
def _(spark, folder):
    return rounded(drift.with_ks_p_value(drift.two_sample_ks(*sides(spark, folder), "BILL_AMT1")))


BOTH = "ref AS (SELECT * FROM app WHERE period=0), prod AS (SELECT * FROM app WHERE period=1)"


@query("baseline_ks", rounded_sql(["baseline", "compat_baseline"], "SELECT ks_two_sided AS baseline, 1e0 AS compat_baseline FROM om", ctes=f"{BOTH}, {point_ctes('ref')}"))
def _(spark, folder):
    reference, _ = sides(spark, folder)
    compat = drift.baseline_ks(reference, compat=True).withColumnRenamed("baseline", "compat_baseline")
    return rounded(drift.baseline_ks(reference).crossJoin(F.broadcast(compat)))


def ks_of(source: str) -> str:
    return f"(WITH {point_ctes(source)} SELECT ks_two_sided FROM om)"


DECAY = f"d AS (SELECT *, (baseline-\"current\")/baseline AS ks_decay FROM (SELECT {ks_of('ref')} AS baseline, {ks_of('prod')} AS \"current\"))"


@query("ks_decay", rounded_sql(["baseline", "current", "ks_decay"], "SELECT *, CASE WHEN ks_decay>0.1e0 THEN 'ALERT' ELSE 'OK' END AS ks_status FROM d", ctes=f"{BOTH}, {DECAY}"))
def _(spark, folder):
    reference, production = sides(spark, folder)
    current = drift.baseline_ks(production).withColumnRenamed("baseline", "current")
    return rounded(drift.with_ks_decay(drift.baseline_ks(reference).crossJoin(F.broadcast(current))))


MEDIAN = quantile_sql("list_sort(list(score))", 0.5)
STATS = ", ".join(
    f"(SELECT {e} FROM {t}) AS {n}_{side}"
    for n, e in (("mean", "avg(score)"), ("std", "stddev_pop(score)"), ("median", MEDIAN))
    for t, side in (("ref", "reference"), ("prod", "production"))
)
STAT_NAMES = [f"{n}_{s}" for n in ("mean", "std", "median") for s in ("reference", "production")]


@query("score_statistics", rounded_sql(STAT_NAMES, f"SELECT {STATS}", ctes=BOTH))
def _(spark, folder):
    return rounded(drift.score_stats(*sides(spark, folder)))


SCORE_PSI = f"x AS ({long_sql(['score'])}), {psi_ctes('x')}"
ALERTS = """CASE WHEN psi_status='WARNING' THEN printf('PSI moderado (%.3f): Investigar distribución de scores', round(psi,4)) || ';' ELSE '' END
  || CASE WHEN psi_status='CRITICAL' THEN printf('PSI crítico (%.3f): Considerar reentrenamiento', round(psi,4)) || ';' ELSE '' END
  || CASE WHEN ks_status='ALERT' THEN printf('KS decay significativo (%.1f%%): Rendimiento degradado', round(ks_decay,4)*100) || ';' ELSE '' END"""
MONITOR = f"""mon AS (SELECT *, CASE WHEN ks_decay>0.1e0 THEN 'ALERT' ELSE 'OK' END AS ks_status FROM
  (SELECT psi, (SELECT count(*) FROM prod) AS n_samples, {STATUS} AS psi_status FROM psi), (SELECT {STATS}), d)"""


@query("score_monitoring", rounded_sql(["psi", *STAT_NAMES, "baseline", "current", "ks_decay"], f"SELECT *, {ALERTS} AS alerts FROM mon",
                                       ctes=f"{BOTH}, {SCORE_PSI}, {DECAY}, {MONITOR}"))
def _(spark, folder):
    row = drift.monitor_scores(*sides(spark, folder), label=v.TARGET)
    return rounded(row.withColumn("alerts", F.array_join(F.transform("alerts", lambda a: F.concat(a, F.lit(";"))), "")))


REPORT = f"""rep AS (SELECT mon.*, dc.drifted_count, CASE WHEN psi_status='CRITICAL' OR ks_status='ALERT' THEN 'CRITICAL'
    WHEN psi_status='WARNING' OR dc.drifted_count>3 THEN 'WARNING' ELSE 'HEALTHY' END AS overall_status FROM mon, dc)"""
RECOMMEND = """CASE overall_status WHEN 'CRITICAL' THEN 'Reentrenamiento urgente recomendado. Considerar rollback a versión anterior.'
    WHEN 'WARNING' THEN 'Investigar causas del drift. Preparar datos para potencial reentrenamiento.' ELSE 'Modelo estable. Continuar monitoreo regular.' END"""
REPORT_SQL = f"""WITH {APP}, {BOTH}, {SCORE_PSI}, {DECAY}, {MONITOR},
    dc AS (SELECT (WITH y AS ({long_sql(PANEL_FEATURES)}), {psi_ctes('y')} SELECT count(*) FILTER (psi>=0.1e0) FROM psi) AS drifted_count), {REPORT}
    SELECT n_samples, round(psi,6) AS psi, psi_status, round(ks_decay,6) AS ks_decay, ks_status, drifted_count, overall_status, {RECOMMEND} AS recommendation FROM rep"""
REPORT_COLUMNS = ["n_samples", "psi", "psi_status", "ks_decay", "ks_status", "drifted_count", "overall_status", "recommendation"]


@query("drift_report", REPORT_SQL)
def _(spark, folder):
    return rounded(drift_report(*sides(spark, folder), PANEL_FEATURES, label=v.TARGET).select(*REPORT_COLUMNS))


@query("monitoring_run_with_stand_in", REPORT_SQL)
def _(spark, folder):
    reference, held_out = sides(spark, folder)
    path = scratch_path(spark, "monitoring")
    labels = held_out.select("ID", v.TARGET)
    report = monitoring_run(reference, None, PANEL_FEATURES, stand_in=held_out, labels=labels)
    append_report(report_json(report), path)
    fields = "n_samples bigint, psi double, psi_status string, ks_decay double, ks_status string, drifted_count bigint, overall_status string, recommendation string"
    stored = latest_report(spark.read.parquet(path))
    return rounded(stored.select(F.from_json("report", fields).alias("r")).select("r.*"))


@query("service_drift_check", f"""WITH {APP}, {SCORE_PSI}, {ks_ctes('app', 'period', 'score')}
    SELECT CASE WHEN psi<0.1e0 THEN 'ok' WHEN psi<0.25e0 THEN 'warning' ELSE 'critical' END AS status, round(psi,4) AS psi,
    round(ks,4) AS ks_statistic, n_reference AS reference_size, n_production AS current_size FROM psi, ks""".replace("0.0001e0", "1e-06"))
def _(spark, folder):
    return drift.service_check(*sides(spark, folder))


def _equal_width(table: str, name: str) -> str:
    return f"""{name} AS (SELECT least(CAST(floor((l_quantity-lo)/((hi-lo)/10)) AS INT), 9) AS bin, count(*) AS n
      FROM {table}, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM {table}) GROUP BY 1)"""


@query("equal_width_psi", f"""WITH {ITEMS}, a0 AS (SELECT * FROM items WHERE l_shipdate<{CUT}), a1 AS (SELECT * FROM items WHERE l_shipdate>={CUT}),
    {_equal_width('a0', 'h0')}, {_equal_width('a1', 'h1')}, s AS (SELECT h0.n/CAST((SELECT sum(n) FROM h0) AS DOUBLE) AS e, h1.n/CAST((SELECT sum(n) FROM h1) AS DOUBLE) AS a FROM h0 JOIN h1 USING (bin))
    SELECT round(sum((e-a)*ln(e/a)),6) AS psi FROM s""")
def _(spark, folder):
    return rounded(drift.equal_width_psi(*item_sides(spark, folder), "l_quantity"))


PROXY = ["high_risk_share", "mean_score", "approval_share"]
PROXY_SQL = """SELECT {by} count(*) AS n, avg(CAST(score>0.5e0 AS INT)) AS high_risk_share, avg(score) AS mean_score, avg(CAST(score<0.2e0 AS INT)) AS approval_share FROM {source} {group}"""
PROXY_ALERTS = """CASE WHEN high_risk_share<0.15e0 OR high_risk_share>0.3e0 THEN 'high_risk_share;' ELSE '' END
    || CASE WHEN mean_score<0.15e0 OR mean_score>0.35e0 THEN 'mean_score;' ELSE '' END
    || CASE WHEN approval_share<0.25e0 OR approval_share>0.55e0 THEN 'approval_share;' ELSE '' END AS alerts"""


def joined_alerts(df):
    return df.withColumn("alerts", F.array_join(F.transform("alerts", lambda a: F.concat(a, F.lit(";"))), ""))


@query("proxy_monitors_by_month", items_sql(
    PROXY, f"SELECT *, {PROXY_ALERTS} FROM (" + PROXY_SQL.format(by="strftime(l_shipdate, '%Y-%m') AS \"month\",", source="items", group="GROUP BY 1") + ")",
))
def _(spark, folder):
    items = scored_items(spark, folder).withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    return rounded(joined_alerts(drift.monitor_proxies(items, ["month"])))


GATES = "gates AS (SELECT unnest(['auc_roc','ks','brier','recall','precision']) AS metric, unnest(['<','<','>','<','<']) AS op, unnest([0.75e0,0.35e0,0.18e0,0.8e0,0.25e0]) AS bound)"


@query("performance_gates_by_month", f"""WITH {ITEMS}, m AS (SELECT *, strftime(l_shipdate, '%Y-%m') AS "month" FROM items), {point_ctes('m', '"month"')}, {cells_sql('m', '[0.12e0]', '"month"')}, {GATES},
    w AS (SELECT "month", auc_roc, ks, brier, {RATES['recall']} AS recall, {RATES['precision']} AS precision FROM om JOIN cells USING ("month")),
    l AS (SELECT "month", unnest(['auc_roc','ks','brier','recall','precision']) AS metric, unnest([auc_roc,ks,brier,recall,precision]) AS value FROM w)
    SELECT "month", metric, round(value,6) AS value, op, bound, CASE op WHEN '<' THEN value<bound ELSE value>bound END AS alert FROM l JOIN gates USING (metric)""")
def _(spark, folder):
    items = scored_items(spark, folder).withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    return rounded(drift.monitor_performance(items, ["month"]))


@query("retrain_trigger", f"""WITH {APP}, {BOTH}, {SCORE_PSI}, {DECAY}, {point_ctes('prod')} SELECT round(psi,6) AS psi, round(auc_roc,6) AS auc_roc, round(ks_decay,6) AS ks_decay,
    (CASE WHEN psi>0.25e0 THEN 'psi;' ELSE '' END || CASE WHEN auc_roc<0.75e0 THEN 'auc_roc;' ELSE '' END || CASE WHEN ks_decay>0.1e0 THEN 'ks_decay;' ELSE '' END) AS reasons,
    (psi>0.25e0 OR auc_roc<0.75e0 OR ks_decay>0.1e0) AS retrain FROM psi, d, om""")
def _(spark, folder):
    reference, production = sides(spark, folder)
    row = drift.psi(reference, production).select("psi")
    row = row.crossJoin(F.broadcast(classifier.ranking_metrics(production).select("auc_roc")))
    current = drift.baseline_ks(production).withColumnRenamed("baseline", "current")
    decay = drift.with_ks_decay(drift.baseline_ks(reference).crossJoin(F.broadcast(current))).select("ks_decay")
    made = drift.retrain_trigger(row.crossJoin(F.broadcast(decay)))
    return rounded(made.withColumn("reasons", F.array_join(F.transform("reasons", lambda a: F.concat(a, F.lit(";"))), "")))


@query("proxy_monitors_documents", f"SELECT * FROM ({PROXY_SQL}) ORDER BY 1".format(by="lang,", source="d", group="GROUP BY lang").replace(
    "SELECT * FROM (SELECT", "WITH d AS (SELECT lang, round(CAST(1000 AS DOUBLE)/(n_chars+CAST(1000 AS DOUBLE)),4) AS score FROM documents JOIN labels USING (doc_id)) "
    "SELECT lang, n, round(high_risk_share,6) AS high_risk_share, round(mean_score,6) AS mean_score, round(approval_share,6) AS approval_share FROM (SELECT", 1))
def _(spark, folder):
    return rounded(drift.monitor_proxies(labelled_documents(spark, folder), ["lang"]).drop("alerts"))


def grouped_psi_ctes(source: str, group: str, reference: str, columns) -> str:
    """CTE ``gp`` (grp, feature, psi): each group of ``source`` against the rows where ``reference`` holds."""
    rows = " UNION ALL ".join(
        f"SELECT {group} AS grp, {reference} AS is_ref, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {source}" for c in columns
    )
    return f"""gx AS ({rows}), ge AS (SELECT feature, {quantiles_sql("l", [i / 10 for i in range(1, 10)])} AS edges FROM
      (SELECT feature, list_sort(list(value)) AS l FROM gx WHERE is_ref GROUP BY feature)),
    gb AS (SELECT gx.*, len(list_filter(edges, lambda q: q<=value)) AS bin FROM gx JOIN ge USING (feature)),
    gr AS (SELECT feature, r.range AS bin, (SELECT count(*) FROM gb WHERE is_ref AND gb.feature=ge.feature AND gb.bin=r.range) AS ne FROM ge, range(10) r),
    ga AS (SELECT grp, feature, bin, count(*) AS na FROM gb GROUP BY ALL),
    gc AS (SELECT g.grp, gr.feature, gr.bin, ne, coalesce(na, 0) AS na FROM (SELECT DISTINCT grp FROM gb) g CROSS JOIN gr
      LEFT JOIN ga ON ga.grp=g.grp AND ga.feature=gr.feature AND ga.bin=gr.bin),
    gs AS (SELECT grp, feature, (ne+0.0001e0)/sum(ne) OVER (PARTITION BY grp, feature) AS pe, (na+0.0001e0)/sum(na) OVER (PARTITION BY grp, feature) AS pa, ne, na FROM gc),
    gp AS (SELECT grp, feature, sum((pa-pe)*ln(pa/pe)) AS psi, CAST(sum(ne) AS BIGINT) AS n_expected, CAST(sum(na) AS BIGINT) AS n_actual FROM gs GROUP BY grp, feature)"""


@query("csi_by_month", f"""WITH {ITEMS}, {grouped_psi_ctes("items", "strftime(l_shipdate, '%Y-%m')", f"l_shipdate<{CUT}", ["l_quantity", "l_extendedprice"])}
    SELECT grp AS "month", feature, round(psi,6) AS psi, n_expected, n_actual FROM gp""")
def _(spark, folder):
    items = scored_items(spark, folder).withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    reference = items.where(F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp_ntz"))
    return rounded(drift.indices_by(reference, items, ["l_quantity", "l_extendedprice"], ["month"]))


@query("csi_from_stored_profile", f"WITH {APP}, {PANEL_PSI} SELECT feature, round(psi,6) AS csi FROM psi")
def _(spark, folder):
    reference, production = sides(spark, folder)
    path = scratch_path(spark, "profile")
    profiles.save_profile(profiles.exact_profile(reference, PANEL_FEATURES), path)
    rows = profiles.index_from_profile(profiles.load_profile(spark, path), production, PANEL_FEATURES)
    return rounded(rows.select("feature", F.col("psi").alias("csi")))


@query("csi_from_merged_sketches")
def _(spark, folder):
    """Order lines of each month sketched on their own, the months up to 1995 merged, the later ones compared."""
    items = scored_items(spark, folder).withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    path = scratch_path(spark, "sketches")
    profiles.save_profile(profiles.sketch_profile(items, ITEM_FEATURES, ["month"]), path, ["month"])
    kept = profiles.load_profile(spark, path).where("month < '1996'")
    later = items.where("month >= '1996'")
    return rounded(profiles.index_from_profile(profiles.binned(profiles.merged(kept)), later, ITEM_FEATURES))
