"""Sources, sinks, cleaning, validity and key joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import APP, panel, query, quantile_sql, quantiles_sql, rounded, rounded_sql, scored_items, table
from riskloom import vocab as v
from riskloom.functions.decisions import with_decisions
from riskloom.functions.features import align
from riskloom.operators import cleaning, drift, matching, splits, summaries, validity
from riskloom.operators.classifier import cell_metrics, classification_metrics, confusion, to_long
from riskloom.runtime import scratch_path
from riskloom.sources import files

CLIENT = [v.KEY] + v.RAW_FEATURES + [v.TARGET]
CLIENT_SQL = ", ".join(CLIENT)


def clients(spark, folder):
    return panel(spark, folder).select(*CLIENT)


@query("read_client_csv", f"WITH {APP} SELECT {CLIENT_SQL} FROM app")
def _(spark, folder):
    path = scratch_path(spark, "clients")
    clients(spark, folder).withColumnsRenamed({"PAY_0": "PAY_1", v.TARGET: "default payment next month"}).write.option(
        "header", True
    ).csv(path)
    return files.read_client_csv(spark, path)


@query("read_processed_before_raw", f"WITH {APP} SELECT {CLIENT_SQL} FROM app")
def _(spark, folder):
    path = scratch_path(spark, "clients")
    clients(spark, folder).write.parquet(path)
    return files.read_clients(spark, raw=f"{path}-absent", processed=path)


@query("standardize_columns", f"WITH {APP} SELECT {CLIENT_SQL} FROM app")
def _(spark, folder):
    messy = {"PAY_0": "PAY_1", "LIMIT_BAL": " LIMIT BAL ", v.TARGET: "default payment next month"}
    return cleaning.standardize_columns(clients(spark, folder).withColumnsRenamed(messy))


@query("parquet_and_csv_sink", f"WITH {APP} SELECT SEX, CAST(count(*) AS BIGINT) AS n, CAST(sum(AGE) AS BIGINT) AS ages FROM app GROUP BY SEX")
def _(spark, folder):
    path = scratch_path(spark, "table")
    files.save_table(clients(spark, folder), path, ["SEX"])
    stored = spark.read.parquet(f"{path}/parquet").select("ID", "SEX", "AGE")
    csv = spark.read.option("header", True).csv(f"{path}/csv").select(F.col("ID").cast("bigint").alias("ID"), F.col("AGE").cast("int").alias("age_csv"))
    return stored.join(csv, "ID").where("AGE = age_csv").groupBy("SEX").agg(
        F.count(F.lit(1)).alias("n"), F.sum("AGE").alias("ages")
    )


CONVERTED = ["customer", "orders", "part", "supplier", "nation"]


@query(
    "parquet_to_csv",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", 'converted' AS status, (SELECT count(*) FROM {t}) AS n_rows, "
        f"CAST((SELECT count(*) FROM (DESCRIBE {t})) AS INT) AS n_columns" for t in CONVERTED
    ) + " UNION ALL SELECT 'absent', 'missing', NULL, NULL",
)
def _(spark, folder):
    paths = {t: f"{folder}/{t}.parquet" for t in CONVERTED} | {"absent": f"{folder}/absent.parquet"}
    return files.parquet_to_csv(spark, paths, scratch_path(spark, "csv"))


@query(
    "split_table_sink",
    f"""WITH {APP}, c AS (SELECT default_flag, count(*) AS n, CAST(floor(count(*)*0.2e0+0.5e0) AS BIGINT) AS t FROM app GROUP BY default_flag)
    SELECT default_flag, 'test' AS split, t AS n FROM c UNION ALL SELECT default_flag, 'train', n-t FROM c""",
)
def _(spark, folder):
    path = scratch_path(spark, "split")
    files.save_split(splits.stratified_split(clients(spark, folder)), path)
    return spark.read.parquet(path).groupBy(v.TARGET, "split").agg(F.count(F.lit(1)).alias("n"))


PREDICTIONS = """p AS (SELECT ID, score AS default_probability, CAST(score>=0.12e0 AS INT) AS default_prediction,
  CASE WHEN score<0.2e0 THEN 'APROBADO' WHEN score<0.5e0 THEN 'REVISION' ELSE 'RECHAZO' END AS risk_band,
  CASE WHEN score<0.2e0 THEN 50000e0*(1e0-score/0.2e0*0.2e0)
       WHEN score<0.5e0 THEN 50000e0*(0.6e0-(score-0.2e0)/0.3e0*0.2e0) ELSE 0e0 END AS suggested_credit_limit_mxn,
  SEX, AGE, default_flag FROM app)"""

SUMMARY_DOUBLES = [
    "avg_default_probability", "median_default_probability", "std_default_probability", "default_rate",
    "pct_aprobado", "pct_revision", "pct_rechazo", "avg_credit_limit", "total_credit_exposure",
]
SUMMARY_SELECT = f"""count(*) AS total_predictions, avg(default_probability) AS avg_default_probability,
  stddev_samp(default_probability) AS std_default_probability,
  CAST(sum(default_prediction) AS BIGINT) AS total_defaults_predicted, avg(default_prediction) AS default_rate,
  count(*) FILTER (risk_band='APROBADO') AS count_aprobado, count(*) FILTER (risk_band='REVISION') AS count_revision,
  count(*) FILTER (risk_band='RECHAZO') AS count_rechazo,
  100e0*count(*) FILTER (risk_band='APROBADO')/count(*) AS pct_aprobado,
  100e0*count(*) FILTER (risk_band='REVISION')/count(*) AS pct_revision,
  100e0*count(*) FILTER (risk_band='RECHAZO')/count(*) AS pct_rechazo,
  avg(suggested_credit_limit_mxn) AS avg_credit_limit, sum(suggested_credit_limit_mxn) AS total_credit_exposure,
  {quantile_sql("list_sort(list(default_probability))", 0.5)} AS median_default_probability"""


@query("prediction_sink_with_summary", rounded_sql(SUMMARY_DOUBLES, f"SELECT {SUMMARY_SELECT} FROM p", 4, PREDICTIONS))
def _(spark, folder):
    path = scratch_path(spark, "predictions")
    predictions = with_decisions(panel(spark, folder))
    files.save_predictions(predictions, path, summaries.prediction_summary)
    return rounded(spark.read.parquet(f"{path}_summary"), 4)


CELLS_SQL = """cells AS (SELECT count(*) FILTER (score>=0.12e0 AND default_flag=1) AS tp,
  count(*) FILTER (score>=0.12e0 AND default_flag=0) AS fp, count(*) FILTER (score<0.12e0 AND default_flag=1) AS fn,
  count(*) FILTER (score<0.12e0 AND default_flag=0) AS tn FROM app)"""


@query(
    "metric_json_sink",
    f"""WITH {APP}, {CELLS_SQL} SELECT metric, round(value,6) AS value FROM (
    SELECT unnest(['recall','precision','accuracy']) AS metric,
      unnest([tp/CAST(tp+fn AS DOUBLE), tp/CAST(tp+fp AS DOUBLE), (tp+tn)/CAST(tp+fp+fn+tn AS DOUBLE)]) AS value FROM cells)""",
)
def _(spark, folder):
    path = scratch_path(spark, "metrics")
    files.save_json(to_long(classification_metrics(panel(spark, folder)), ["recall", "precision", "accuracy"]), path)
    return rounded(spark.read.schema("metric string, value double").json(path))


def psi_ctes(values: str, eps: str = "0.0001e0") -> str:
    """CTEs from rows (feature, side, value) named ``values`` to ``psi`` rows (feature, psi)."""
    edges = quantiles_sql("l", [i / 10 for i in range(1, 10)])
    return f"""
    e AS (SELECT feature, {edges} AS edges FROM (SELECT feature, list_sort(list(value)) AS l FROM {values} WHERE side=0 GROUP BY feature)),
    b AS (SELECT x.feature, side, len(list_filter(edges, lambda q: q<=value)) AS bin FROM {values} x JOIN e ON x.feature=e.feature),
    spine AS (SELECT feature, r.range AS bin FROM e, range(10) r),
    c AS (SELECT s.feature, s.bin, count(*) FILTER (side=0) AS ne, count(*) FILTER (side=1) AS na
          FROM spine s LEFT JOIN b ON b.feature=s.feature AND b.bin=s.bin GROUP BY s.feature, s.bin),
    sh AS (SELECT feature, (ne+{eps})/sum(ne) OVER (PARTITION BY feature) AS pe,
                  (na+{eps})/sum(na) OVER (PARTITION BY feature) AS pa FROM c),
    psi AS (SELECT feature, sum((pa-pe)*ln(pa/pe)) AS psi FROM sh GROUP BY feature)"""


def long_sql(columns, source="app", side="period") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {side} AS side, CAST(\"{c}\" AS DOUBLE) AS value FROM {source}" for c in columns
    )


HISTORY = ["score", "AGE", "BILL_AMT1"]


@query(
    "drift_report_history",
    f"""WITH {APP}, x AS ({long_sql(HISTORY)}), {psi_ctes("x")}
    SELECT feature, round(psi,6) AS csi, '2024-01-08' AS generated_on FROM psi""",
)
def _(spark, folder):
    app, path = panel(spark, folder), scratch_path(spark, "reports")
    old, new = app.where("period = 0"), app.where("period = 1")
    for at, production in (("2024-01-08", new), ("2024-01-01", old)):
        files.append_report(drift.csi(old, production, HISTORY), path, F.lit(at).cast("timestamp"))
    latest = files.latest_report(spark.read.parquet(path), ["feature"])
    return rounded(latest.select("feature", "csi", F.date_format("generated_at", "yyyy-MM-dd").alias("generated_on")))


@query(
    "published_metrics",
    f"""WITH {APP}, {CELLS_SQL} SELECT 0.12e0 AS optimal_threshold, CAST(NULL AS DOUBLE) AS auc_roc,
    round(tp/CAST(tp+fn AS DOUBLE),6) AS recall, round(tp/CAST(tp+fp AS DOUBLE),6) AS precision,
    round(2e0*tp/(2*tp+fp+fn),6) AS f1, CAST(NULL AS DOUBLE) AS ks, CAST(NULL AS DOUBLE) AS brier,
    1000e0*fp+10000e0*fn AS cost_savings FROM cells""",
)
def _(spark, folder):
    cells = confusion(panel(spark, folder), 0.12)
    rates = cell_metrics(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    document = F.struct(
        F.lit(0.12).alias("optimal_threshold"), (F.col("fp") * 1000.0 + F.col("fn") * 10000.0).alias("cost_savings"),
        F.struct(*[rates[m].alias(m) for m in ("recall", "precision", "f1")]).alias("metrics_optimal"),
    )
    path = scratch_path(spark, "validation")
    files.save_json(cells.select(document.alias("d")).select("d.*"), path)
    return rounded(files.published_metrics(files.read_validation(spark, path)))


GAPS_SQL = """gaps AS (SELECT ID, CASE WHEN ID%11=0 THEN NULL ELSE LIMIT_BAL END AS LIMIT_BAL,
  CASE WHEN ID%7=0 THEN NULL ELSE BILL_AMT1 END AS BILL_AMT1, CASE WHEN ID%13=0 THEN NULL ELSE AGE END AS AGE,
  CASE WHEN ID%5=0 THEN NULL WHEN ID%3=0 THEN 'b' WHEN ID%3=1 THEN 'a' ELSE 'c' END AS channel, default_flag FROM app)"""


def with_gaps(spark, folder):
    app = panel(spark, folder)
    skip = lambda k, c: F.when(F.col("ID") % k != 0, F.col(c)).alias(c)
    channel = F.when(F.col("ID") % 5 == 0, None).when(F.col("ID") % 3 == 0, "b").when(F.col("ID") % 3 == 1, "a").otherwise("c")
    return app.select("ID", skip(11, "LIMIT_BAL"), skip(7, "BILL_AMT1"), skip(13, "AGE"), channel.alias("channel"), v.TARGET)


@query(
    "basic_checks",
    f"""WITH {APP}, {GAPS_SQL} SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns,
    CAST(sum(CAST(LIMIT_BAL IS NULL AS INT)+CAST(BILL_AMT1 IS NULL AS INT)+CAST(AGE IS NULL AS INT)+CAST(channel IS NULL AS INT)) AS BIGINT) AS total_nulls
    FROM gaps""",
)
def _(spark, folder):
    return cleaning.basic_checks(with_gaps(spark, folder), ["LIMIT_BAL", "AGE", v.TARGET])


@query("raw_inputs", f"WITH {APP} SELECT ID, {', '.join(v.RAW_FEATURES)} FROM app")
def _(spark, folder):
    return cleaning.raw_inputs(panel(spark, folder))


@query(
    "coerce_numbers",
    f"""WITH {APP} SELECT ID, CASE WHEN ID%9=0 THEN NULL ELSE AGE END AS AGE, CASE WHEN ID%8=0 THEN NULL ELSE PAY_0 END AS PAY_0,
    CASE WHEN ID%10=0 THEN NULL ELSE BILL_AMT1 END AS BILL_AMT1 FROM app""",
)
def _(spark, folder):
    text = panel(spark, folder).select(
        "ID", F.when(F.col("ID") % 9 == 0, "n/a").otherwise(F.col("AGE").cast("string")).alias("AGE"),
        F.when(F.col("ID") % 8 == 0, "").otherwise(F.concat(F.lit(" "), F.col("PAY_0").cast("string"), F.lit(".0"))).alias("PAY_0"),
        F.when(F.col("ID") % 10 == 0, "NaN").otherwise(F.col("BILL_AMT1").cast("string")).alias("BILL_AMT1"),
    )
    return cleaning.coerce_numbers(text, ["AGE", "PAY_0", "BILL_AMT1"], whole=["AGE", "PAY_0"])


def _middle(column: str) -> str:
    return f"(SELECT {quantile_sql('l', 0.5)} FROM (SELECT list_sort(list(CAST({column} AS DOUBLE))) AS l FROM gaps WHERE {column} IS NOT NULL))"


IMPUTED = ["LIMIT_BAL", "BILL_AMT1", "AGE"]


@query(
    "impute_median",
    f"WITH {APP}, {GAPS_SQL} SELECT ID, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), {_middle(c)}) AS {c}" for c in IMPUTED)
    + " FROM gaps",
)
def _(spark, folder):
    return cleaning.impute_median(with_gaps(spark, folder), IMPUTED).select("ID", *IMPUTED)


MODE_SQL = "(SELECT channel FROM gaps WHERE channel IS NOT NULL GROUP BY channel ORDER BY count(*) DESC, channel LIMIT 1)"


@query("impute_mode", f"WITH {APP}, {GAPS_SQL} SELECT ID, coalesce(channel, {MODE_SQL}) AS channel FROM gaps")
def _(spark, folder):
    return cleaning.impute_mode(with_gaps(spark, folder), ["channel"]).select("ID", "channel")


@query(
    "clean_clients",
    f"WITH {APP}, {GAPS_SQL} SELECT ID, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), {_middle(c)}) AS {c}" for c in IMPUTED)
    + f", coalesce(channel, {MODE_SQL}) AS channel, default_flag FROM gaps",
)
def _(spark, folder):
    return cleaning.clean(with_gaps(spark, folder)).select("ID", *IMPUTED, "channel", v.TARGET)


@query(
    "binarize_target",
    f"WITH {APP} SELECT ID, CAST(CASE WHEN ID%6=0 OR ID%4=0 THEN 0 ELSE default_flag END AS INT) AS default_flag FROM app",
)
def _(spark, folder):
    text = F.when(F.col("ID") % 6 == 0, "?").when(F.col("ID") % 4 == 0, None).otherwise(F.format_string("%d.0", v.TARGET))
    return cleaning.binarize_target(panel(spark, folder).select("ID", text.alias(v.TARGET)))


FAULT_TESTS = " || ".join(
    [f"CASE WHEN {c} IS NULL THEN '{c} missing;' ELSE '' END"
     + (f" || CASE WHEN {c} < {lo} THEN '{c} below {lo};' ELSE '' END" if lo is not None else "")
     + (f" || CASE WHEN {c} > {hi} THEN '{c} above {hi};' ELSE '' END" if hi is not None else "")
     for c, lo, hi in v.VALID_RANGES]
)
FAULTS_SQL = f"f AS (SELECT *, {FAULT_TESTS} AS faults FROM app)"


@query("rejected_rows", f"WITH {APP}, {FAULTS_SQL} SELECT ID, faults FROM f WHERE faults<>''")
def _(spark, folder):
    return validity.rejected(panel(spark, folder)).select(
        "ID", F.concat(F.array_join("faults", ";"), F.lit(";")).alias("faults")
    )


@query("accepted_rows", f"WITH {APP}, {FAULTS_SQL} SELECT ID, AGE, LIMIT_BAL FROM f WHERE faults=''")
def _(spark, folder):
    return validity.accepted(panel(spark, folder)).select("ID", "AGE", "LIMIT_BAL")


BATCH = "CAST((ID-ID%4)/4 AS BIGINT)"
GATE_SQL = f"""g AS (SELECT {BATCH} AS batch_id, count(*) AS "rows", count(*) FILTER (faults<>'') AS invalid_rows FROM f GROUP BY 1)"""


def batches(spark, folder):
    return panel(spark, folder).withColumn("batch_id", ((F.col("ID") - F.col("ID") % 4) / 4).cast("bigint"))


@query("batch_gate", f"""WITH {APP}, {FAULTS_SQL}, {GATE_SQL} SELECT *, (invalid_rows=0 AND "rows"<=3) AS accepted FROM g""")
def _(spark, folder):
    return validity.gate_batches(batches(spark, folder), limit=3)


@query(
    "rows_of_accepted_batches",
    f"""WITH {APP}, {FAULTS_SQL}, {GATE_SQL} SELECT ID, {BATCH} AS batch_id FROM app
    WHERE {BATCH} IN (SELECT batch_id FROM g WHERE invalid_rows=0 AND "rows"<=100)""",
)
def _(spark, folder):
    return validity.rows_of_accepted_batches(batches(spark, folder)).select("ID", "batch_id")


@query(
    "null_counts",
    f"""WITH {APP}, {GAPS_SQL} SELECT unnest(['ID','LIMIT_BAL','BILL_AMT1','AGE','channel','default_flag']) AS "column",
    unnest(['bigint','double','double','int','string','int']) AS "type",
    unnest([0, count(*)-count(LIMIT_BAL), count(*)-count(BILL_AMT1), count(*)-count(AGE), count(*)-count(channel), 0]) AS nulls FROM gaps""",
)
def _(spark, folder):
    return cleaning.null_counts(with_gaps(spark, folder))


DUPLICATED = "SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem"


@query(
    "duplicate_rows",
    f"SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({DUPLICATED}))) AS duplicate_rows",
)
def _(spark, folder):
    return cleaning.duplicate_rows(
        table(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    )


DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def describe_sql(columns, source) -> str:
    q = lambda c, p: quantile_sql(f"list_sort(list(CAST({c} AS DOUBLE)))", p)
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS "count", round(avg({c}),6) AS mean, round(stddev_samp({c}),6) AS std,
        CAST(min({c}) AS DOUBLE) AS min, round({q(c, .25)},6) AS q25, round({q(c, .5)},6) AS q50, round({q(c, .75)},6) AS q75,
        CAST(max({c}) AS DOUBLE) AS max FROM {source}""" for c in columns
    )


@query("describe_order_lines", describe_sql(DESCRIBED, "lineitem"))
def _(spark, folder):
    return rounded(cleaning.describe(table(spark, folder, "lineitem"), DESCRIBED))


@query("describe_clients", f"WITH {APP} {describe_sql(v.RAW_FEATURES, 'app')}")
def _(spark, folder):
    return rounded(cleaning.describe(panel(spark, folder), v.RAW_FEATURES))


@query(
    "expectation_checks",
    f"""WITH {APP}, t AS (SELECT count(*) AS n, count(*) FILTER (LIMIT_BAL BETWEEN 10000 AND 1000000) AS a,
      count(*) FILTER (SEX IN (1,2)) AS b, count(*) FILTER (default_flag IS NOT NULL) AS c FROM app)
    SELECT unnest(['LIMIT_BAL between 10000 and 1000000','SEX in {{1, 2}}','default_flag not null']) AS expectation,
      n AS "rows", unnest([a,b,c]) AS passed, round(unnest([a,b,c])/CAST(n AS DOUBLE),6) AS pass_rate, unnest([a,b,c])=n AS success FROM t""",
)
def _(spark, folder):
    return rounded(validity.check_expectations(panel(spark, folder)))


@query(
    "align_features",
    f"WITH {APP} SELECT ID, PAY_0, LIMIT_BAL, CAST(0 AS INT) AS utilization_1, AGE FROM app",
)
def _(spark, folder):
    return align(panel(spark, folder), ["PAY_0", "LIMIT_BAL", "utilization_1", "AGE"], keep=["ID"])


@query("drop_targets", f"WITH {APP} SELECT ID, LIMIT_BAL, AGE FROM app")
def _(spark, folder):
    app = panel(spark, folder).select("ID", "LIMIT_BAL", "AGE", v.TARGET, F.col(v.TARGET).alias("default.payment.next.month"))
    return cleaning.drop_targets(app)


AMOUNTS = ["LIMIT_BAL", "AGE", *[f"BILL_AMT{i}" for i in range(1, 7)], *[f"PAY_AMT{i}" for i in range(1, 7)]]
WINSORIZED = AMOUNTS


@query(
    "winsorize",
    f"WITH {APP}, q AS (SELECT " + ", ".join(
        f"{quantiles_sql(f'list_sort(list({c}))', [0.01, 0.99])} AS q_{c}" for c in WINSORIZED
    ) + " FROM app) SELECT ID, " + ", ".join(f"round(greatest(q_{c}[1], least(q_{c}[2], {c})),6) AS {c}" for c in WINSORIZED)
    + " FROM app, q",
)
def _(spark, folder):
    return rounded(cleaning.winsorize(panel(spark, folder), WINSORIZED).select("ID", *WINSORIZED))


@query(
    "standard_scale",
    rounded_sql(
        AMOUNTS,
        "SELECT ID, " + ", ".join(f"({c}-avg({c}) OVER ())/stddev_pop({c}) OVER () AS {c}" for c in AMOUNTS) + " FROM app",
    ),
)
def _(spark, folder):
    return rounded(cleaning.standard_scale(panel(spark, folder), AMOUNTS).select("ID", *AMOUNTS))


@query(
    "quality_scores",
    f"""WITH {APP}, {FAULTS_SQL}, d AS (SELECT count(*) AS groups FROM (SELECT DISTINCT {CLIENT_SQL} FROM app))
    SELECT count(*) AS "rows", 1e0 AS completeness, round(count(*) FILTER (faults='')/CAST(count(*) AS DOUBLE),6) AS validity,
    round((count(*) FILTER (SEX IN (1,2))+count(*) FILTER (EDUCATION BETWEEN 1 AND 4)+count(*) FILTER (MARRIAGE BETWEEN 1 AND 3))/(3e0*count(*)),6) AS consistency,
    round(max(groups)/CAST(count(*) AS DOUBLE),6) AS uniqueness FROM f, d""",
)
def _(spark, folder):
    return rounded(validity.quality_scores(clients(spark, folder)))


@query(
    "match_actuals",
    f"WITH {APP} SELECT ID, score AS default_probability, default_flag FROM app WHERE ID%10<>0 AND ID%15<>0",
)
def _(spark, folder):
    app = panel(spark, folder)
    predictions = app.where("ID % 10 <> 0").select("ID", F.col("score").alias("default_probability"))
    return matching.match_actuals(predictions, app.where("ID % 15 <> 0").select("ID", v.TARGET))


@query(
    "match_counts",
    f"""WITH {APP} SELECT count(*) FILTER (ID%10<>0 AND ID%15<>0) AS matched,
    count(*) FILTER (ID%10<>0 AND ID%15=0) AS predictions_only, count(*) FILTER (ID%10=0 AND ID%15<>0) AS actuals_only FROM app""",
)
def _(spark, folder):
    app = panel(spark, folder)
    return matching.match_counts(app.where("ID % 10 <> 0"), app.where("ID % 15 <> 0"))


@query("inputs_beside_predictions", rounded_sql(
    ["suggested_credit_limit_mxn"],
    "SELECT ID, AGE, SEX, default_flag, default_probability, default_prediction, risk_band, suggested_credit_limit_mxn FROM p",
    ctes=PREDICTIONS,
))
def _(spark, folder):
    rows = with_decisions(panel(spark, folder).select("ID", "AGE", "SEX", v.TARGET, "score"), include_features=True)
    return rounded(rows)


@query("features_with_labels", "SELECT d.doc_id, lang, n_chars, quality, toxic FROM documents d JOIN labels l ON d.doc_id=l.doc_id")
def _(spark, folder):
    features = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return matching.match_actuals(features, table(spark, folder, "labels"), "doc_id")


@query(
    "rows_with_parameters",
    f"WITH {APP} SELECT ID, score>=cut AS over FROM app, (SELECT avg(score) AS cut FROM app)",
)
def _(spark, folder):
    app = panel(spark, folder)
    cut = app.agg(F.avg("score").alias("cut"))
    return matching.with_parameters(app, cut).select("ID", (F.col("score") >= F.col("cut")).alias("over"))


@query(
    "share_of_band",
    rounded_sql(
        ["share"],
        "SELECT SEX, risk_band, count(*) AS n, count(*)/sum(count(*)) OVER (PARTITION BY SEX) AS share FROM p GROUP BY SEX, risk_band",
        ctes=PREDICTIONS,
    ),
)
def _(spark, folder):
    rows = with_decisions(panel(spark, folder), keep=["ID", "SEX"]).groupBy("SEX", "risk_band").agg(F.count(F.lit(1)).alias("n"))
    return rounded(matching.with_share(rows, "n", ["SEX"]))


SPINE = ["l_discount", "l_quantity"]


@query(
    "reference_and_production_bins",
    f"""WITH x AS (SELECT 'l_discount' AS feature, CAST(l_shipdate>=TIMESTAMP '1998-06-01' AS INT) AS side, l_discount AS value FROM lineitem
      UNION ALL SELECT 'l_quantity', CAST(l_shipdate>=TIMESTAMP '1998-06-01' AS INT), l_quantity FROM lineitem), {psi_ctes("x")}
    SELECT feature, CAST(bin AS INT) AS bin, ne AS expected, na AS actual FROM c""",
)
def _(spark, folder):
    items = scored_items(spark, folder)
    late = F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz")
    return drift.bin_counts(items.where(~late), items.where(late), SPINE)

