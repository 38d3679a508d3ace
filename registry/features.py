"""Feature derivation, decisions and message texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.cleaning import PREDICTIONS, SUMMARY_DOUBLES, SUMMARY_SELECT
from registry.common import APP, panel, query, rounded, rounded_sql, scored_items, table
from riskloom import vocab as v
from riskloom.functions import decisions, features, texts
from riskloom.operators import ranking, summaries
from riskloom.operators.classifier import business_metrics, classification_metrics, confusion, to_long

MONTHS = range(1, 7)


def _utilization_sql(variant: str, m: int = 1) -> str:
    plain = f"BILL_AMT{m}/LIMIT_BAL"
    if variant in ("script", "online"):
        return f"CASE WHEN LIMIT_BAL>0 THEN {plain} ELSE 0e0 END"
    value = f"CASE WHEN LIMIT_BAL<>0 THEN {plain} ELSE 0e0 END"
    return f"greatest(0e0, least(5e0, {value}))" if variant == "notebook" else value


def _ratio_sql(variant: str, m: int) -> str:
    plain = f"PAY_AMT{m}/BILL_AMT{m}"
    if variant in ("script", "online"):
        return f"CASE WHEN BILL_AMT{m}>0 THEN {plain} ELSE {'1e0' if variant == 'script' else '0e0'} END"
    value = f"CASE WHEN BILL_AMT{m}<>0 THEN {plain} ELSE 0e0 END"
    return f"greatest(0e0, least(5e0, {value}))" if variant == "notebook" else value


AGE_BIN = ("CASE WHEN AGE<=0 THEN NULL WHEN AGE<=25 THEN '<=25' WHEN AGE<=35 THEN '26-35' WHEN AGE<=45 THEN '36-45' "
           "WHEN AGE<=60 THEN '46-60' WHEN AGE<=120 THEN '60+' END")
AGE_DUMMY_SQL = {
    "AGE_bin_26-35": "AGE BETWEEN 26 AND 35", "AGE_bin_36-45": "AGE BETWEEN 36 AND 45",
    "AGE_bin_46-60": "AGE BETWEEN 46 AND 60", "AGE_bin_60+": "AGE>60",
}
DUMMIES = ", ".join(f'CAST({test} AS INT) AS "{name}"' for name, test in AGE_DUMMY_SQL.items())


def feature_sql(variant: str) -> str:
    if variant == "script":
        cols = [f"{_utilization_sql(variant, m)} AS UTIL_RATIO_{m}" for m in MONTHS]
        cols += [f"{_ratio_sql(variant, m)} AS PAY_RATIO_{m}" for m in MONTHS]
        cols += ["CAST(CASE WHEN EDUCATION IN (0,5,6) THEN 4 ELSE EDUCATION END AS INT) AS EDUCATION_CAT",
                 "CAST(CASE WHEN MARRIAGE=0 THEN 3 ELSE MARRIAGE END AS INT) AS MARRIAGE_CAT"]
        return "SELECT ID, " + ", ".join(cols) + " FROM app"
    cols = [f"{_utilization_sql(variant)} AS utilization_1"] + [f"{_ratio_sql(variant, m)} AS payment_ratio_{m}" for m in MONTHS]
    if variant != "ingest":
        codes = "(0,5,6)" if variant == "notebook" else "(0,4,5,6)"
        cols += [f"CAST(CASE WHEN EDUCATION IN {codes} THEN 4 ELSE EDUCATION END AS INT) AS EDUCATION_grouped",
                 "CAST(CASE WHEN MARRIAGE=0 THEN 3 ELSE MARRIAGE END AS INT) AS MARRIAGE_grouped", DUMMIES]
    if variant == "notebook":
        cols.append(f"{AGE_BIN} AS AGE_bin")
    return "SELECT ID, " + ", ".join(cols) + " FROM app"


def ratio_columns(variant: str) -> list[str]:
    if variant == "script":
        return [f"UTIL_RATIO_{m}" for m in MONTHS] + [f"PAY_RATIO_{m}" for m in MONTHS]
    return ["utilization_1"] + v.PAYMENT_RATIOS


def _register(variant: str) -> None:
    @query(f"features_{variant}", rounded_sql(ratio_columns(variant), feature_sql(variant), 9))
    def _(spark, folder):
        app = panel(spark, folder)
        made = features.with_features(app, variant)
        return rounded(made.select("ID", *[F.col(f"`{c}`") for c in made.columns if c not in app.columns]), 9)


for _name in features.VARIANTS:
    _register(_name)

MODEL_SQL = (
    "SELECT ID, " + ", ".join(v.RAW_FEATURES) + ", utilization_1, " + ", ".join(v.PAYMENT_RATIOS)
    + ", EDUCATION_grouped, MARRIAGE_grouped, " + ", ".join(f'"{d}"' for d in v.AGE_DUMMIES)
    + f" FROM app JOIN ({feature_sql('table')}) AS derived USING (ID)"
)


@query("model_feature_table", rounded_sql(ratio_columns("table"), MODEL_SQL, 9))
def _(spark, folder):
    return rounded(features.align(features.with_features(panel(spark, folder), "table"), keep=["ID"]), 9)


NULLED = """n AS (SELECT ID, CASE WHEN ID%3=0 THEN NULL ELSE LIMIT_BAL END AS LIMIT_BAL, CASE WHEN ID%4=0 THEN NULL ELSE BILL_AMT1 END AS BILL_AMT1,
  CASE WHEN ID%5=0 THEN NULL ELSE AGE END AS AGE FROM app)"""


@query(
    "features_table_with_nulls",
    f"""WITH {APP}, {NULLED} SELECT ID, round(CASE WHEN coalesce(LIMIT_BAL,0e0)<>0 THEN coalesce(BILL_AMT1,0e0)/LIMIT_BAL ELSE 0e0 END,9) AS utilization_1,
    CAST(coalesce(AGE,0) BETWEEN 26 AND 35 AS INT) AS "AGE_bin_26-35" FROM n""",
)
def _(spark, folder):
    app = panel(spark, folder)
    holes = {c: F.when(F.col("ID") % k != 0, F.col(c)) for c, k in (("LIMIT_BAL", 3), ("BILL_AMT1", 4), ("AGE", 5))}
    made = features.with_features(app.withColumns(holes), "table")
    return rounded(made.select("ID", "utilization_1", "`AGE_bin_26-35`"), 9)


@query("age_buckets", f"WITH {APP}, w AS (SELECT ID, (AGE-40)*4 AS AGE FROM app) SELECT ID, {AGE_BIN} AS bucket FROM w")
def _(spark, folder):
    return panel(spark, folder).select("ID", features.age_bucket((F.col("AGE") - 40) * 4).alias("bucket"))


@query(
    "one_hot_segments",
    "SELECT c_custkey, " + ", ".join(
        f"CAST(c_mktsegment='{s}' AS INT) AS seg_{s}" for s in ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    ) + " FROM customer",
)
def _(spark, folder):
    levels = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return table(spark, folder, "customer").select(
        "c_custkey", *[x.alias(n) for n, x in features.one_hot(F.col("c_mktsegment"), levels, "seg").items()]
    )


TREND_SQL = (
    "SELECT ID, round(" + "+".join(f"BILL_AMT{7 - t}*({(t - 3.5) / 17.5!r}e0)" for t in MONTHS) + ", 4) AS billing_slope, ("
    + "+".join(f"({_ratio_sql('notebook', m)})" for m in MONTHS) + ")/6e0 AS avg_payment_ratio, "
    + "(PAY_0+PAY_2+PAY_3+PAY_4+PAY_5+PAY_6)/6e0 AS avg_delay, CAST(PAY_0-PAY_6 AS INT) AS delay_change, "
    + f"PAY_0*({_utilization_sql('notebook')}) AS delay_x_utilization, AGE*LIMIT_BAL AS age_x_limit FROM app"
)


@query("trend_features", rounded_sql(["avg_payment_ratio", "avg_delay", "delay_x_utilization"], TREND_SQL, 9))
def _(spark, folder):
    made = features.with_trend_features(panel(spark, folder))
    return rounded(made.select(
        "ID", F.round("billing_slope", 4).alias("billing_slope"), "avg_payment_ratio", "avg_delay", "delay_change", "delay_x_utilization", "age_x_limit"
    ), 9)


@query("risk_bands_custom_cuts", f"""WITH {APP} SELECT ID, CASE WHEN score<0.3e0 THEN 'APROBADO' WHEN score<0.6e0 THEN 'REVISION' ELSE 'RECHAZO' END AS risk_band,
    round(CASE WHEN score<0.3e0 THEN 50000e0*(1e0-score/0.2e0*0.2e0) WHEN score<0.6e0 THEN 50000e0*(0.6e0-(score-0.2e0)/0.3e0*0.2e0) ELSE 0e0 END,4) AS credit_limit FROM app""")
def _(spark, folder):
    band = decisions.risk_band(F.col("score"), 0.3, 0.6)
    return rounded(panel(spark, folder).select(
        "ID", band.alias("risk_band"), decisions.credit_limit(F.col("score"), band).alias("credit_limit")
    ), 4)


@query("batch_decisions", rounded_sql(
    ["suggested_credit_limit_mxn"],
    "SELECT ID, default_probability, default_prediction, risk_band, suggested_credit_limit_mxn, '2024-01-01 00:00:00' AS prediction_timestamp FROM p",
    4, PREDICTIONS,
))
def _(spark, folder):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return rounded(decisions.with_decisions(panel(spark, folder), at=at), 4)


@query("order_line_decisions", """SELECT l_orderkey, l_linenumber, round(l_quantity/50e0,4) AS default_probability,
    CAST(round(l_quantity/50e0,4)>=0.12e0 AS INT) AS default_prediction,
    CASE WHEN round(l_quantity/50e0,4)<0.2e0 THEN 'APROBADO' WHEN round(l_quantity/50e0,4)<0.5e0 THEN 'REVISION' ELSE 'RECHAZO' END AS risk_band,
    round(CASE WHEN round(l_quantity/50e0,4)<0.2e0 THEN 50000e0*(1e0-round(l_quantity/50e0,4)/0.2e0*0.2e0)
         WHEN round(l_quantity/50e0,4)<0.5e0 THEN 50000e0*(0.6e0-(round(l_quantity/50e0,4)-0.2e0)/0.3e0*0.2e0) ELSE 0e0 END,4) AS suggested_credit_limit_mxn FROM lineitem""")
def _(spark, folder):
    return rounded(decisions.with_decisions(scored_items(spark, folder), keep=["l_orderkey", "l_linenumber"]), 4)


@query("service_responses", f"""WITH {APP} SELECT ID, round(score,4) AS probability, CASE WHEN score>=0.12e0 THEN 'DEFAULT' ELSE 'NO_DEFAULT' END AS prediction,
    CASE WHEN score<0.2e0 THEN 'APROBADO' WHEN score<0.5e0 THEN 'REVISION' ELSE 'RECHAZO' END AS risk_band, 0.12e0 AS threshold_used,
    '2024-01-01T00:00:00' AS "timestamp", '1.0.0' AS model_version FROM app""")
def _(spark, folder):
    return decisions.with_online_response(panel(spark, folder), at=F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query("status_labels", f"""WITH {APP} SELECT ID, CASE WHEN score<0.1e0 THEN 'OK' WHEN score<0.25e0 THEN 'WARNING' ELSE 'CRITICAL' END AS psi_status,
    CASE WHEN score<0.1e0 THEN 'ok' WHEN score<0.2e0 THEN 'warning' ELSE 'critical' END AS drawn_status,
    CASE WHEN score<0.05e0 THEN 'stable' WHEN score<0.1e0 THEN 'high' ELSE 'unstable' END AS stability FROM app""")
def _(spark, folder):
    s = F.col("score")
    return panel(spark, folder).select(
        "ID", decisions.psi_status(s).alias("psi_status"),
        decisions.psi_status(s, 0.1, 0.2, lower_case=True).alias("drawn_status"), decisions.stability_label(s).alias("stability"),
    )


@query("prediction_summary", rounded_sql(SUMMARY_DOUBLES, f"SELECT SEX, {SUMMARY_SELECT} FROM p GROUP BY SEX", 4, PREDICTIONS))
def _(spark, folder):
    return rounded(summaries.prediction_summary(decisions.with_decisions(panel(spark, folder), keep=["ID", "SEX"]), ["SEX"]), 4)


@query("band_distribution", f"""WITH {APP}, {PREDICTIONS}, s AS (SELECT unnest(['APROBADO','REVISION','RECHAZO']) AS band, unnest([0,1,2]) AS position)
    SELECT CAST(position AS INT) AS position, band, count(risk_band) AS clients, round(100e0*count(risk_band)/(SELECT count(*) FROM p),1) AS "percent"
    FROM s LEFT JOIN p ON risk_band=band GROUP BY position, band""")
def _(spark, folder):
    return summaries.band_distribution(decisions.with_decisions(panel(spark, folder)))


@query("review_workload", rounded_sql(
    ["review_hours", "review_cost", "net_savings", "expected_savings"],
    """SELECT r AS reviews, saved AS expected_savings, r*15e0/60e0 AS review_hours, r*15e0/60e0*50e0 AS review_cost, saved-r*15e0/60e0*50e0 AS net_savings
    FROM (SELECT count(*) FILTER (risk_band='REVISION') AS r, 10000e0*count(*) FILTER (default_flag=1)
      -1000e0*count(*) FILTER (default_flag=0 AND default_prediction=1)-10000e0*count(*) FILTER (default_flag=1 AND default_prediction=0) AS saved FROM p)""",
    4, PREDICTIONS,
))
def _(spark, folder):
    app = panel(spark, folder)
    bands = summaries.band_distribution(decisions.with_decisions(app))
    return rounded(summaries.review_workload(bands, business_metrics(confusion(app, 0.12))), 4)


@query("flatten_nested", f"""WITH {APP} SELECT ID, LIMIT_BAL AS account_limit, SEX AS account_holder_sex, CAST(AGE>40 AS BOOLEAN) AS account_holder_older,
    risk_band AS decision_band, CAST(DATE '2024-01-01' AS VARCHAR) AS decision_day FROM
    (SELECT *, CASE WHEN score<0.2e0 THEN 'APROBADO' WHEN score<0.5e0 THEN 'REVISION' ELSE 'RECHAZO' END AS risk_band FROM app)""")
def _(spark, folder):
    holder = F.struct(F.col("SEX").alias("sex"), (F.col("AGE") > 40).alias("older"))
    decision = F.struct(decisions.risk_band(F.col("score")).alias("band"), F.lit("2024-01-01").cast("date").alias("day"))
    nested = panel(spark, folder).select(
        "ID", F.struct(F.col("LIMIT_BAL").alias("limit"), holder.alias("holder")).alias("account"), decision.alias("decision")
    )
    return texts.flatten(nested)


@query("alert_messages", f"""WITH {APP} SELECT ID, 'Data Drift Detected: PAY_'||ID AS title,
    printf('Drift score (%.4f) exceeds threshold (%.4f). Consider retraining the model.', score, 0.2e0) AS message,
    printf('Current recall (%.4f) is %.1f%% below expected (%.4f). Investigate immediately.', score, AGE*1e0, 0.7e0) AS performance FROM app""")
def _(spark, folder):
    name = F.concat(F.lit("PAY_"), F.col("ID").cast("string"))
    return panel(spark, folder).select(
        "ID", texts.drift_title(name).alias("title"), texts.drift_message(F.col("score"), F.lit(0.2)).alias("message"),
        texts.performance_message(F.lit("recall"), F.col("score"), F.col("AGE").cast("double"), F.lit(0.7)).alias("performance"),
    )


@query("alert_bodies", f"""WITH {APP} SELECT ID, CASE ID%5 WHEN 0 THEN 'ℹ️' WHEN 1 THEN '⚠️' WHEN 2 THEN '❌' WHEN 3 THEN '🚨' ELSE '📢' END
    || ' **Account ' || ID || E'**\\n\\nSee account.\\n\\n**Timestamp:** 2024-01-01 00:00:00\\n**Severity:** '
    || CASE ID%5 WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'CRITICAL' ELSE 'OTHER' END || E'\\n'
    || E'\\n**Metrics:**\\n  - age: ' || AGE || E'\\n  - sex: ' || SEX || E'\\n'
    || CASE WHEN ID%2=0 THEN E'\\n**Metadata:**\\n  - fold: ' || fold || E'\\n' ELSE '' END AS body FROM app""")
def _(spark, folder):
    severity = F.element_at(F.array(*[F.lit(s) for s in ("info", "warning", "error", "critical", "other")]), (F.col("ID") % 5 + 1).cast("int"))
    metrics = F.create_map(F.lit("sex"), F.col("SEX").cast("string"), F.lit("age"), F.col("AGE").cast("string"))
    metadata = F.when(F.col("ID") % 2 == 0, F.create_map(F.lit("fold"), F.col("fold").cast("string")))
    title = F.concat(F.lit("Account "), F.col("ID").cast("string"))
    return panel(spark, folder).select("ID", texts.alert_body(
        title, F.lit("See account."), severity, F.lit("2024-01-01 00:00:00"), metrics, metadata
    ).alias("body"))


GOAL_VALUES = """g AS (SELECT count(*) FILTER (score>=0.12e0 AND default_flag=1)/CAST(count(*) FILTER (default_flag=1) AS DOUBLE) AS recall,
  count(*) FILTER (score>=0.12e0 AND default_flag=1)/CAST(count(*) FILTER (score>=0.12e0) AS DOUBLE) AS precision,
  avg((score-default_flag)*(score-default_flag)) AS brier FROM app),
  goals AS (SELECT unnest(['recall','precision','brier']) AS metric, unnest([recall,precision,brier]) AS value,
    unnest(['>=','>=','<=']) AS op, unnest([0.7e0,0.3e0,0.2e0]) AS target FROM g)"""


def checked_goals(spark, folder):
    metrics = classification_metrics(panel(spark, folder))
    return decisions.check_goals(to_long(metrics, ["recall", "precision", "brier"]))


@query("goal_checks", rounded_sql(["value"], "SELECT *, CASE WHEN op='>=' THEN value>=target ELSE value<=target END AS met FROM goals", ctes=GOAL_VALUES))
def _(spark, folder):
    return rounded(checked_goals(spark, folder))


@query("goals_met", rounded_sql(
    ["percent"],
    """SELECT count(*) FILTER (ok) AS met, count(*) AS goals, 100e0*count(*) FILTER (ok)/count(*) AS "percent"
    FROM (SELECT CASE WHEN op='>=' THEN value>=target ELSE value<=target END AS ok FROM goals)""", ctes=GOAL_VALUES,
))
def _(spark, folder):
    return rounded(decisions.goals_met(checked_goals(spark, folder)))


@query("rows_by_score", f"WITH {APP} SELECT ID, score FROM app")
def _(spark, folder):
    return ranking.by_score(panel(spark, folder)).select("ID", "score")


@query("first_rows", f"WITH {APP} SELECT ID, AGE, score FROM app ORDER BY ID LIMIT 20")
def _(spark, folder):
    return ranking.preview(panel(spark, folder).select("ID", "AGE", "score"))
