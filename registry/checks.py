"""Splits, folds, bootstrap, fairness and production gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import APP, DOCS, ITEMS, labelled_documents, panel, query, rounded, rounded_sql, scored_items
from registry.drifting import BOTH
from registry.metrics import QUARTER_SQL, QUARTERS, RATES, SPLIT_APP, cells_sql, div, point_ctes, split_panel
from riskloom import vocab as v
from riskloom.functions.decisions import check_goals
from riskloom.operators import fairness, resampling, splits
from riskloom.operators.classifier import business_metrics, classification_metrics, to_long

COUNTS = "c AS (SELECT default_flag, count(*) AS n, CAST(floor(count(*)*0.2e0+0.5e0) AS BIGINT) AS t FROM app GROUP BY default_flag)"


@query("stratified_split_sizes", f"""WITH {ITEMS}, c AS (SELECT default_flag, count(*) AS n, CAST(floor(count(*)*0.2e0+0.5e0) AS BIGINT) AS t FROM items GROUP BY default_flag)
    SELECT default_flag, 'test' AS split, t AS n FROM c UNION ALL SELECT default_flag, 'train', n-t FROM c""")
def _(spark, folder):
    items = scored_items(spark, folder).withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return splits.stratified_split(items, key="line").groupBy(v.TARGET, "split").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_split_rows")
def _(spark, folder):
    return splits.stratified_split(panel(spark, folder)).select("ID", v.TARGET, "split")


@query("three_way_split_sizes", f"""WITH {APP}, {COUNTS}, w AS (SELECT *, CAST(floor((n-t)*0.2e0+0.5e0) AS BIGINT) AS u FROM c)
    SELECT default_flag, 'test' AS split, t AS n FROM w UNION ALL SELECT default_flag, 'validation', u FROM w UNION ALL SELECT default_flag, 'train', n-t-u FROM w""")
def _(spark, folder):
    return splits.three_way_split(panel(spark, folder)).groupBy(v.TARGET, "split").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_fold_sizes", f"""WITH {APP}, {COUNTS}, k AS (SELECT default_flag, n, CAST(r.range AS INT) AS fold FROM c, range(5) r)
    SELECT default_flag, fold, CAST(floor(n*(fold+1)/5e0)-floor(n*fold/5e0) AS BIGINT) AS n FROM k""")
def _(spark, folder):
    return splits.stratified_folds(panel(spark, folder).drop("fold")).groupBy(v.TARGET, "fold").agg(F.count(F.lit(1)).alias("n"))


@query("class_weights", f"""WITH {APP} SELECT default_flag, count(*) AS n, round(sum(count(*)) OVER ()/(2e0*count(*)),6) AS weight FROM app GROUP BY default_flag""")
def _(spark, folder):
    return rounded(splits.class_weights(panel(spark, folder)))


@query("rows_with_class_weight", f"""WITH {APP} SELECT ID, default_flag, round(count(*) OVER ()/(2e0*count(*) OVER (PARTITION BY default_flag)),6) AS weight FROM app""")
def _(spark, folder):
    return rounded(splits.with_class_weight(panel(spark, folder).select("ID", v.TARGET)))


FOLDS = f"{point_ctes('app', 'fold')}, {cells_sql('app', '[0.12e0]', 'fold')}, fm AS (SELECT fold, {RATES['recall']} AS recall, {RATES['precision']} AS precision, {RATES['f1']} AS f1, auc_roc FROM cells JOIN om USING (fold))"


@query("fold_metrics", rounded_sql(["recall", "precision", "f1", "auc_roc"], "SELECT * FROM fm", ctes=FOLDS))
def _(spark, folder):
    return rounded(resampling.fold_metrics(panel(spark, folder)))


@query("fold_stability", rounded_sql(
    ["mean", "std", "cv"], "SELECT *, CASE WHEN cv<0.05e0 THEN 'stable' WHEN cv<0.1e0 THEN 'high' ELSE 'unstable' END AS label FROM (SELECT *, CASE WHEN mean>0 THEN std/mean ELSE 0e0 END AS cv FROM ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, avg({m}) AS mean, stddev_samp({m}) AS std FROM fm" for m in resampling.STABILITY_METRICS) + "))", ctes=FOLDS,
))
def _(spark, folder):
    return rounded(resampling.fold_stability(resampling.fold_metrics(panel(spark, folder))))


@query("bootstrap_intervals")
def _(spark, folder):
    return resampling.bootstrap_intervals(panel(spark, folder), replicates=1000)


@query("bootstrap_intervals_order_lines")
def _(spark, folder):
    return resampling.bootstrap_intervals(scored_items(spark, folder), replicates=1000, threshold=0.5)


def fairness_sql(group: str, source: str, threshold: str = "0.12e0", by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}CAST({group} AS VARCHAR) AS "group", tp+fp+fn+tn AS n, {div("tp+fn", "tp+fp+fn+tn")} AS base_rate, {div("tp+fp", "tp+fp+fn+tn")} AS selection_rate,
    {RATES["precision"]} AS precision, {RATES["recall"]} AS recall, {RATES["fpr"]} AS fpr, 1e0-({RATES["recall"]}) AS fnr FROM
    (SELECT {lead}{group}, count(*) FILTER (score>={threshold} AND default_flag=1) AS tp, count(*) FILTER (score>={threshold} AND default_flag=0) AS fp,
     count(*) FILTER (score<{threshold} AND default_flag=1) AS fn, count(*) FILTER (score<{threshold} AND default_flag=0) AS tn FROM {source} GROUP BY {lead}{group})"""


FAIR = ["base_rate", "selection_rate", "precision", "recall", "fpr", "fnr"]


@query("fairness_by_education", rounded_sql(FAIR, fairness_sql("EDUCATION", "app")))
def _(spark, folder):
    return rounded(fairness.group_fairness(panel(spark, folder), "EDUCATION"))


SEXES = "sx AS (SELECT *, CASE WHEN SEX=1 THEN 'Masculino' ELSE 'Femenino' END AS sex_name FROM app)"
AGES = f"{QUARTERS}, ag AS (SELECT app.*, {QUARTER_SQL} AS age_group FROM app, qs)"


@query("fairness_by_sex", rounded_sql(FAIR, fairness_sql("sex_name", "sx"), ctes=SEXES))
def _(spark, folder):
    return rounded(fairness.fairness_by_sex(panel(spark, folder)))


@query("fairness_by_age", rounded_sql(FAIR, fairness_sql("age_group", "ag"), ctes=AGES))
def _(spark, folder):
    return rounded(fairness.fairness_by_value(panel(spark, folder), "AGE"))


@query("fairness_by_language", f"WITH {DOCS} SELECT * REPLACE (" + ", ".join(f"round({c},6) AS {c}" for c in FAIR) + f") FROM ({fairness_sql('lang', 'docs', '0.5e0')})")
def _(spark, folder):
    return rounded(fairness.group_fairness(labelled_documents(spark, folder), "lang", 0.5))


@query("fairness_per_period", rounded_sql(FAIR, fairness_sql("MARRIAGE", "app", by="period")))
def _(spark, folder):
    return rounded(fairness.group_fairness(panel(spark, folder), "MARRIAGE", by=["period"]))


@query("disparate_impact", rounded_sql(
    ["lowest", "highest", "disparate_impact"], "SELECT *, disparate_impact<0.8e0 AS biased FROM (SELECT *, lowest/highest AS disparate_impact FROM "
    "(SELECT min(selection_rate) AS lowest, max(selection_rate) AS highest, count(*) AS groups FROM f))", ctes=f"{SEXES}, f AS ({fairness_sql('sex_name', 'sx', '0.5e0')})",
))
def _(spark, folder):
    return rounded(fairness.disparate_impact(fairness.fairness_by_sex(panel(spark, folder), threshold=0.5)))


@query("parity_gaps", rounded_sql(
    ["demographic_parity_gap", "equal_opportunity_gap", "equalised_odds_gap"],
    "SELECT max(selection_rate)-min(selection_rate) AS demographic_parity_gap, max(recall)-min(recall) AS equal_opportunity_gap, "
    "greatest(max(recall)-min(recall), max(fpr)-min(fpr)) AS equalised_odds_gap FROM f", ctes=f"{AGES}, f AS ({fairness_sql('age_group', 'ag')})",
))
def _(spark, folder):
    return rounded(fairness.parity_gaps(fairness.fairness_by_value(panel(spark, folder), "AGE")))


def gate_metrics(spark, folder):
    """Metrics of the production period plus its distance from the reference period."""
    app = panel(spark, folder)
    rows = business_metrics(classification_metrics(app, by=["period"]))
    named = rows.withColumns({"ks_statistic": F.col("ks"), "brier_score": F.col("brier")})
    names = ["auc_roc", "ks_statistic", "recall", "precision", "brier_score", "expected_savings", "savings_percentage"]
    at = lambda c, p: F.max(F.when(F.col("period") == p, F.col(c)))
    current = [at(c, 1).alias(c) for c in names]
    apart = [F.abs(at(c, 0) - at(c, 1)).alias(f"train_test_{n}_diff") for n, c in (("auc", "auc_roc"), ("ks", "ks"))]
    one = named.agg(*current, *apart)
    return to_long(one, one.columns)


@query("production_gate", rounded_sql(
    [], f"""SELECT bool_and(met) AS ready, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (NOT met), '') AS failed FROM
    (SELECT metric, CASE op WHEN '>=' THEN value>=target ELSE value<=target END AS met FROM
      (SELECT unnest({[g[0] for g in fairness.PRODUCTION_GATES]!r}) AS metric, unnest({[g[1] for g in fairness.PRODUCTION_GATES]!r}) AS op,
       unnest({[float(g[2]) for g in fairness.PRODUCTION_GATES]!r}) AS target,
       unnest([auc_roc, ks, {RATES["recall"]}, {RATES["precision"]}, brier, saved, 100e0*saved/(10000e0*(tp+fn)),
         abs(auc_roc-(WITH {point_ctes('ref')} SELECT auc_roc FROM om)), abs(ks-(WITH {point_ctes('ref')} SELECT ks FROM om))]) AS value
       FROM om, (SELECT *, 10000e0*(tp+fn)-1000e0*fp-10000e0*fn AS saved FROM cells)))""",
    ctes=f"{BOTH}, {point_ctes('prod')}, {cells_sql('prod', '[0.12e0]')}",
))
def _(spark, folder):
    checked = check_goals(gate_metrics(spark, folder), fairness.PRODUCTION_GATES)
    return fairness.production_gate(checked).withColumn("failed", F.array_join("failed", ","))


@query("split_shares", f"""WITH {APP}, {SPLIT_APP} SELECT split, count(*) AS "rows", round(avg(default_flag),6) AS target_share FROM sp GROUP BY split""")
def _(spark, folder):
    return rounded(split_panel(spark, folder).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.avg(v.TARGET).alias("target_share")))


