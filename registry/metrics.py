"""Classifier metrics, curves, sweeps, calibration, distributions and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.cleaning import AMOUNTS, PREDICTIONS
from registry.common import (
    APP, DOCS, ITEMS, labelled_documents, number, numbers, panel, quantiles_sql, query, rounded, rounded_sql,
    scored_items, table,
)
from riskloom import vocab as v
from riskloom.functions.decisions import with_decisions
from riskloom.operators import calibration, classifier, curves, ranking, summaries, sweep
from riskloom.plans.evaluation import evaluate, evaluation_row
from riskloom.plans.training import credit_metrics, named_credit_metrics
from riskloom.runtime import pin
from riskloom.sources.runs import runs_from_metrics

EPS = number(classifier.SMALLEST_STEP)


def point_ctes(source: str, by: str = "") -> str:
    """CTEs ``pts`` (ranked score points) and ``om`` (threshold-free metrics) per group."""
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
    g0 AS (SELECT {lead}score, CAST(sum(default_flag) AS BIGINT) AS pos, CAST(sum(1-default_flag) AS BIGINT) AS neg FROM {source} GROUP BY {lead}score),
    pts AS (SELECT *, CAST(sum(pos) OVER (PARTITION BY {lead}1 ORDER BY score) AS BIGINT)-pos AS pb,
        CAST(sum(neg) OVER (PARTITION BY {lead}1 ORDER BY score) AS BIGINT)-neg AS nb,
        CAST(sum(pos) OVER ({part}) AS BIGINT) AS pt, CAST(sum(neg) OVER ({part}) AS BIGINT) AS nt FROM g0),
    cut AS (SELECT *, pt-pb AS tp, nt-nb AS fp, CAST(pt-pb AS DOUBLE)/pt AS tpr, CAST(nt-nb AS DOUBLE)/nt AS fpr FROM pts),
    om AS (SELECT {lead}CAST(max(pt)+max(nt) AS BIGINT) AS n, max(pt) AS positives,
        sum(CAST(pos AS DOUBLE)*(nb+neg/2e0))/(CAST(max(pt) AS DOUBLE)*max(nt)) AS auc_roc, greatest(0e0, max(tpr-fpr)) AS ks,
        max(abs(tpr-fpr)) AS ks_two_sided, sum(pos*(1e0-score)*(1e0-score)+neg*score*score)/CAST(max(pt)+max(nt) AS DOUBLE) AS brier,
        sum(-pos*ln(greatest({EPS}, least(1e0-{EPS}, score)))-neg*ln(1e0-greatest({EPS}, least(1e0-{EPS}, score))))/CAST(max(pt)+max(nt) AS DOUBLE) AS log_loss
        FROM cut {group})"""


def cells_sql(source: str, thresholds: str, by: str = "") -> str:
    """CTE ``cells`` (by, threshold, tn, fp, fn, tp) for a list of thresholds."""
    lead = f"{by}, " if by else ""
    return f"""cells AS (SELECT {lead}threshold, count(*) FILTER (score<threshold AND default_flag=0) AS tn,
      count(*) FILTER (score>=threshold AND default_flag=0) AS fp, count(*) FILTER (score<threshold AND default_flag=1) AS fn,
      count(*) FILTER (score>=threshold AND default_flag=1) AS tp
      FROM {source}, (SELECT unnest({thresholds}) AS threshold) GROUP BY {lead}threshold)"""


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b})<>0 THEN CAST({a} AS DOUBLE)/({b}) ELSE 0e0 END"


RATES = {
    "accuracy": div("tp+tn", "tp+fp+fn+tn"), "precision": div("tp", "tp+fp"), "recall": div("tp", "tp+fn"),
    "f1": div("2*tp", "2*tp+fp+fn"), "specificity": div("tn", "tn+fp"), "fpr": div("fp", "fp+tn"), "fnr": div("fn", "fn+tp"),
}
RATE_SQL = ", ".join(f"{e} AS {n}" for n, e in RATES.items())
ORDER_DOUBLES = ["auc_roc", "ks", "ks_two_sided", "brier", "log_loss"]


def items_sql(doubles, body, ctes="", digits=6) -> str:
    parts = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in doubles)
    return f"WITH {ITEMS}{', ' + ctes if ctes else ''} SELECT * REPLACE ({parts}) FROM ({body}) AS body"


@query("confusion_cells", f"WITH {APP}, {cells_sql('app', '[0.12e0]', 'period')} SELECT period, tn, fp, fn, tp FROM cells")
def _(spark, folder):
    return classifier.confusion(panel(spark, folder), 0.12, by=["period"])


@query("classification_metrics", rounded_sql(
    ORDER_DOUBLES + list(RATES), f"SELECT om.*, threshold, tp, fp, fn, tn, {RATE_SQL} FROM cells, om",
    ctes=point_ctes("app") + ", " + cells_sql("app", "[0.12e0, 0.5e0]"),
))
def _(spark, folder):
    return rounded(classifier.classification_metrics(panel(spark, folder), [0.12, 0.5]))


@query("order_line_metrics", items_sql(
    ORDER_DOUBLES + list(RATES), f"SELECT l_linestatus, om.* EXCLUDE (l_linestatus), threshold, tp, fp, fn, tn, {RATE_SQL} FROM cells JOIN om USING (l_linestatus)",
    point_ctes("items", "l_linestatus") + ", " + cells_sql("items", "[0.5e0]", "l_linestatus"),
))
def _(spark, folder):
    return rounded(classifier.classification_metrics(scored_items(spark, folder), [0.5], by=["l_linestatus"]))


@query("document_quality_metrics", f"WITH {DOCS}, {point_ctes('docs')} SELECT n, positives, " + ", ".join(f"round({c},6) AS {c}" for c in ORDER_DOUBLES) + " FROM om")
def _(spark, folder):
    return rounded(classifier.ranking_metrics(labelled_documents(spark, folder)))


@query("roc_auc", rounded_sql(["auc_roc"], "SELECT SEX, auc_roc FROM om", ctes=point_ctes("app", "SEX")))
def _(spark, folder):
    return rounded(classifier.ranking_metrics(panel(spark, folder), by=["SEX"]).select("SEX", "auc_roc"))


@query("ks_one_and_two_sided", items_sql(["ks", "ks_two_sided"], "SELECT ks, ks_two_sided FROM om", point_ctes("items")))
def _(spark, folder):
    return rounded(classifier.ranking_metrics(scored_items(spark, folder)).select("ks", "ks_two_sided"))


@query("brier_and_log_loss", rounded_sql(["brier", "log_loss"], "SELECT brier, log_loss FROM om", ctes=point_ctes("app")))
def _(spark, folder):
    return rounded(classifier.ranking_metrics(panel(spark, folder)).select("brier", "log_loss"))


SWEEP_RATES = ", ".join(f"{RATES[c]} AS {c}" for c in ("accuracy", "precision", "recall", "f1"))


def cost_sql(fp: int, fn: int = 10000) -> str:
    return f"CAST(fp AS DOUBLE)*{fp}+CAST(fn AS DOUBLE)*{fn}"


@query("threshold_sweep_99", rounded_sql(
    ["threshold", "accuracy", "precision", "recall", "f1"], f"SELECT *, {SWEEP_RATES}, {cost_sql(1000)} AS total_cost FROM cells",
    ctes=cells_sql("app", numbers(sweep.HUNDREDTHS)),
))
def _(spark, folder):
    return rounded(sweep.sweep(panel(spark, folder)))


@query("order_line_sweep_99", items_sql(
    ["threshold", "accuracy", "precision", "recall", "f1"], f"SELECT *, {SWEEP_RATES}, {cost_sql(1000)} AS total_cost FROM cells",
    cells_sql("items", numbers(sweep.HUNDREDTHS), "l_linestatus"),
))
def _(spark, folder):
    return rounded(sweep.sweep(scored_items(spark, folder), by=["l_linestatus"]))


NINETY = cells_sql("app", numbers(sweep.NINETY))
RATED = f"rated AS (SELECT *, {SWEEP_RATES}, {cost_sql(500)} AS total_cost FROM cells)"


@query("threshold_sweep_90", rounded_sql(
    ["threshold", "accuracy", "precision", "recall", "f1", "auc_roc", "ks", "brier"],
    "SELECT rated.*, auc_roc, ks_two_sided AS ks, brier FROM rated, om", ctes=f"{point_ctes('app')}, {NINETY}, {RATED}",
))
def _(spark, folder):
    return rounded(sweep.full_sweep(panel(spark, folder)))


@query("cost_optimal_threshold", rounded_sql(
    ["optimal_threshold", "savings_percentage"],
    f"""SELECT threshold AS optimal_threshold, optimal_cost, 10000e0*(tp+fn) AS baseline_cost, 10000e0*(tp+fn)-optimal_cost AS expected_savings,
    100e0*(10000e0*(tp+fn)-optimal_cost)/(10000e0*(tp+fn)) AS savings_percentage, tn, fp, fn, tp
    FROM (SELECT *, {cost_sql(1000)} AS optimal_cost FROM cells ORDER BY optimal_cost, threshold LIMIT 1)""",
    ctes=cells_sql("app", numbers(sweep.HUNDREDTHS)),
))
def _(spark, folder):
    return rounded(sweep.cost_optimal_threshold(panel(spark, folder)))


RULES = """rules AS (SELECT 'min_cost' AS rule, (SELECT threshold FROM rated ORDER BY total_cost, threshold LIMIT 1) AS threshold
    UNION ALL SELECT 'max_f1', (SELECT threshold FROM rated ORDER BY f1 DESC, threshold LIMIT 1)
    UNION ALL SELECT 'recall_target', coalesce((SELECT threshold FROM rated WHERE recall>=0.7e0 ORDER BY precision DESC, threshold LIMIT 1),
      (SELECT threshold FROM rated ORDER BY recall DESC, threshold LIMIT 1))
    UNION ALL SELECT 'youden', (SELECT score FROM cut ORDER BY tpr-fpr DESC, score DESC LIMIT 1))"""


@query("threshold_rules", rounded_sql(["threshold"], "SELECT * FROM rules", ctes=f"{point_ctes('app')}, {NINETY}, {RATED}, {RULES}"))
def _(spark, folder):
    return rounded(sweep.threshold_rules(panel(spark, folder)))


@query("final_threshold", rounded_sql(
    ["threshold", "accuracy", "precision", "recall", "f1"],
    """SELECT CASE pref WHEN 0 THEN 'both' WHEN 1 THEN 'recall' ELSE 'cost' END AS met, * EXCLUDE (pref) FROM
    (SELECT *, CASE WHEN recall>=0.7e0 AND precision>=0.3e0 THEN 0 WHEN recall>=0.7e0 THEN 1 ELSE 2 END AS pref FROM rated
     ORDER BY pref, total_cost, threshold LIMIT 1)""", ctes=f"{NINETY}, {RATED}",
))
def _(spark, folder):
    return rounded(sweep.final_threshold(sweep.sweep(panel(spark, folder), sweep.NINETY, sweep.NOTEBOOK_COSTS)))


@query("threshold_comparison", rounded_sql(
    ["threshold", "accuracy", "precision", "recall", "f1"],
    f"""SELECT a.rule, c.*, {SWEEP_RATES}, {cost_sql(500)} AS total_cost, {RATES["recall"]}>=0.7e0 AS recall_ok, {RATES["precision"]}>=0.3e0 AS precision_ok
    FROM asked a JOIN (SELECT threshold, count(*) FILTER (score<threshold AND default_flag=0) AS tn, count(*) FILTER (score>=threshold AND default_flag=0) AS fp,
      count(*) FILTER (score<threshold AND default_flag=1) AS fn, count(*) FILTER (score>=threshold AND default_flag=1) AS tp
      FROM app, (SELECT DISTINCT threshold FROM asked) GROUP BY threshold) c ON a.threshold=c.threshold""",
    ctes=f"{point_ctes('app')}, {NINETY}, {RATED}, {RULES}, asked AS (SELECT 'default' AS rule, 0.5e0 AS threshold UNION ALL SELECT * FROM rules)",
))
def _(spark, folder):
    return rounded(sweep.compare_thresholds(panel(spark, folder)))


@query("savings_of_threshold", f"""WITH {APP}, {cells_sql('app', '[0.12e0, 0.5e0]')}, k AS (SELECT threshold, {cost_sql(500)} AS cost FROM cells)
    SELECT d.cost AS default_cost, c.cost AS chosen_cost, d.cost-c.cost AS savings, 500e0 AS cost_fp, 10000e0 AS cost_fn
    FROM k d, k c WHERE d.threshold=0.5e0 AND c.threshold=0.12e0""")
def _(spark, folder):
    return sweep.savings_between(panel(spark, folder), 0.12)


BUSINESS = f"""SELECT period, threshold, tn, fp, fn, tp, fp*1000e0 AS cost_false_positives, fn*10000e0 AS cost_false_negatives, fp*1000e0+fn*10000e0 AS total_cost,
    (tp+fn)*10000e0 AS baseline_cost, (tp+fn)*10000e0-(fp*1000e0+fn*10000e0) AS expected_savings,
    100e0*({div("(tp+fn)*10000e0-(fp*1000e0+fn*10000e0)", "(tp+fn)*10000e0")}) AS savings_percentage,
    {div("(tp+fn)*10000e0-(fp*1000e0+fn*10000e0)", "(tp+fn)*10000e0")} AS roi FROM cells"""


@query("business_metrics", rounded_sql(["savings_percentage", "roi"], BUSINESS, ctes=cells_sql("app", "[0.12e0]", "period")))
def _(spark, folder):
    cells = sweep.threshold_cells(panel(spark, folder), [0.12], by=["period"])
    return rounded(classifier.business_metrics(cells))


@query("business_metrics_from_stored_savings", f"""WITH {APP}, {cells_sql('app', '[0.12e0]')}
    SELECT fp, fn, 5000e0 AS savings, fp*1000e0+fn*10000e0+5000e0 AS baseline_cost, round(5000e0/(fp*1000e0+fn*10000e0+5000e0),6) AS roi FROM cells""")
def _(spark, folder):
    cells = classifier.confusion(panel(spark, folder), 0.12).withColumn("savings", F.lit(5000.0))
    stored = classifier.business_metrics(cells, savings="savings")
    return rounded(stored.select("fp", "fn", "savings", "baseline_cost", "roi"))


def edges_sql(edges: str, value: str = "score", op: str = "<") -> str:
    return f"CAST(len(list_filter({edges}, lambda q: q{op}{value})) AS INT)"


TEN = numbers(calibration.equal_edges())


def reliability_sql(source: str, edges: str, extra: str = "") -> str:
    return f"""SELECT bin, count(*) AS n, avg(score) AS mean_score, avg(default_flag) AS positive_share
    FROM (SELECT *, {edges_sql(edges)} AS bin FROM {source}{extra}) GROUP BY bin"""


@query("reliability_equal_width", rounded_sql(["mean_score", "positive_share"], reliability_sql("app", TEN)))
def _(spark, folder):
    return rounded(calibration.reliability(panel(spark, folder)))


@query("reliability_quantile", rounded_sql(
    ["mean_score", "positive_share"], reliability_sql("app", "edges", ", e"),
    ctes=f"e AS (SELECT {quantiles_sql('list_sort(list(score))', [i / 10 for i in range(1, 10)])} AS edges FROM app)",
))
def _(spark, folder):
    return rounded(calibration.quantile_reliability(panel(spark, folder)))


@query("calibration_error", rounded_sql(
    ["ece"], "SELECT SEX, sum(n*abs(positive_share-mean_score))/sum(n) AS ece, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY SEX",
    ctes=f"r AS (SELECT SEX, bin, count(*) AS n, avg(score) AS mean_score, avg(default_flag) AS positive_share FROM (SELECT *, {edges_sql(TEN)} AS bin FROM app) GROUP BY SEX, bin)",
))
def _(spark, folder):
    return rounded(calibration.calibration_error(panel(spark, folder), by=["SEX"]))


@query("calibration_error_compat", rounded_sql(
    ["ece"], "SELECT sum(h[place]/CAST(total AS DOUBLE)*abs(positive_share-mean_score)) AS ece, max(total) AS n FROM r, hist",
    ctes=f"""low AS (SELECT *, score/3 AS s3 FROM app), r AS (SELECT *, row_number() OVER (ORDER BY bin) AS place FROM
      (SELECT bin, avg(s3) AS mean_score, avg(default_flag) AS positive_share FROM (SELECT *, {edges_sql(TEN, "s3")} AS bin FROM low) GROUP BY bin)),
      hist AS (SELECT list_transform(range(10), lambda b: len(list_filter(bs, lambda z: z=b))) AS h, len(bs) AS total FROM
        (SELECT list({edges_sql(TEN, "s3", "<=")}) AS bs FROM low))""",
))
def _(spark, folder):
    low = panel(spark, folder).withColumn("score", F.col("score") / 3)
    return rounded(calibration.calibration_error(low, compat=True))


@query("roc_curve", rounded_sql(
    ["fpr", "tpr"], "SELECT period, score AS threshold, fpr, tpr FROM cut UNION ALL SELECT period, CAST('Infinity' AS DOUBLE), 0e0, 0e0 FROM om",
    ctes=point_ctes("app", "period"),
))
def _(spark, folder):
    return rounded(curves.roc_points(panel(spark, folder), by=["period"]))


KEPT = """kept AS (SELECT * FROM (SELECT *, lag(pos) OVER (ORDER BY score) AS ppos, lag(neg) OVER (ORDER BY score) AS pneg, max(score) OVER () AS top FROM cut)
    WHERE ppos IS NULL OR score=top OR pos<>ppos OR neg<>pneg)"""


@query("roc_curve_corners", items_sql(
    ["fpr", "tpr"], "SELECT score AS threshold, fpr, tpr FROM kept UNION ALL SELECT CAST('Infinity' AS DOUBLE), 0e0, 0e0",
    f"{point_ctes('items')}, {KEPT}",
))
def _(spark, folder):
    return rounded(curves.roc_points(scored_items(spark, folder), drop_collinear=True))


@query("precision_recall_curve", rounded_sql(
    ["precision", "recall", "step_area", "baseline"],
    """SELECT score AS threshold, CAST(tp AS DOUBLE)/(tp+fp) AS precision, tpr AS recall,
    (CAST(pos AS DOUBLE)/pt)*(CAST(tp AS DOUBLE)/(tp+fp)+CASE WHEN tp-pos+fp-neg>0 THEN CAST(tp-pos AS DOUBLE)/(tp-pos+fp-neg) ELSE 1e0 END)/2 AS step_area,
    CAST(pt AS DOUBLE)/(pt+nt) AS baseline FROM cut""", ctes=point_ctes("app"),
))
def _(spark, folder):
    return rounded(curves.pr_points(panel(spark, folder)))


@query("curve_areas", items_sql(
    ["roc_area", "pr_area", "pr_baseline"],
    """SELECT l_returnflag, sum(CAST(neg AS DOUBLE)/nt*(tpr+CAST(tp-pos AS DOUBLE)/pt)/2) AS roc_area,
    sum((CAST(pos AS DOUBLE)/pt)*(CAST(tp AS DOUBLE)/(tp+fp)+CASE WHEN tp-pos+fp-neg>0 THEN CAST(tp-pos AS DOUBLE)/(tp-pos+fp-neg) ELSE 1e0 END)/2) AS pr_area,
    max(CAST(pt AS DOUBLE)/(pt+nt)) AS pr_baseline FROM cut GROUP BY l_returnflag""".replace("l_returnflag", "l_linestatus"),
    point_ctes("items", "l_linestatus"),
))
def _(spark, folder):
    return rounded(curves.curve_areas(scored_items(spark, folder), by=["l_linestatus"]))


@query("gain_curve", rounded_sql(
    ["population", "cumulative_good", "cumulative_bad", "gap"],
    "SELECT score AS threshold, CAST(tp+fp AS DOUBLE)/(pt+nt) AS population, fpr AS cumulative_good, tpr AS cumulative_bad, abs(tpr-fpr) AS gap FROM cut",
    ctes=point_ctes("app"),
))
def _(spark, folder):
    return rounded(curves.gain_points(panel(spark, folder)))


@query("youden_threshold", rounded_sql(
    ["youden"], "SELECT score AS threshold, tpr-fpr AS youden FROM cut ORDER BY tpr-fpr DESC, score DESC LIMIT 1", ctes=point_ctes("app"),
))
def _(spark, folder):
    return rounded(curves.youden_threshold(panel(spark, folder)))


@query("nearest_roc_points", rounded_sql(
    ["fpr", "tpr"], """SELECT asked, threshold, fpr, tpr FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY abs(threshold-asked), threshold DESC) AS r
    FROM (SELECT score AS threshold, fpr, tpr FROM kept), (SELECT unnest([0.5e0, 0.12e0, 0.27e0]) AS asked)) WHERE r=1""",
    ctes=f"{point_ctes('app')}, {KEPT}",
))
def _(spark, folder):
    return rounded(curves.nearest_roc_points(panel(spark, folder), [0.5, 0.12, 0.27]))


@query("highest_scored_row", f"WITH {APP} SELECT ID, score, AGE, SEX FROM app ORDER BY score DESC, ID LIMIT 1")
def _(spark, folder):
    return curves.highest_scored(panel(spark, folder).select("ID", "score", "AGE", "SEX"))


def report_sql() -> str:
    good = [div("tn", "tn+fn"), div("tn", "tn+fp"), div("2*tn", "2*tn+fn+fp")]
    bad = [div("tp", "tp+fp"), div("tp", "tp+fn"), div("2*tp", "2*tp+fp+fn")]
    acc = [RATES["accuracy"]] * 3
    macro = [f"(({a})+({b}))/2" for a, b in zip(good, bad)]
    weighted = [f"(({a})*(tn+fp)+({b})*(tp+fn))/(tn+fp+fn+tp)" for a, b in zip(good, bad)]
    rows = [("No Default", good, "tn+fp"), ("Default", bad, "tp+fn"), ("accuracy", acc, "tn+fp+fn+tp"),
            ("macro avg", macro, "tn+fp+fn+tp"), ("weighted avg", weighted, "tn+fp+fn+tp")]
    return " UNION ALL ".join(
        f"SELECT '{n}' AS class, {c[0]} AS precision, {c[1]} AS recall, {c[2]} AS f1, {s} AS support FROM cells" for n, c, s in rows
    )


@query("classification_report", rounded_sql(["precision", "recall", "f1"], report_sql(), ctes=cells_sql("app", "[0.5e0]")))
def _(spark, folder):
    return rounded(classifier.class_report(classifier.confusion(panel(spark, folder), 0.5)))


CREDIT = ["auc_roc", "recall", "precision", "f1", "brier", "ks", "tn", "fp", "fn", "tp", "specificity"]
SPLIT_APP = "sp AS (SELECT *, CASE WHEN fold=0 THEN 'test' WHEN fold=1 THEN 'validation' ELSE 'train' END AS split FROM app)"


def split_panel(spark, folder):
    name = F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "validation").otherwise("train")
    return panel(spark, folder).withColumn("split", name)


@query("credit_metrics_by_split", rounded_sql(
    ["auc_roc", "recall", "precision", "f1", "brier", "ks", "specificity"],
    "SELECT split, threshold, " + ", ".join(RATES.get(c, c) + f" AS {c}" for c in CREDIT) + " FROM cells JOIN om USING (split)",
    ctes=f"{SPLIT_APP}, {point_ctes('sp', 'split')}, {cells_sql('sp', '[0.12e0, 0.5e0]', 'split')}",
))
def _(spark, folder):
    return rounded(credit_metrics(split_panel(spark, folder), [0.12, 0.5]))


@query("named_credit_metrics", f"""WITH {APP}, {SPLIT_APP}, {point_ctes('sp', 'split')}, {cells_sql('sp', '[0.12e0, 0.5e0]', 'split')},
    w AS (SELECT CASE split WHEN 'validation' THEN 'val' ELSE split END || CASE WHEN threshold=0.12e0 THEN '_optimal_' ELSE '_' END AS prefix, """
    + ", ".join(f"CAST({RATES.get(c, c)} AS DOUBLE) AS {c}" for c in CREDIT) + f""" FROM cells JOIN om USING (split))
    SELECT prefix || m AS metric, round(x, 6) AS value FROM (SELECT prefix, unnest({CREDIT!r}) AS m, unnest([{', '.join(CREDIT)}]) AS x FROM w)""")
def _(spark, folder):
    return rounded(named_credit_metrics(credit_metrics(split_panel(spark, folder), [0.12, 0.5]), 0.12))


EVALUATED = {
    "optimal_threshold": "threshold", "n_samples": "n", "n_defaults": "positives", "default_rate": "CAST(positives AS DOUBLE)/n",
    "accuracy": RATES["accuracy"], "precision": RATES["precision"], "recall": RATES["recall"], "f1_score": RATES["f1"],
    "specificity": RATES["specificity"], "auc_roc": "auc_roc", "brier_score": "brier", "ks_statistic": "ks",
    "true_positives": "tp", "true_negatives": "tn", "false_positives": "fp", "false_negatives": "fn",
    "true_positive_rate": RATES["recall"], "false_positive_rate": RATES["fpr"], "false_negative_rate": RATES["fnr"],
    "total_cost": cost_sql(1000), "cost_false_positives": "fp*1000e0", "cost_false_negatives": "fn*10000e0",
    "baseline_cost": "(tp+fn)*10000e0", "expected_savings": f"(tp+fn)*10000e0-({cost_sql(1000)})",
    "savings_percentage": f"100e0*((tp+fn)*10000e0-({cost_sql(1000)}))/((tp+fn)*10000e0)",
    "roi": f"((tp+fn)*10000e0-({cost_sql(1000)}))/((tp+fn)*10000e0)",
}
EVALUATION_DOUBLES = ["default_rate", "accuracy", "precision", "recall", "f1_score", "specificity", "auc_roc", "brier_score", "ks_statistic",
                      "true_positive_rate", "false_positive_rate", "false_negative_rate", "savings_percentage", "roi"]


@query("evaluation_row", rounded_sql(
    EVALUATION_DOUBLES, "SELECT period, " + ", ".join(f"{e} AS {n}" for n, e in EVALUATED.items()) + ", tp, fp, fn, tn FROM cells JOIN om USING (period)",
    ctes=f"{point_ctes('app', 'period')}, {cells_sql('app', '[0.12e0]', 'period')}",
))
def _(spark, folder):
    return rounded(evaluation_row(panel(spark, folder), score="score", by=("period",)))


def evaluation_sql() -> str:
    sections = {"size": list(EVALUATED)[:4], "classification": list(EVALUATED)[4:19], "business": list(EVALUATED)[19:]}
    rows = [
        f"SELECT '{s}' AS section, '{n}' AS metric, CAST({EVALUATED[n]} AS DOUBLE) AS value FROM cells, om"
        for s, names in sections.items() for n in names
    ]
    rows.append("SELECT 'calibration', 'expected_calibration_error', (SELECT sum(n*abs(positive_share-mean_score))/sum(n) FROM r)")
    rows += [
        f"SELECT 'classification_report', class || ' {m}', CAST({m} AS DOUBLE) FROM rep" for m in ("precision", "recall", "f1", "support")
    ]
    return " UNION ALL ".join(rows)


@query("full_evaluation", rounded_sql(
    ["value"], evaluation_sql(),
    ctes=f"seen AS (SELECT * FROM app WHERE ID%10<>0), {point_ctes('seen')}, {cells_sql('seen', '[0.12e0]')}, "
         f"r AS ({reliability_sql('seen', TEN)}), rep AS ({report_sql()})",
))
def _(spark, folder):
    app = panel(spark, folder)
    predictions = app.select("ID", F.col("score").alias("default_probability"))
    return rounded(evaluate(predictions, app.where("ID % 10 <> 0").select("ID", v.TARGET)))


@query("target_shares", f"WITH {APP} SELECT default_flag, count(*) AS n, round(count(*)/CAST(sum(count(*)) OVER () AS DOUBLE),6) AS share FROM app GROUP BY default_flag")
def _(spark, folder):
    return rounded(summaries.value_shares(panel(spark, folder), v.TARGET))


CATEGORIES = ["SEX", "EDUCATION", "MARRIAGE"] + v.DELAYS


@query("category_target_counts", f"WITH {APP} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS \"value\", default_flag AS target, count(*) AS n FROM app GROUP BY {c}, default_flag" for c in CATEGORIES
))
def _(spark, folder):
    return summaries.category_target_counts(panel(spark, folder), CATEGORIES)


SEGMENTS = ["SEX", "EDUCATION", "MARRIAGE", "AGE"]


@query("segment_default_rates", rounded_sql(["default_rate", "share"], " UNION ALL ".join(
    f"SELECT '{c}' AS segment, CAST({c} AS VARCHAR) AS \"value\", count(*) AS n, avg(default_flag) AS default_rate, count(*)/CAST((SELECT count(*) FROM app) AS DOUBLE) AS share FROM app GROUP BY {c}"
    for c in SEGMENTS
)))
def _(spark, folder):
    return rounded(summaries.segment_rates(panel(spark, folder), SEGMENTS))


BINNED = ["l_quantity", "l_extendedprice", "l_discount"]


@query("histograms_30", f"""WITH x AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM lineitem" for c in BINNED)}),
    m AS (SELECT feature, min(value) AS start, (max(value)-min(value))/30 AS width FROM x GROUP BY feature),
    s AS (SELECT feature, start, width, CAST(r.range AS INT) AS bin FROM m, range(30) r)
    SELECT feature, bin, round(start+bin*width,6) AS low, round(start+(bin+1)*width,6) AS high,
      (SELECT count(*) FROM x WHERE x.feature=s.feature AND value>=start+bin*width AND (bin=29 OR value<start+(bin+1)*width)) AS n FROM s""")
def _(spark, folder):
    return rounded(summaries.histograms(table(spark, folder, "lineitem"), BINNED))


@query("histograms_30_clients", f"""WITH {APP}, x AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM app" for c in AMOUNTS)}),
    m AS (SELECT feature, min(value) AS start, (max(value)-min(value))/30 AS width FROM x GROUP BY feature),
    g AS (SELECT feature, start, width, value, CAST(least(floor((value-start)/width),29) AS INT) AS guess FROM x JOIN m USING (feature)),
    b AS (SELECT feature, CASE WHEN value<start+guess*width THEN guess-1 WHEN guess<29 AND value>=start+(guess+1)*width THEN guess+1 ELSE guess END AS bin,
      count(*) AS n FROM g GROUP BY ALL),
    s AS (SELECT feature, start, width, CAST(r.range AS INT) AS bin FROM m, range(30) r)
    SELECT s.feature, s.bin, round(start+s.bin*width,6) AS low, round(start+(s.bin+1)*width,6) AS high, CAST(coalesce(n,0) AS BIGINT) AS n
    FROM s LEFT JOIN b ON b.feature=s.feature AND b.bin=s.bin""")
def _(spark, folder):
    return rounded(summaries.histograms(panel(spark, folder), AMOUNTS))


CORRELATED = ["LIMIT_BAL", "AGE", "PAY_0", "BILL_AMT1", "BILL_AMT2", "PAY_AMT1", "default_flag"]


def correlation_sql(columns) -> str:
    return " UNION ALL ".join(
        f'SELECT \'{a}\' AS "left", \'{b}\' AS "right", corr({a}, {b}) AS r FROM app' for a in columns for b in columns
    )


@query("correlation_matrix", rounded_sql(["r"], correlation_sql(CORRELATED), 4))
def _(spark, folder):
    return rounded(summaries.correlations(panel(spark, folder), CORRELATED), 4)


@query("correlation_matrix_pairwise", rounded_sql(["r"], correlation_sql(CORRELATED), 4))
def _(spark, folder):
    return rounded(summaries.correlations(panel(spark, folder), CORRELATED, pairwise=True), 4)


@query("target_correlations", rounded_sql(["r"], "SELECT feature, r, CAST(row_number() OVER (ORDER BY abs(r) DESC, feature) AS INT) AS position FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, default_flag) AS r FROM app" for c in v.RAW_FEATURES
) + ")"))
def _(spark, folder):
    return rounded(summaries.target_correlations(panel(spark, folder), v.RAW_FEATURES))


RUN_CTES = f"{point_ctes('app', 'fold')}, {cells_sql('app', '[0.12e0]', 'fold')}"


def fold_runs(spark, folder):
    """One run per fold and period pair, with its metrics in a map."""
    rows = classifier.classification_metrics(panel(spark, folder), by=["fold"])
    run, experiment = F.concat(F.lit("run-"), F.col("fold").cast("string")), F.concat(F.lit("exp-"), (F.col("fold") % 2).cast("string"))
    long = classifier.to_long(rows.withColumns({"run": run, "exp": experiment}), ["auc_roc", "ks", "brier"], ["run", "exp"])
    return runs_from_metrics(long, "run", "exp")


@query("best_run", rounded_sql(
    ["value"], """SELECT experiment, run_id, value FROM (SELECT 'exp-'||(fold%2) AS experiment, 'run-'||fold AS run_id, auc_roc AS value,
    row_number() OVER (PARTITION BY fold%2 ORDER BY auc_roc DESC, fold) AS r FROM om) WHERE r=1""", ctes=RUN_CTES,
))
def _(spark, folder):
    return rounded(ranking.best_run(fold_runs(spark, folder)))


@query("model_ranking", rounded_sql(
    ["auc_roc", "ks_statistic"], """SELECT fold, auc_roc, ks AS ks_statistic, (tp+fn)*10000e0-(fp*1000e0+fn*10000e0) AS expected_savings,
    CAST(rank() OVER (ORDER BY auc_roc DESC, ks DESC, (tp+fn)*10000e0-(fp*1000e0+fn*10000e0) DESC) AS INT) AS "rank" FROM om JOIN cells USING (fold)""", ctes=RUN_CTES,
))
def _(spark, folder):
    rows = classifier.business_metrics(classifier.classification_metrics(panel(spark, folder), by=["fold"]))
    return rounded(ranking.rank_models(rows.select("fold", "auc_roc", F.col("ks").alias("ks_statistic"), "expected_savings")))


@query("model_comparison", rounded_sql(
    ["auc_roc", "brier_score"], " UNION ALL ".join(f"SELECT 'period {p}' AS model, auc_roc, brier AS brier_score FROM om WHERE period={p}" for p in (0, 1)),
    ctes=point_ctes("app", "period"),
))
def _(spark, folder):
    rows = pin(classifier.ranking_metrics(panel(spark, folder), by=["period"]).withColumnRenamed("brier", "brier_score"))
    tables = [rows.where(F.col("period") == p).withColumn("model", F.lit(f"period {p}")) for p in (0, 1)]
    return rounded(ranking.compare_models(tables, ["model", "auc_roc", "brier_score"]))


@query("calibration_choice", rounded_sql(["brier"], "SELECT fold, brier FROM om ORDER BY brier, fold LIMIT 1", ctes=point_ctes("app", "fold")))
def _(spark, folder):
    return rounded(ranking.lowest(classifier.ranking_metrics(panel(spark, folder), by=["fold"]).select("fold", "brier"), "brier", "fold"))


@query("top_features_by_spread", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(stddev_samp({c})/avg({c}),6) AS importance FROM lineitem" for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
) + ") ORDER BY importance DESC, feature LIMIT 3")
def _(spark, folder):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    one = table(spark, folder, "lineitem").agg(*[(F.stddev_samp(c) / F.avg(c)).alias(c) for c in columns])
    return ranking.top_rows(rounded(one.unpivot([], columns, "feature", "importance")), "importance", 3, "feature")


QUARTERS = f"qs AS (SELECT {quantiles_sql('list_sort(list(CAST(AGE AS DOUBLE)))', [0.25, 0.5, 0.75])} AS q FROM app)"
QUARTER_SQL = "CASE WHEN AGE<=q[1] THEN 'Q1 (Jóvenes)' WHEN AGE<=q[2] THEN 'Q2' WHEN AGE<=q[3] THEN 'Q3' ELSE 'Q4 (Mayores)' END"


@query("quartile_or_value_groups", f"""WITH {APP}, {QUARTERS} SELECT ID, {QUARTER_SQL} AS age_group, 'Grupo ' || MARRIAGE AS marriage_group FROM app, qs""")
def _(spark, folder):
    rows = ranking.with_value_groups(panel(spark, folder), "AGE", "age_group")
    return ranking.with_value_groups(rows, "MARRIAGE", "marriage_group").select("ID", "age_group", "marriage_group")


@query("band_default_rates", rounded_sql(["rate"], "SELECT risk_band, count(*) AS n, avg(default_flag) AS rate FROM p GROUP BY risk_band", ctes=PREDICTIONS))
def _(spark, folder):
    rows = with_decisions(panel(spark, folder), keep=["ID", v.TARGET])
    return rounded(rows.groupBy("risk_band").agg(F.count(F.lit(1)).alias("n"), F.avg(v.TARGET).alias("rate")))
