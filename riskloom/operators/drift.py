"""Population and feature drift: PSI, CSI, two-sample KS, and the reports built on them."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.functions.decisions import psi_status
from riskloom.operators.calibration import edges_below
from riskloom.operators.classifier import classification_metrics, cut_counts, ranked_points, ranking_metrics, to_long
from riskloom.operators.ordered import ONE_TASK_ROWS, long_form, median, quantiles
from riskloom.operators.summaries import histograms

log = logging.getLogger(__name__)


def bin_edges(reference: DataFrame, features: Sequence[str], bins: int = 10, method: str = "exact") -> DataFrame:
    """Rows (feature, edges): interior quantiles of the reference; repeated edges are kept."""
    shares = [i / bins for i in range(1, bins)]
    return quantiles(reference, features, shares, method=method).select("feature", F.col("q").alias("edges"))


def _place(values: DataFrame, edges: DataFrame, bins: int) -> DataFrame:
    """Left-closed bin numbers; edges are one row per feature."""
    placed = values.join(F.broadcast(edges), "feature")
    return placed.withColumn("bin", edges_below(F.col("value"), F.col("edges"), True, bins - 1)).drop("edges")


def bin_counts(
    reference: DataFrame, production: DataFrame, features: Sequence[str], bins: int = 10, method: str = "exact"
) -> DataFrame:
    """Rows (feature, bin, expected, actual) for every bin, the empty ones too.

    All features are counted in one pass over both tables; only (feature, bin) partial
    counts are shuffled.
    """
    edges = bin_edges(reference, features, bins, method)
    sides = [
        long_form(table, features).withColumn("_side", F.lit(side)) for side, table in ((0, reference), (1, production))
    ]
    counted = (
        _place(sides[0].unionByName(sides[1]), edges, bins).groupBy("feature", F.col("bin").alias("_bin"))
        .agg(F.count_if(F.col("_side") == 0).alias("_e"), F.count_if(F.col("_side") == 1).alias("_a"))
    )
    return spread_over_bins(counted, ["feature"], bins)


def spread_over_bins(counted: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """(by, _bin, _e, _a) partial counts as one row for each of the bins per group."""
    here = F.col("_bin") == F.col("bin")
    every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    return counted.select("*", every).groupBy(*by, "bin").agg(
        F.sum(F.when(here, F.col("_e")).otherwise(0)).alias("expected"),
        F.sum(F.when(here, F.col("_a")).otherwise(0)).alias("actual"),
    )


def index_of_counts(counts: DataFrame, by: Sequence[str] = ("feature",), eps: float = v.PSI_EPSILON) -> DataFrame:
    """Stability index per group from per-bin counts.

    Shares are (count + eps) / n, not renormalised; every bin counts.  Groups lacking one
    side have no index.
    """
    cells = F.collect_list(F.struct("expected", "actual"))  # one entry per bin
    totals = counts.groupBy(*by).agg(
        cells.alias("_cells"), F.sum("expected").alias("n_expected"), F.sum("actual").alias("n_actual")
    ).where("n_expected > 0 AND n_actual > 0")

    def term(cell: Column) -> Column:
        e = (cell["expected"] + F.lit(eps)) / F.col("n_expected")
        a = (cell["actual"] + F.lit(eps)) / F.col("n_actual")
        return (a - e) * F.log(a / e)

    index = F.aggregate("_cells", F.lit(0.0), lambda acc, cell: acc + term(cell))
    return totals.select(*by, index.alias("psi"), "n_expected", "n_actual")


def psi(
    reference: DataFrame, production: DataFrame, column: str = "score", bins: int = 10, eps: float = v.PSI_EPSILON,
    method: str = "exact",
) -> DataFrame:
    """One row (psi, n_expected, n_actual)."""
    return index_of_counts(bin_counts(reference, production, [column], bins, method), eps=eps).drop("feature")


def feature_indices(
    reference: DataFrame, production: DataFrame, features: Sequence[str], bins: int = 10, eps: float = v.PSI_EPSILON,
    method: str = "exact",
) -> DataFrame:
    """Rows (feature, psi, n_expected, n_actual), one job for all features.

    A feature the reference lacks gets 0 with a warning; one that production lacks is skipped.
    """
    present = [f for f in features if f in production.columns]
    known = [f for f in present if f in reference.columns]
    rows = index_of_counts(bin_counts(reference, production, known, bins, method), eps=eps)
    unknown = [f for f in present if f not in known]
    for feature in unknown:
        log.warning("feature %s not found in the reference", feature)
    if unknown:
        schema = "feature string, psi double, n_expected bigint, n_actual bigint"
        rows = rows.unionByName(reference.sparkSession.createDataFrame([(f, 0.0, None, None) for f in unknown], schema))
    return rows


def csi(
    reference: DataFrame, production: DataFrame, features: Sequence[str] | None = None, bins: int = 10,
    eps: float = v.PSI_EPSILON, method: str = "exact",
) -> DataFrame:
    """Rows (feature, csi) of the asked features, all of the reference's by default."""
    features = list(reference.columns if features is None else features)
    return feature_indices(reference, production, features, bins, eps, method).select("feature", F.col("psi").alias("csi"))


def indices_by(
    reference: DataFrame, production: DataFrame, features: Sequence[str], by: Sequence[str], bins: int = 10,
    eps: float = v.PSI_EPSILON, method: str = "exact",
) -> DataFrame:
    """Rows (by, feature, psi, n_expected, n_actual): each production group against one reference.

    The reference is binned once; production is counted per (group, feature, bin) in one pass.
    """
    edges = bin_edges(reference, features, bins, method)
    expected = spread_over_bins(
        _place(long_form(reference, features), edges, bins).groupBy("feature", F.col("bin").alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_e"), F.lit(0).alias("_a")), ["feature"], bins,
    ).select("feature", "bin", "expected")
    groups = [*by, "feature"]
    actual = spread_over_bins(
        _place(long_form(production, features, by), edges, bins).groupBy(*groups, F.col("bin").alias("_bin"))
        .agg(F.lit(0).alias("_e"), F.count(F.lit(1)).alias("_a")), groups, bins,
    ).drop("expected")
    both = actual.join(F.broadcast(expected), ["feature", "bin"])  # bins rows per column
    return index_of_counts(both, groups, eps)


def feature_report(indices: DataFrame, warning: float = v.PSI_WARNING, critical: float = v.PSI_CRITICAL) -> DataFrame:
    """CSI rows with status (from the unrounded value) and the drifted flag."""
    status = psi_status(F.col("csi"), warning, critical)
    return indices.select(
        "feature", F.round("csi", 4).alias("csi"), status.alias("status"),
        status.isin("WARNING", "CRITICAL").alias("drifted"),
    )


def drifted_features(report: DataFrame) -> DataFrame:
    """One row: how many features drifted, and their sorted names."""
    names = F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("feature"))))
    return report.agg(names.alias("drifted_features"), F.count_if("drifted").alias("drifted_count"))


def two_sample_ks(
    reference: DataFrame, production: DataFrame, column: str = "score", one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """One row (ks, n_reference, n_production): the largest gap between the two distribution functions."""
    both = reference.select(F.col(column).cast("double").alias("score"), F.lit(0).alias("side")).unionByName(
        production.select(F.col(column).cast("double").alias("score"), F.lit(1).alias("side"))
    )
    above_production, above_reference = cut_counts()
    gap = F.abs(
        F.try_divide(above_production, F.col("pos_total")) - F.try_divide(above_reference, F.col("neg_total"))
    )
    return ranked_points(both, "score", "side", one_task_rows=one_task_rows).agg(
        F.max(gap).alias("ks"), F.max("neg_total").alias("n_reference"), F.max("pos_total").alias("n_production")
    )


def with_ks_p_value(ks: DataFrame, warning: float = 0.05, critical: float = 0.01, terms: int = 100) -> DataFrame:
    """Asymptotic p-value of a two-sample KS row, and its gate."""
    n = F.col("n_reference").cast("double") * F.col("n_production") / (F.col("n_reference") + F.col("n_production"))
    x = F.col("ks") * F.sqrt(n)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x),
    )
    p = F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))
    status = F.when(F.col("p_value") < critical, "severe").when(F.col("p_value") < warning, "drift").otherwise("none")
    return ks.withColumn("p_value", p).withColumn("p_status", status)


def baseline_ks(
    reference: DataFrame, score: str = "score", label: str | None = v.TARGET, compat: bool = False
) -> DataFrame:
    """One row (baseline): KS of the reference labels.

    ``compat`` splits the scores at their own median instead, which yields 1 whenever both
    halves are filled.
    """
    if not compat:
        return ranking_metrics(reference, score, label).select(F.col("ks_two_sided").alias("baseline"))
    halves = reference.crossJoin(F.broadcast(median(reference, score, name="_middle")))  # one row
    upper = (F.col(score) > F.col("_middle")).cast("int")
    return ranking_metrics(halves.withColumn("_upper", upper), score, "_upper").select(
        F.coalesce("ks_two_sided", F.lit(0.0)).alias("baseline")
    )


def with_ks_decay(row: DataFrame, limit: float = v.KS_DECAY_LIMIT) -> DataFrame:
    """Adds decay and status to a row with ``baseline`` and ``current``."""
    decay = F.when(F.col("baseline") > 0, (F.col("baseline") - F.col("current")) / F.col("baseline")).otherwise(0.0)
    return row.withColumn("ks_decay", decay).withColumn(
        "ks_status", F.when(F.col("ks_decay") > limit, "ALERT").otherwise("OK")
    )


def score_stats(reference: DataFrame, production: DataFrame, score: str = "score") -> DataFrame:
    """One row of mean, population deviation and exact median on both sides."""
    both = both_sides(reference, production, [F.col(score).alias("score")])
    moments = both.groupBy("side").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    rows = moments.join(F.broadcast(median(both, "score", ["side"])), "side")  # two rows
    cells = [
        F.max(F.when(F.col("side") == side, F.col(stat))).alias(f"{stat}_{side}")
        for stat in ("mean", "std", "median") for side in ("reference", "production")
    ]
    return rows.agg(*cells)


# fixed values: alert and recommendation texts
PSI_WARNING_TEXT = "PSI moderado (%.3f): Investigar distribución de scores"
PSI_CRITICAL_TEXT = "PSI crítico (%.3f): Considerar reentrenamiento"
KS_DECAY_TEXT = "KS decay significativo (%.1f%%): Rendimiento degradado"
RECOMMENDATIONS = {
    "CRITICAL": "Reentrenamiento urgente recomendado. Considerar rollback a versión anterior.",
    "WARNING": "Investigar causas del drift. Preparar datos para potencial reentrenamiento.",
    "HEALTHY": "Modelo estable. Continuar monitoreo regular.",
}


def drift_alerts() -> Column:
    """Array of alert texts from ``psi``, ``psi_status``, ``ks_decay`` and ``ks_status``."""
    shown = F.round("psi", 4)
    decay = F.round("ks_decay", 4) * 100
    return F.array_compact(
        F.array(
            F.when(F.col("psi_status") == "WARNING", F.format_string(PSI_WARNING_TEXT, shown)),
            F.when(F.col("psi_status") == "CRITICAL", F.format_string(PSI_CRITICAL_TEXT, shown)),
            F.when(F.col("ks_status") == "ALERT", F.format_string(KS_DECAY_TEXT, decay)),
        )
    )


def both_sides(reference: DataFrame, production: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The two tables stacked, with ``side``."""
    marked = [t.select(F.lit(name).alias("side"), *columns) for t, name in ((reference, "reference"), (production, "production"))]
    return marked[0].unionByName(marked[1])


def monitor_scores(
    reference: DataFrame, production: DataFrame, score: str = "score", label: str | None = None,
    compat: bool = False, index: DataFrame | None = None,
) -> DataFrame:
    """One row: PSI with status, score statistics, KS decay if labels are given, alert texts.

    ``index`` is the PSI row if it is known already.
    """
    row = psi(reference, production, score) if index is None else index
    row = row.select("psi", F.col("n_actual").alias("n_samples")).withColumn("psi_status", psi_status(F.col("psi")))
    row = row.crossJoin(F.broadcast(score_stats(reference, production, score)))  # one row each
    if label is None:
        empty = {"baseline": "double", "current": "double", "ks_decay": "double", "ks_status": "string"}
        row = row.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})
    else:
        ks = ranking_metrics(both_sides(reference, production, [score, label]), score, label, ["side"])
        at = lambda side: F.max(F.when(F.col("side") == side, F.col("ks_two_sided")))
        pair = ks.agg(at("reference").alias("baseline"), at("production").alias("current"))
        if compat:
            pair = pair.drop("baseline").crossJoin(F.broadcast(baseline_ks(reference, score, label, compat)))
        row = row.crossJoin(F.broadcast(with_ks_decay(pair)))
    return row.withColumn("alerts", drift_alerts())


def overall_status(most_drifted: int = 3) -> Column:
    """From ``psi_status``, ``ks_status`` and ``drifted_count``."""
    ks = F.coalesce("ks_status", F.lit("OK"))
    return (
        F.when((F.col("psi_status") == "CRITICAL") | (ks == "ALERT"), "CRITICAL")
        .when((F.col("psi_status") == "WARNING") | (F.col("drifted_count") > most_drifted), "WARNING")
        .otherwise("HEALTHY")
    )


def recommendation(status: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for pair in RECOMMENDATIONS.items() for x in pair])
    return F.element_at(texts, status)


def service_check(
    reference: DataFrame, scores: DataFrame, score: str = "score", eps: float = v.SERVICE_PSI_EPSILON
) -> DataFrame:
    """PSI and KS of new scores against a baseline, with sizes and lower-case status.

    An empty side is an error.
    """
    index = psi(reference, scores, score, eps=eps).select("psi")
    row = two_sample_ks(reference, scores, score).join(F.broadcast(index), how="left")  # one row each
    sized = F.assert_true(
        (F.coalesce("n_reference", F.lit(0)) > 0) & (F.coalesce("n_production", F.lit(0)) > 0),
        "drift check needs scores on both sides",
    )
    return row.select(
        psi_status(F.col("psi"), lower_case=True).alias("status"),
        F.round("psi", 4).alias("psi"), F.round("ks", 4).alias("ks_statistic"),
        F.col("n_reference").alias("reference_size"), F.col("n_production").alias("current_size"),
        sized.alias("_sized"),
    ).where(F.col("_sized").isNull()).drop("_sized")


def equal_width_psi(
    reference: DataFrame, production: DataFrame, column: str, bins: int = 10, eps: float | None = None
) -> DataFrame:
    """The documented form: each side binned over its own range, no epsilon.  Kept apart from ``psi``.

    A bin that is empty on one side only makes the index infinite, as the formula says, or
    counts with the share ``eps`` if that is given; a bin empty on both sides adds nothing.
    """
    sides = [
        histograms(t, [column], bins).select("bin", F.col("n").alias(name))
        for t, name in ((reference, "expected"), (production, "actual"))
    ]
    counts = sides[0].join(sides[1], "bin")
    totals = counts.agg(F.sum("expected").alias("_e"), F.sum("actual").alias("_a"))
    e, a = F.col("expected") / F.col("_e"), F.col("actual") / F.col("_a")
    if eps is not None:
        e, a = F.greatest(e, F.lit(float(eps))), F.greatest(a, F.lit(float(eps)))
    term = F.when((e > 0) & (a > 0), (e - a) * (F.log(e) - F.log(a))).when(e != a, F.lit(float("inf"))).otherwise(0.0)
    return counts.crossJoin(F.broadcast(totals)).agg(F.sum(term).alias("psi"))


# fixed values: proxy limits (share above 0.5, mean score, share below 0.2)
PROXY_LIMITS = {"high_risk_share": (0.15, 0.30), "mean_score": (0.15, 0.35), "approval_share": (0.25, 0.55)}


def proxy_aggregates(score: str = "score") -> dict[str, Column]:
    s = F.col(score)
    return {
        "high_risk_share": F.avg((s > 0.5).cast("double")),
        "mean_score": F.avg(s),
        "approval_share": F.avg((s < 0.2).cast("double")),
    }


def proxy_alerts() -> Column:
    return F.array_compact(
        F.array(*[
            F.when((F.col(name) < low) | (F.col(name) > high), F.lit(name))
            for name, (low, high) in PROXY_LIMITS.items()
        ])
    )


def monitor_proxies(df: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Label-free monitors per group (e.g. per day) and the names of those out of range."""
    rows = df.groupBy(*by).agg(F.count(F.col(score)).alias("n"), *[x.alias(n) for n, x in proxy_aggregates(score).items()])
    return rows.withColumn("alerts", proxy_alerts())


# fixed values: gates of the labelled monitors (metric, operator that alerts, bound)
PERFORMANCE_GATES = [
    ("auc_roc", "<", 0.75), ("ks", "<", 0.35), ("brier", ">", 0.18), ("recall", "<", 0.80), ("precision", "<", 0.25),
]


def monitor_performance(
    df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = v.TARGET,
    threshold: float = v.DECISION_THRESHOLD,
) -> DataFrame:
    """Rows (by, metric, value, bound, alert) of the labelled gates, per group such as a month."""
    names = [m for m, _, _ in PERFORMANCE_GATES]
    values = to_long(classification_metrics(df, [threshold], score, label, by), names, by)
    gates = df.sparkSession.createDataFrame(PERFORMANCE_GATES, "metric string, op string, bound double")
    breach = F.when(F.col("op") == "<", F.col("value") < F.col("bound")).otherwise(F.col("value") > F.col("bound"))
    return values.join(F.broadcast(gates), "metric").withColumn("alert", breach)


def retrain_trigger(row: DataFrame) -> DataFrame:
    """Adds ``retrain`` to a row with ``psi``, ``auc_roc`` and ``ks_decay``."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("psi") > 0.25, "psi"), F.when(F.col("auc_roc") < 0.75, "auc_roc"),
            F.when(F.col("ks_decay") > 0.10, "ks_decay"),
        )
    )
    return row.withColumn("reasons", reasons).withColumn("retrain", F.size("reasons") > 0)

