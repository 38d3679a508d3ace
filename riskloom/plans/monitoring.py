"""Drift monitoring of a production table against a reference table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.operators import drift
from riskloom.runtime import pin
from riskloom.sources.files import append_report


def drift_report(
    reference: DataFrame, production: DataFrame, features: Sequence[str], score: str = "score",
    label: str | None = None, compat: bool = False,
) -> DataFrame:
    """One row: score monitoring, feature map, drifted names, overall status and recommendation."""
    # the score is indexed in the same job as the features; one row per column remains
    asked = list(dict.fromkeys([*features, score]))
    indices = pin(drift.feature_indices(reference, production, asked))
    scores = drift.monitor_scores(
        reference, production, score, label, compat, indices.where(F.col("feature") == score)
    )
    chosen = indices.where(F.col("feature").isin(list(features)))
    report = drift.feature_report(chosen.select("feature", F.col("psi").alias("csi")))
    drifted = drift.drifted_features(report)
    entries = report.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", F.struct("csi", "status"))))).alias("features")
    )
    row = scores.crossJoin(F.broadcast(drifted)).crossJoin(F.broadcast(entries))  # one row each
    return row.withColumn("overall_status", drift.overall_status()).withColumns(
        {
            "total_alerts": F.size("alerts"),
            "recommendation": drift.recommendation(F.col("overall_status")),
        }
    )


def report_json(report: DataFrame) -> DataFrame:
    """The report as one JSON document per row."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("report"))


def monitoring_run(
    reference: DataFrame, production: DataFrame | None, features: Sequence[str], stand_in: DataFrame | None = None,
    labels: DataFrame | None = None, key: str = v.KEY, label: str = v.TARGET, path: str | None = None,
) -> DataFrame:
    """Report of two scored tables; a held-out table stands in when there is no production data."""
    current = production if production is not None else stand_in
    if current is None:
        raise ValueError("no production table and no stand-in")
    if labels is not None:
        current = current.drop(label).join(labels.select(key, label), key, "inner")
    report = drift_report(reference, current, features, label=label if labels is not None else None)
    if path:
        append_report(report_json(report), path)
    return report
