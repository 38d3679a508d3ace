"""Batch scoring: features, model, decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.functions.decisions import with_decisions
from riskloom.functions.features import align, with_features
from riskloom.operators.cleaning import drop_targets
from riskloom.operators.summaries import prediction_summary
from riskloom.plans.training import Calibrator, plain_features, scored
from riskloom.sources.files import save_predictions


def model_inputs(df: DataFrame, features: Sequence[str] = tuple(v.MODEL_FEATURES), variant: str | None = None) -> DataFrame:
    """Key and model features; targets removed, absent features 0."""
    ready = drop_targets(with_features(df, variant) if variant else df)
    aligned = align(ready, features, keep=[v.KEY])
    names = dict(zip(features, plain_features(features)))
    return aligned.select(v.KEY, *[F.col(f"`{f}`").cast("double").alias(n) for f, n in names.items()])


def model_scores(
    model: PipelineModel, df: DataFrame, calibrator: Calibrator | None = None,
    features: Sequence[str] = tuple(v.MODEL_FEATURES), variant: str | None = None,
) -> DataFrame:
    """Rows (ID, score): also the reference scores of drift checks."""
    inputs = model_inputs(df, features, variant)
    if calibrator is None:
        return scored(model, inputs).select(v.KEY, "score")
    return calibrator.apply(scored(model, inputs, "raw_score", "margin")).select(v.KEY, "score")


def score_batch(
    model: PipelineModel, df: DataFrame, calibrator: Calibrator | None = None, variant: str = "table",
    features: Sequence[str] = tuple(v.MODEL_FEATURES), at: Column | None = None, **options,
) -> DataFrame:
    """Raw client rows to the prediction table."""
    rows = model_scores(model, df, calibrator, features, variant)
    return with_decisions(rows, at=F.current_timestamp() if at is None else at, **options)


def score_and_save(model: PipelineModel, df: DataFrame, path: str, **options) -> DataFrame:
    """Write the predictions, then summarise what was written."""
    save_predictions(score_batch(model, df, **options), path, prediction_summary)
    return df.sparkSession.read.parquet(path)
