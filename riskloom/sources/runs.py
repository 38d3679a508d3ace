"""Training runs as rows: parameters, metrics and tags in maps."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = (
    "run_id string, experiment string, run_name string, status string, started_at timestamp,"
    " params map<string,string>, metrics map<string,double>, tags map<string,string>"
)


def run_row(
    spark: SparkSession, experiment: str, run_name: str, params: dict, metrics: dict, tags: dict | None = None,
    status: str = "success", run_id: str | None = None, started_at: dt.datetime | None = None,
) -> DataFrame:
    """One run as a row; nested parameters are flattened with ``_``."""
    def flat(values: dict, prefix: str = ""):
        for name, value in values.items():
            if isinstance(value, dict):
                yield from flat(value, f"{prefix}{name}_")
            else:
                yield f"{prefix}{name}", str(value)

    row = (
        run_id or uuid.uuid4().hex, experiment, run_name, status, started_at or dt.datetime.now(),
        dict(flat(params)), {k: float(x) for k, x in metrics.items()}, {k: str(x) for k, x in (tags or {}).items()},
    )
    return spark.createDataFrame([row], RUN_SCHEMA)


def append_run(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def runs_from_metrics(metrics: DataFrame, run_id: str, experiment: str) -> DataFrame:
    """Long rows (experiment, run, metric, value) gathered into run rows."""
    entries = F.map_from_entries(F.collect_list(F.struct("metric", "value")))  # one entry per metric
    return metrics.groupBy(F.col(run_id).alias("run_id"), F.col(experiment).alias("experiment")).agg(entries.alias("metrics"))
