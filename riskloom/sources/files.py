"""Client files in, tables and reports out."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import vocab as v
from riskloom.operators.cleaning import coerce_numbers, standardize_columns

log = logging.getLogger(__name__)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return files is not None and len(files) > 0


def _names(line: str) -> list[str]:
    return [part.strip().strip('"') for part in line.split(",")]


def header_row(lines: Sequence[str]) -> int:
    """0 if the first line names the key column, else 1 (a banner line precedes the header)."""
    return 0 if lines and v.KEY in [n.upper() for n in _names(lines[0])] else 1


def _client_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of a client CSV as text columns under the standard names."""
    lines = [r.value for r in spark.read.text(path).limit(2).collect()]
    names = _names(lines[min(header_row(lines), len(lines) - 1)])
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path).toDF(*names)
    return standardize_columns(rows, require_target=False)


def _key() -> Column:
    """The key as a whole number, NULL where it is none."""
    text = F.col(f"`{v.KEY}`")
    number = text.try_cast("double")
    return F.coalesce(text.try_cast("bigint"), F.when(number == F.floor(number), number).try_cast("bigint"))


def _readable(column: str) -> Column:
    number = F.col(f"`{column}`").try_cast("double")
    return number.isNotNull() & ~F.isnan(number)


def read_client_csv(spark: SparkSession, path: str, on_fraction: str = "error") -> DataFrame:
    """Client table from CSV with the header in the first or second line.

    Only the first two lines are peeked at.  Columns are read as text under the found names
    and cast on the way, so a banner or header line inside the data carries no readable key
    and is dropped, in whichever file part it occurs.  Other lines without a key are those of
    ``client_lines_without_key``.  The text NaN is NULL; a fraction in a whole column is an
    error, or NULL.
    """
    rows = _client_lines(spark, path)
    kinds = {f.name: f.dataType.simpleString() for f in v.CLIENT_SCHEMA if f.name in rows.columns and f.name != v.KEY}
    whole = [c for c, kind in kinds.items() if kind == "int"]
    return coerce_numbers(rows.where(_key().isNotNull()).withColumn(v.KEY, _key()), list(kinds), whole, on_fraction)


def client_lines_without_key(spark: SparkSession, path: str) -> DataFrame:
    """Lines, as text, that hold client numbers but no readable key: ``read_client_csv`` leaves them out."""
    rows = _client_lines(spark, path)
    numbers = [_readable(f.name) for f in v.CLIENT_SCHEMA if f.name in rows.columns and f.name != v.KEY]
    return rows.where(_key().isNull() & reduce(lambda a, b: a | b, numbers))


def read_clients(spark: SparkSession, raw: str | None = None, processed: str | None = None) -> DataFrame:
    """The processed Parquet table if it exists, else the raw CSV."""
    if processed and _exists(spark, processed):
        return standardize_columns(spark.read.parquet(processed), require_target=False)
    if raw and _exists(spark, raw):
        return read_client_csv(spark, raw)
    raise FileNotFoundError(f"no client table at {processed!r} or {raw!r}")


def save_table(df: DataFrame, folder: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """The same table as Parquet and as CSV below ``folder``."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(f"{folder}/parquet")
    df.write.mode(mode).partitionBy(*partition_by).option("header", True).csv(f"{folder}/csv")


def save_split(df: DataFrame, path: str, split: str = "split", mode: str = "overwrite") -> None:
    """One table partitioned by split; features and target stay on the row."""
    df.write.mode(mode).partitionBy(split).parquet(path)


def parquet_to_csv(spark: SparkSession, tables: dict[str, str], target: str) -> DataFrame:
    """Convert several Parquet tables to CSV; rows (table, status, n_rows, n_columns).

    Absent tables are skipped and reported.  Values are read once: rows are counted
    by the footers of the source.  (An ``Observation`` would count on the way, but in Spark 4.1 a session
    that has made one can no longer serialise fitted models.)
    """
    report = []
    for name, path in tables.items():
        if not _exists(spark, path):
            log.warning("table not found: %s", path)
            report.append((name, "missing", None, None))
            continue
        table = spark.read.parquet(path)
        flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
                else F.col(f"`{f.name}`") for f in table.schema]
        table.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{target}/{name}")
        report.append((name, "converted", table.count(), len(table.columns)))
    return spark.createDataFrame(report, "table string, status string, n_rows bigint, n_columns int")


def save_predictions(
    predictions: DataFrame, path: str, summarise: Callable[[DataFrame], DataFrame] | None = None
) -> int:
    """Prediction table as Parquet, with an optional one-row summary beside it; the number of rows written.

    ``summarise`` gets the written table, so predictions are computed once; the count reads footers only.
    """
    predictions.write.mode("overwrite").parquet(path)
    written = predictions.sparkSession.read.schema(predictions.schema).parquet(path)
    if summarise is not None:
        summarise(written).write.mode("overwrite").parquet(f"{path.rstrip('/')}_summary")
    return written.count()


def save_json(df: DataFrame, path: str) -> None:
    """Metric rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def append_report(report: DataFrame, path: str, generated_at=None) -> None:
    """Append report rows with their time of generation."""
    at = F.current_timestamp() if generated_at is None else generated_at
    report.withColumn("generated_at", at).write.mode("append").parquet(path)


def latest_report(reports: DataFrame, by: Sequence[str] = (), at: str = "generated_at") -> DataFrame:
    """The newest report per group."""
    rest = [c for c in reports.columns if c not in by]
    return reports.groupBy(*by).agg(F.max_by(F.struct(*rest), at).alias("_row")).select(*by, "_row.*")


# fixed values: the eight published figures and where they sit in a validation record
VALIDATION_FIGURES = [
    ("optimal_threshold", "optimal_threshold"),
    ("auc_roc", "metrics_optimal.auc_roc"),
    ("recall", "metrics_optimal.recall"),
    ("precision", "metrics_optimal.precision"),
    ("f1", "metrics_optimal.f1"),
    ("ks", "metrics_optimal.ks"),
    ("brier", "metrics_optimal.brier"),
    ("cost_savings", "cost_savings"),
]
VALIDATION_SCHEMA = (
    "optimal_threshold double, cost_savings double, metrics_optimal struct<threshold double, accuracy double,"
    " precision double, recall double, f1 double, auc_roc double, ks double, brier double, tp double, tn double,"
    " fp double, fn double>"
)


def published_metrics(validation: DataFrame) -> DataFrame:
    """The eight figures of nested validation records; absent parts are NULL."""
    return validation.select(*[F.col(path).alias(name) for name, path in VALIDATION_FIGURES])


def read_validation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VALIDATION_SCHEMA).option("multiLine", True).json(path)
