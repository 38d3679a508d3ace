"""Monitors and alert rules over streams.

Each function takes a streaming DataFrame and returns one, built from the same column
expressions as its batch twin.  The ``run_*`` functions drive a stream through all available
input into a table and return what it says so far, windows and alerts that may still change
included; over the same rows that is the batch result, in whatever order and number of
micro-batches they come, as long as no row is later than the watermark allows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.functions.decisions import with_decisions
from riskloom.operators import alerting, drift
from riskloom.operators.calibration import edges_below
from riskloom.operators.validity import accepted, rejected
from riskloom.runtime import scratch_path

WATERMARK = "60 minutes"


def read_table_stream(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, bytes_per_trigger: int = 16 * 2**30
) -> DataFrame:
    """Parquet files below a path pattern as a stream.

    The trigger size bounds a micro-batch, and with it what one key can bring to a stateful
    operator at a time: choose it so that a busy key's share fits a task.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger is not None:
        return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return reader.option("maxBytesPerTrigger", bytes_per_trigger).parquet(path)


def run_to_table(stream: DataFrame, path: str | None = None, name: str = "stream") -> DataFrame:
    """Process everything available, append to a Parquet table, and read that table."""
    spark = stream.sparkSession
    target = path or scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{target}-checkpoint").trigger(availableNow=True).start(target)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


FOLD_EVERY = 32


def _numbered(spark: SparkSession, target: str, kind: str, inside: str = "") -> list[int]:
    """Numbers of the folders ``<kind>-<number>`` below a path, in order."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{kind}-[0-9]*{inside}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    paths = [f.getPath().getParent() if inside else f.getPath() for f in found]
    return sorted(int(p.getName().rsplit("-", 1)[1]) for p in paths)


def _last_versions(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), "_batch").alias("_last"), F.max("_batch").alias("_batch")
    ).select(*keys, "_last.*", "_batch").select(*rows.columns)


def _standing(spark: SparkSession, target: str, below: int | None = None) -> tuple[int, list[str]]:
    """The last finished fold (-1: none) before ``below``, and the folders that hold all versions still needed."""
    folds = [n for n in _numbered(spark, target, "fold", "/_SUCCESS") if below is None or n < below]
    last = max(folds, default=-1)
    kept = [f"{target}/fold-{last}"] if folds else []
    return last, kept + [f"{target}/batch-{n}" for n in _numbered(spark, target, "batch") if n > last]


def _fold(spark: SparkSession, target: str, keys: Sequence[str], number: int) -> None:
    """Merge the fold before and all batches since into ``fold-<number>``.

    What the fold before covers is deleted now and not sooner: its own batch is committed by the
    time a later one runs, so a batch that is repeated finds all it merges.
    """
    last, folders = _standing(spark, target, number)
    for kind, end in (("batch", last + 1), ("fold", last)):
        for old in _numbered(spark, target, kind):
            if old < end:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{kind}-{old}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    schema = spark.read.parquet(f"{target}/batch-none").schema
    _last_versions(spark.read.schema(schema).parquet(*folders), keys).write.mode("overwrite").parquet(f"{target}/fold-{number}")


def _run_batches(
    stream: DataFrame, mode: str, path: str | None, reduce=None, keys: Sequence[str] | None = None, fold_every: int = FOLD_EVERY
) -> DataFrame:
    """Write what each micro-batch brings, or its reduction, with the number of the batch.

    A batch that is repeated after a failure replaces its own folder.  With ``keys``, only the
    last row of each key counts, and every ``fold_every`` batches are merged with all before.
    """
    spark = stream.sparkSession
    target = path or scratch_path(spark, "stream")
    columns = F.lit(0).cast("bigint").alias("_batch")
    empty = spark.createDataFrame([], stream.schema).select("*", columns)
    empty.write.mode("overwrite").parquet(f"{target}/batch-none")

    def write(batch: DataFrame, number: int) -> None:
        rows = reduce(batch) if reduce else batch
        rows.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{target}/batch-{number}")
        if keys and (number + 1) % fold_every == 0:
            _fold(spark, target, keys, number)

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{target}-checkpoint")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    _, folders = _standing(spark, target)
    return spark.read.schema(empty.schema).parquet(f"{target}/batch-none", *folders)


def run_windows(
    stream: DataFrame, keys: Sequence[str] = ("window_start", "window_end"), path: str | None = None, fold_every: int = FOLD_EVERY
) -> DataFrame:
    """All windows of an aggregated stream, open ones with what has come so far.

    Every micro-batch writes the windows it changed; the last version of each counts.  Versions
    are merged every ``fold_every`` batches, so one of each window and those of at most twice as
    many batches are kept, however long the stream runs.
    """
    rows = _run_batches(stream, "update", path, keys=keys, fold_every=fold_every)
    return _last_versions(rows, keys).select(*stream.columns)


def _window_columns(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c != "w"]
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *rest)


def window_bin_counts(
    stream: DataFrame, edges: Sequence[float], score: str = "score", ts: str = "ts", width: str = "1 day",
    watermark: str = WATERMARK,
) -> DataFrame:
    """Rows (window, bin, actual) against fixed reference edges, once a window has closed.

    The edges of one score are bins - 1 numbers, so they travel inside the plan.
    """
    number = edges_below(F.col(score).cast("double"), list(edges), True)
    rows = stream.where(F.col(score).isNotNull()).withWatermark(ts, watermark)
    counts = rows.groupBy(F.window(ts, width).alias("w"), number.alias("bin")).agg(F.count(F.lit(1)).alias("actual"))
    return _window_columns(counts)


def psi_per_window(
    counts: DataFrame, reference_counts: DataFrame, bins: int = 10, eps: float = v.PSI_EPSILON
) -> DataFrame:
    """Rows (window_start, psi, status, ...) from closed window counts and (bin, expected)."""
    every_bin = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    windows = counts.select("window_start").distinct().select("window_start", every_bin)
    spine = windows.join(reference_counts.select("bin", "expected"), "bin")
    full = spine.join(counts.select("window_start", "bin", "actual"), ["window_start", "bin"], "left").fillna(0, ["actual"])
    rows = drift.index_of_counts(full, ["window_start"], eps)
    return rows.withColumn("status", drift.psi_status(F.col("psi")))


def window_proxies(
    stream: DataFrame, score: str = "score", ts: str = "ts", width: str = "1 day", watermark: str = WATERMARK
) -> DataFrame:
    """Label-free monitors per closed window."""
    aggregates = [x.alias(n) for n, x in drift.proxy_aggregates(score).items()]
    rows = stream.withWatermark(ts, watermark).groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.col(score)).alias("n"), *aggregates
    )
    return _window_columns(rows).withColumn("alerts", drift.proxy_alerts())


def window_error_rates(
    stream: DataFrame, is_error: Column, ts: str = "ts", width: str = "15 minutes", slide: str | None = None,
    watermark: str = WATERMARK, limit: float = 0.05,
) -> DataFrame:
    """Share of failed requests per closed window, sliding if asked, and whether it alerts."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    rows = stream.withWatermark(ts, watermark).groupBy(window.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(is_error.cast("double")).alias("error_rate")
    )
    return _window_columns(rows).withColumn("alert", F.col("error_rate") > limit)


def drop_repeats(stream: DataFrame, key: Sequence[str] = ("key",), ts: str = "ts", within: str = WATERMARK) -> DataFrame:
    """At most one alert of a key while its state lives, i.e. at least ``within`` after the kept one.

    State is one row per key; Spark drops it once the watermark has passed.
    """
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(key))


def suppress_since_kept(
    stream: DataFrame, key: str = "key", ts: str = "ts", order: str = "alert_id", minutes: int = 60, watermark: str = WATERMARK
) -> DataFrame:
    """Alerts (key, alert_id, ts, final) kept when no alert of the key was *kept* in the ``minutes`` before.

    The state of a key is the instant of its last kept alert before the watermark, and one
    alert per instant after it: those may still be overtaken by earlier ones, so what they give
    is marked as not final and said anew with each change.  A key without either has no state.
    Only identifiers and instants are sent to Python, rows of one instant once.  Rows without
    an instant are left out.
    """
    gap = minutes * 60_000_000

    def walk(instants, last):
        kept = []
        for us in instants:
            if last is None or us >= last + gap:
                kept.append(us)
                last = us
        return kept, last

    def step(group, batches, state):
        last, waiting, alerts = state.get if state.exists else (None, [], [])
        pending = dict(zip(waiting, alerts))
        for batch in batches:
            heads = batch.groupby("us")["alert"].min()
            for us, alert in zip(heads.index.tolist(), heads.tolist()):
                pending[us] = min(alert, pending.get(us, alert))
        mark = state.getCurrentWatermarkMs()
        instants = sorted(pending)
        closed = [us for us in instants if us < mark * 1000]
        instants = instants[len(closed):]
        settled, last = walk(closed, last)
        open_kept, _ = walk(instants, last)
        if instants or (last is not None and last + gap > mark * 1000):
            state.update((last, instants, [pending[us] for us in instants]))
            state.setTimeoutTimestamp(max(mark + 1, (instants[0] if instants else last + gap) // 1000 + 1))
        else:
            state.remove()
        rows = [(us, True) for us in settled] + [(us, False) for us in open_kept]
        yield pd.DataFrame({
            "key": [group[0]] * (len(rows) + 1),
            "alert_id": pd.array([pending[us] for us, _ in rows] + [None], "Int64"),
            "us": pd.array([us for us, _ in rows] + [None], "Int64"),
            "final": [final for _, final in rows] + [False],  # the last row says that the key has changed
        })

    slim = stream.where(F.col(ts).isNotNull()).withWatermark(ts, watermark).select(
        F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("alert"), F.unix_micros(ts).alias("us"), ts
    )
    state = "last bigint, waiting array<bigint>, alerts array<bigint>"
    kept = slim.groupBy("key").applyInPandasWithState(
        step, "key string, alert_id bigint, us bigint, final boolean", state, "update", "EventTimeTimeout"
    )
    return kept.select("key", "alert_id", F.timestamp_micros("us").alias("ts"), "final")


def run_suppression(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (key, alert_id, ts) that ``suppress_since_kept`` keeps: final ones, and the last word on the others."""
    rows = _run_batches(stream, "update", path)
    newest = rows.groupBy(F.col("key").alias("_key")).agg(F.max("_batch").alias("_newest"))
    said = rows.join(newest, F.col("key").eqNullSafe(F.col("_key")))
    return said.where((F.col("final") | (F.col("_batch") == F.col("_newest"))) & F.col("ts").isNotNull()).select("key", "alert_id", "ts")


def run_rate_limit(
    stream: DataFrame, by: Sequence[str] = (), ts: str = "ts", order: str = "alert_id", per_hour: int = alerting.PER_HOUR,
    per_day: int = alerting.PER_DAY, path: str | None = None,
) -> DataFrame:
    """What ``alerting.limit_rate`` lets through: in all, or for each value of ``by``.

    The first alerts of an hour are among the first of it in their micro-batch, so each batch
    writes only those; no state is held, no key goes to one worker and no row can be too late.
    """
    def first_of_hours(batch: DataFrame) -> DataFrame:
        return alerting.first_in_unit(batch, 3_600, per_hour, by, ts, order)

    return alerting.limit_rate(_run_batches(stream, "append", path, first_of_hours).drop("_batch"), ts, order, per_hour, per_day, by)


def resolved_in_time(
    alerts: DataFrame, resolutions: DataFrame, alert_id: str = "alert_id", ts: str = "ts", hours: int = 4,
    watermark: str = WATERMARK,
) -> DataFrame:
    """Ids of alerts whose own resolution came within ``hours``: a join of two streams.

    Both sides carry a watermark and the join a time bound, so state is kept for ``hours`` only.
    """
    raised = alerts.withWatermark(ts, watermark)
    solved = resolutions.select(F.col(alert_id).alias("_id"), F.col(ts).alias("_resolved")).withWatermark("_resolved", watermark)
    in_time = F.expr(f"_id = {alert_id} AND _resolved >= {ts} AND _resolved <= {ts} + INTERVAL {hours} HOURS")
    return raised.join(solved, in_time).select(alert_id)


def run_escalations(
    alerts: DataFrame, resolutions: DataFrame, alert_id: str = "alert_id", ts: str = "ts", hours: int = 4,
    watermark: str = WATERMARK,
) -> DataFrame:
    """Alerts that no resolution of their own followed within ``hours`` in all that has come."""
    matched = run_to_table(resolved_in_time(alerts, resolutions, alert_id, ts, hours, watermark))
    return run_to_table(alerts).join(matched, alert_id, "left_anti")


def decisions(stream: DataFrame, score: str = "score", keep: Sequence[str] = (v.KEY,)) -> tuple[DataFrame, DataFrame]:
    """Two stateless streams: decisions for valid applications, and rejects with their faults."""
    return with_decisions(accepted(stream), score, keep=keep), rejected(stream).select(*keep, "faults")
