"""Alert rules that keep state and act on event-time timers.

An alert leaves these streams once nothing that may still come can change what becomes of it, and its state
goes with it.  Rows may come in any order within the watermark; over the same rows the result is
that of the batch form (``alerting.limit_rate`` and ``alerting.escalations``), whatever the micro-batches.

State is kept in RocksDB (``use_rocksdb``).  ``closed`` ends a stream: it moves the watermark past
everything, so that the alerts still waiting are decided too.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskloom.operators import alerting
from riskloom.runtime import scratch_path

WATERMARK = "60 minutes"
HOUR, DAY = 3_600_000, 86_400_000
#: the instant that ends a stream; rows from it on are no alerts
END = "9000-01-01 00:00:00"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def use_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, as timers and map state need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class RateLimit(StatefulProcessor):
    """Of one value of ``by`` and one day: the first alerts of each hour, until the day has had enough.

    State: per open hour its first ``per_hour`` alerts, and how many of the day went out.
    An hour is decided when its timer fires, hours in their order.
    """

    def __init__(self, per_hour: int, per_day: int, names: Sequence[str]):
        self.per_hour, self.per_day, self.names = per_hour, per_day, list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour bigint", "us array<bigint>, ids array<bigint>")
        self.sent = handle.getValueState("sent", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark, come = timerValues.getCurrentWatermarkInMs(), {}
        for row in rows:
            hour = row["_us"] // (HOUR * 1_000)
            if (hour + 1) * HOUR > mark:
                come.setdefault(hour, []).append((row["_us"], row["_id"]))
                if len(come[hour]) > 64 * self.per_hour:  # what a batch brings is cut down on the way
                    come[hour] = sorted(come[hour])[: self.per_hour]
        for hour, new in come.items():
            if self.hours.containsKey((hour,)):
                us, ids = self.hours.getValue((hour,))
                new += zip(us, ids)
            else:
                self.handle.registerTimer((hour + 1) * HOUR)
                self.handle.registerTimer((hour * HOUR // DAY + 1) * DAY)
            first = sorted(new)[: self.per_hour]
            self.hours.updateValue((hour,), ([u for u, _ in first], [i for _, i in first]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        sent = self.sent.get()[0] if self.sent.exists() else 0
        done = sorted(k[0] for k in self.hours.keys() if (k[0] + 1) * HOUR <= until)
        out = []
        for hour in done:
            us, ids = self.hours.getValue((hour,))
            self.hours.removeKey((hour,))
            through = list(zip(us, ids))[: max(0, self.per_day - sent)]
            sent += len(through)
            out += through
        if until % DAY == 0:
            self.sent.clear()
        elif done:
            self.sent.update((sent,))
        for u, i in out:
            yield Row(**dict(zip(self.names, [*key[:-1], i, u])))

    def close(self) -> None:
        pass


class Escalation(StatefulProcessor):
    """Of one key: alerts that no resolution followed in time.

    State: the alerts not yet due, and the resolutions that may still answer one.
    """

    def __init__(self, span: int, names: Sequence[str]):
        self.span, self.names = span, list(names)  # span in microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "us array<bigint>, ids array<bigint>, solved array<bigint>, timer bigint")

    def _keep(self, alerts: list, solved: list, mark: int, timer: int) -> None:
        oldest = min(mark * 1_000, alerts[0][0] if alerts else mark * 1_000)
        solved = solved[bisect_left(solved, oldest):]
        if not alerts and not solved:
            self.open.clear()
            return
        # the next alert to be due, or else the time from which no alert can come before the last resolution
        due = (alerts[0][0] + self.span if alerts else solved[-1]) // 1_000 + 1
        if timer <= mark or due < timer:
            self.handle.registerTimer(max(due, mark + 1))
            timer = max(due, mark + 1)
        self.open.update(([u for u, _ in alerts], [i for _, i in alerts], solved, timer))

    def _state(self) -> tuple[list, list, int]:
        if not self.open.exists():
            return [], [], 0
        us, ids, solved, timer = self.open.get()
        return list(zip(us, ids)), list(solved), timer

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        alerts, solved, timer = self._state()
        for row in rows:
            if row["_us"] >= mark * 1_000:
                if row["_id"] is None:
                    solved.append(row["_us"])
                else:
                    alerts.append((row["_us"], row["_id"]))
        self._keep(sorted(alerts), sorted(set(solved)), mark, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        alerts, solved, _ = self._state()
        due = [a for a in alerts if (a[0] + self.span) // 1_000 < mark]
        late = []
        for us, alert in due:
            at = bisect_right(solved, us)
            if at == len(solved) or solved[at] > us + self.span:
                late.append((us, alert))
        self._keep(alerts[len(due):], solved, mark, 0)
        for us, alert in late:
            yield Row(**dict(zip(self.names, [*key, alert, us])))

    def close(self) -> None:
        pass


def _first_of_hours(by: Sequence[str], per_hour: int):
    """What a batch of rows can bring to the first alerts of its hours, and its last row (for the watermark)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                order = rows.sort_values(["_us", "_id"])
                turn = order.groupby([*by, order["_us"] // (HOUR * 1_000)], dropna=False).cumcount()
                yield order[(turn < per_hour) | (order["_us"] == order["_us"].iloc[-1])]

    return run


def _ended(stream: DataFrame, end: DataFrame | None) -> DataFrame:
    return stream if end is None else stream.unionByName(end, allowMissingColumns=True)


def _output(stream: DataFrame, keys: Sequence[str], order: str, ts: str) -> tuple[T.StructType, list[str]]:
    names = [*keys, order, ts]
    fields = [T.StructField(c, stream.schema[c].dataType) for c in keys]
    return T.StructType([*fields, T.StructField(order, T.LongType()), T.StructField(ts, T.LongType())]), names


def limit_rate(
    stream: DataFrame, by: Sequence[str] = (), ts: str = "ts", order: str = "alert_id", per_hour: int = alerting.PER_HOUR,
    per_day: int = alerting.PER_DAY, watermark: str = WATERMARK, end: DataFrame | None = None,
) -> DataFrame:
    """Alerts (``by``, ``order``, ``ts``) that a rate limit lets through, sent when their hour is over.

    The first ``per_hour`` of each hour and of those the first ``per_day`` of each day (UTC), in all or for
    each value of ``by``.  Only the first alerts of an hour in each batch of rows are shuffled, so a key that
    floods brings its task no more than that.  State per value of ``by`` and day: at most ``per_hour`` alerts for each hour
    that the watermark leaves open.  Rows without an instant or an id (a whole number) are left out.
    """
    slim = stream.select(*by, F.col(ts).alias("_ts"), F.col(order).cast("bigint").alias("_id")).where("_ts IS NOT NULL AND _id IS NOT NULL")
    rows = _ended(slim, end).select(*by, "_id", F.unix_micros("_ts").alias("_us"))
    few = rows.mapInPandas(_first_of_hours(by, per_hour), rows.schema)
    timed = few.withColumn("_ts", F.timestamp_micros("_us")).withWatermark("_ts", watermark).where(F.col("_ts") < F.lit(END).cast("timestamp"))
    shape, names = _output(stream, by, order, ts)
    found = timed.withColumn("_day", F.expr(f"_us div {DAY * 1_000}")).groupBy(*by, "_day").transformWithState(
        RateLimit(per_hour, per_day, names), shape, "Append", "EventTime"
    )
    return found.withColumn(ts, F.timestamp_micros(ts))


def escalate(
    alerts: DataFrame, resolutions: DataFrame, key: Sequence[str] = ("key",), ts: str = "ts", order: str = "alert_id",
    hours: float = alerting.ESCALATE_HOURS, watermark: str = WATERMARK, end: DataFrame | None = None,
) -> DataFrame:
    """Alerts (``key``, ``order``, ``ts``) with no resolution of their key after them and within ``hours``.

    Both streams are one timeline per key, so alerts and resolutions are never paired.  An alert leaves
    when its time is up; a resolution is forgotten once no alert that it could answer can come.
    Rows without an instant, and alerts without an id, are left out.
    """
    raised = alerts.select(*key, F.col(ts).alias("_ts"), F.col(order).cast("bigint").alias("_id")).where("_id IS NOT NULL")
    solved = resolutions.select(*key, F.col(ts).alias("_ts"), F.lit(None).cast("bigint").alias("_id"))
    both = _ended(raised.unionByName(solved).where("_ts IS NOT NULL"), end)
    timed = both.withWatermark("_ts", watermark).where(F.col("_ts") < F.lit(END).cast("timestamp")).withColumn("_us", F.unix_micros("_ts"))
    shape, names = _output(alerts, key, order, ts)
    found = timed.groupBy(*key).transformWithState(Escalation(round(hours * HOUR) * 1_000, names), shape, "Append", "EventTime")
    return found.withColumn(ts, F.timestamp_micros(ts))


def escalate_unanswered(
    alerts: DataFrame, resolutions: DataFrame, order: str = "alert_id", ts: str = "ts", hours: float = alerting.ESCALATE_HOURS,
    watermark: str = WATERMARK, end: DataFrame | None = None,
) -> DataFrame:
    """Alerts (``order``, ``ts``) whose own resolution did not come within ``hours``: an outer join of two streams.

    Both sides carry a watermark and the join a bound in time, so Spark holds what lies within ``hours``
    and the watermark, and gives an alert without partner when its time is up.
    """
    raised = _ended(alerts.select(F.col(ts).alias("_ts"), F.col(order).cast("bigint").alias("_id")).where("_id IS NOT NULL AND _ts IS NOT NULL"), end)
    solved = _ended(resolutions.select(F.col(ts).alias("_ts"), F.col(order).cast("bigint").alias("_id")).where("_id IS NOT NULL AND _ts IS NOT NULL"), end)
    raised = raised.withWatermark("_ts", watermark)
    solved = solved.select(F.col("_ts").alias("_solved"), F.col("_id").alias("_of")).withWatermark("_solved", watermark)
    span = f"INTERVAL '{round(hours * 3600)}' SECOND"
    joined = raised.join(solved, F.expr(f"_of = _id AND _solved >= _ts AND _solved <= _ts + {span}"), "leftOuter")
    return joined.where(F.col("_of").isNull() & (F.col("_ts") < F.lit(END).cast("timestamp"))).select(F.col("_id").alias(order), F.col("_ts").alias(ts))


def run_closed(build, spark: SparkSession, path: str | None = None, reports: list | None = None) -> DataFrame:
    """Run ``build(end)`` over all available input, end it, and read the table it wrote.

    ``end`` is a second source without rows.  When the input is used up it gets one row at ``END``, and the
    query goes on from its checkpoint: the watermark passes all alerts, and every timer fires.
    A caller that wants to go on with the stream starts ``build(None)`` itself.  ``reports`` gets
    the progress reports.
    """
    target = path or scratch_path(spark, "stream")
    source = f"{target}-end"
    shape = T.StructType([T.StructField("_ts", T.TimestampType()), T.StructField("_id", T.LongType())])
    spark.createDataFrame([], shape).write.parquet(source)

    def run() -> T.StructType:
        stream = build(spark.readStream.schema(shape).parquet(source))
        query = (
            stream.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{target}-checkpoint").trigger(availableNow=True).start(target)
        )
        query.awaitTermination()
        if reports is not None:
            reports.extend(query.recentProgress)  # the last hundred or so
        return stream.schema

    with use_rocksdb(spark):
        run()
        spark.sql(f"SELECT TIMESTAMP '{END}' + INTERVAL 1 DAY AS _ts, 0L AS _id").write.mode("append").parquet(source)
        shape_out = run()
    return spark.read.schema(shape_out).parquet(target)
