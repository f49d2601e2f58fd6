"""Structured Streaming jobs that reuse the batch expressions.

Each job reads a landing folder of Parquet files with ``readStream`` (a file source
needs a folder; the queries land the shared tables there first), writes to a Parquet
sink with its own checkpoint location under the shared checkpoint folder, and runs with
``trigger(availableNow=True)``: everything present is processed in micro-batches of a few
files, then the run stops. Restarting from the same checkpoint resumes exactly where the last
run stopped. Files are landed in event-time order, so a watermark that an earlier batch sets makes
no row of a later batch late. State is kept in RocksDB, on the executors' disks and in the
checkpoint, and is bounded by what the watermark has not yet closed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import anomaly as N
from ..session import scratch_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Landed files that a micro-batch takes.
FILES_PER_TRIGGER = 2


#: Rows of a landed file, and so of a task that reads it, where a stream multiplies rows by its windows.
FILE_ROWS = 100_000


def land(df: DataFrame, name: str, files: int = 8, order: str | None = None, file_rows: int | None = None) -> str:
    """Write ``df`` as ``files`` Parquet files in a fresh landing folder; returns it. With ``order`` the
    files are ranges of that column, and their times make the stream read them in its order. With ``file_rows``
    there are as many more files as keep them to about so many rows; ``df`` is counted for that."""
    spark = df.sparkSession
    if file_rows:
        files = max(files, -(-df.count() // file_rows))
    path = scratch_path(spark, f"landing/{name}-{uuid.uuid4().hex}")
    out = df.repartitionByRange(files, order) if order else df.repartition(files)
    out.write.mode("overwrite").parquet(path)
    if order:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        parts = sorted((f for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
        for k, f in enumerate(parts):  # part numbers follow the ranges
            fs.setTimes(f.getPath(), f.getModificationTime() - 1000 * (len(parts) - k), -1)
    return path


def read_landing(spark: SparkSession, landing: str, schema, files_per_trigger: int | None) -> DataFrame:  # noqa: ANN001
    """The landed files as a stream; None takes all that are present in one micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(landing)


def stream_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a job's sink and checkpoint."""
    return scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex}")


def _finish(writer, base: str):  # noqa: ANN001, ANN202
    """Runs a stream over all that is present, with its state in RocksDB; returns the ended query."""
    with _set(writer._spark, _PROVIDER, _ROCKSDB):
        q = writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return q


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting that a stream takes over when it starts."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _run(query_df: DataFrame, name: str, mode: str = "append", base: str | None = None) -> str:
    base = base or stream_folder(query_df.sparkSession, name)
    _finish(query_df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out"), base)
    return f"{base}/out"


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes every micro-batch to a folder of its own, named by the batch's
    id and replaced as a whole: a batch that is replayed after a failure leaves its rows once."""
    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def run_batches(query_df: DataFrame, base: str) -> DataFrame:
    """Runs a stream through :func:`batch_sink` under ``base`` and reads the sink; it may be called again with the
    same folder to go on."""
    spark = query_df.sparkSession
    _finish(query_df.writeStream.outputMode("append").foreachBatch(batch_sink(f"{base}/out")), base)
    return spark.read.schema(query_df.schema).parquet(f"{base}/out/*") if _exists(spark, f"{base}/out") else spark.createDataFrame([], query_df.schema)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def deposit_scan(spark: SparkSession, landing: str, schema, thresholds: DataFrame, base: str | None = None,  # noqa: ANN001
                 files_per_trigger: int | None = FILES_PER_TRIGGER) -> DataFrame:
    """Score arriving deposits with the rule flags (stateless): a stream-static join with
    the one-row threshold table computed from history, written batch by batch by ``foreachBatch``."""
    src = read_landing(spark, landing, schema, files_per_trigger)
    scored = N.rule_flags(src, thresholds)
    return run_batches(scored.select("deposit_id", "flag_amount", "flag_hour", "flag_frequency", "rule_reasons"), base or stream_folder(spark, "deposit_scan"))


def hourly_trend(spark: SparkSession, landing: str, schema, delay: str = "2 hours", files_per_trigger: int | None = FILES_PER_TRIGGER) -> DataFrame:
    """Mean value and count per event hour; rows later than the watermark are dropped;
    append mode emits a window once the watermark passes its end."""
    src = read_landing(spark, landing, schema, files_per_trigger)
    ev = src.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    agg = ev.groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("events"),
                                                  F.sum(F.col("value").cast("decimal(18,2)")).alias("_sum"))
    out = _run(agg.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "events", "_sum"),
               "hourly_trend")
    r = spark.read.parquet(out)
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window_end").cast("timestamp_ntz").alias("window_end"), "events",
                    (F.col("_sum").cast("double") / F.col("events")).alias("avg_value"))


def hourly_score(spark: SparkSession, landing: str, schema, thresholds: DataFrame, delay: str = "2 hours",
                 files_per_trigger: int | None = FILES_PER_TRIGGER) -> DataFrame:
    """Mean rule score of arriving deposits per event hour; rows later than the watermark are
    dropped. Flags are summed as whole numbers, so the mean does not depend on the order."""
    src = read_landing(spark, landing, schema, files_per_trigger)
    ev = src.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    raised = sum(F.col(c).cast("long") for c in ("flag_amount", "flag_hour", "flag_frequency"))
    agg = N.rule_flags(ev, thresholds).groupBy(F.window("ts", "1 hour")).agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.coalesce(raised, F.lit(0))).alias("_raised"))
    out = _run(agg.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "events", "_raised"),
               "hourly_score")
    r = spark.read.parquet(out)
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window_end").cast("timestamp_ntz").alias("window_end"), "events",
                    (F.col("_raised") / (3.0 * F.col("events"))).alias("avg_score"))


def frequency_24h(spark: SparkSession, landing: str, schema, delay: str = "2 hours", files_per_trigger: int | None = FILES_PER_TRIGGER) -> DataFrame:  # noqa: ANN001
    """Deposits per user in sliding 24 h windows every hour, with a watermark so state for closed
    windows is dropped.

    A row becomes 24 (user, window) pairs, which the task that read it adds up in memory: each landed file is a task of its
    own, so a file's rows bound that memory."""
    src = read_landing(spark, landing, schema, files_per_trigger)
    ev = src.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    agg = ev.groupBy("user_id", F.window("ts", "24 hours", "1 hour")).agg(F.count(F.lit(1)).alias("deposits"))
    # a file counts as a whole split, so that none is read together with another
    with _set(spark, "spark.sql.files.openCostInBytes", str(1 << 30)):
        out = _run(agg.select("user_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                              "deposits"), "frequency_24h")
    r = spark.read.parquet(out)
    return r.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window_end").cast("timestamp_ntz").alias("window_end"), "deposits")


class TrailingCount(StatefulProcessor):
    """For every event of a user, how many of its events lie in the ``seconds`` up to it, ties included: the
    ``frequency`` that the deposit models read, one count per event.

    A key is a bucket of users, so that a call counts the events of many users by arrays. Its state is their events by
    (user, time), as blocks of bytes of at most ``HELD`` events: those still to be counted and those of the last
    ``seconds`` before them. An event is counted once the watermark has passed it, when nothing before it can still
    arrive; a timer at the earliest open event wakes the key. When nothing is open, a timer ``seconds`` after the
    last event drops the rest, so buckets that fall silent leave no state."""

    #: An event: its time, its user, its id, and whether it is still to be counted.
    FIELDS = np.dtype([("user", "<i8"), ("us", "<i8"), ("id", "<i8"), ("open", "?")])
    #: Events of a block of state.
    HELD = 50_000

    def __init__(self, seconds: int):
        self.span = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "block binary")
        self.woken = handle.getValueState("woken", "ms long")
        self.passed = handle.getValueState("passed", "us long")

    def _held(self) -> np.ndarray:
        return np.concatenate([np.empty(0, self.FIELDS), *[np.frombuffer(bytes(b[0]), self.FIELDS) for b in self.events.get()]])

    def _blocks(self, events: np.ndarray) -> list[tuple[bytes]]:
        return [(events[i : i + self.HELD].tobytes(),) for i in range(0, len(events), self.HELD)]

    def _wake(self, at: int | None) -> None:
        """Sets the key's only timer: at a time in microseconds, or none."""
        before = self.woken.get()[0] if self.woken.exists() else None
        now = None if at is None else at // 1000 + 1
        if now == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if now is None:
            self.woken.clear()
        else:
            self.handle.registerTimer(now)
            self.woken.update((now,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        passed = self.passed.get()[0] if self.passed.exists() else None
        first = None
        for part in rows:
            part = part[["user_id", "us", "event_id"]].dropna()
            if passed is not None:
                part = part[part["us"] > passed]  # later than the watermark: counts before it are out
            if len(part):
                come = np.empty(len(part), self.FIELDS)
                for field, c in (("user", "user_id"), ("us", "us"), ("id", "event_id")):
                    come[field] = part[c].to_numpy(np.int64)
                come["open"] = True
                self.events.appendList(self._blocks(come))
                first = int(come["us"].min()) if first is None else min(first, int(come["us"].min()))
        if first is not None and not (self.woken.exists() and self.woken.get()[0] <= first // 1000 + 1):
            self._wake(first)
        yield pd.DataFrame({"event_id": pd.Series(dtype="int64"), "frequency": pd.Series(dtype="int32")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held = self._held()
        held = held[np.lexsort((held["id"], held["us"], held["user"]))]
        ready = held["open"] & (held["us"] <= upto)
        count = self._counts(held)[ready]
        yield pd.DataFrame({"event_id": held["id"][ready], "frequency": count.astype(np.int32)})
        held["open"] &= ~ready
        # the next event to be counted is after the watermark, and so are all that come later
        held = held[held["open"] | (held["us"] >= upto + 1 - self.span)]
        self.woken.clear()  # this timer is gone
        if len(held):
            self.passed.update((int(upto),))
            self.events.put(self._blocks(held))
            self._wake(int(held["us"][held["open"]].min()) if held["open"].any() else int(held["us"].max()) + self.span)
        else:
            self.events.clear()
            self.passed.clear()

    def _counts(self, held: np.ndarray) -> np.ndarray:
        """For every event, in the order of (user, time), its user's events in the span up to its time, ties included."""
        # users end to end on one axis, more than a span apart; longer pauses of a user are cut to as much
        step = np.minimum(np.diff(held["us"]), self.span + 1)
        step[np.diff(held["user"]) != 0] = self.span + 1
        axis = np.concatenate([np.zeros(min(len(held), 1), np.int64), np.cumsum(step)])
        return np.searchsorted(axis, axis, "right") - np.searchsorted(axis, axis - self.span, "left")

    def close(self) -> None:
        pass


#: Buckets of users whose trailing counts are kept together.
USER_BUCKETS = 2048


def trailing_frequency(spark: SparkSession, landing: str, schema, seconds: int = 86_400, delay: str = "2 hours", base: str | None = None,  # noqa: ANN001
                       files_per_trigger: int | None = FILES_PER_TRIGGER, buckets: int = USER_BUCKETS) -> DataFrame:
    """(deposit_id, frequency) of every arriving deposit that the watermark has passed, see :class:`TrailingCount`.
    It may be called again with the same ``base`` (and ``buckets``) after more files have landed, or after a failure."""
    src = read_landing(spark, landing, schema, files_per_trigger).filter("user_id is not null and ts is not null")
    ev = src.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    user = F.col("user_id").cast("long")
    ev = ev.select("ts", F.pmod(F.xxhash64(user), F.lit(buckets)).cast("long").alias("bucket"), user.alias("user_id"), F.unix_micros("ts").alias("us"),
                   F.col("deposit_id").cast("long").alias("event_id"))
    counted = ev.groupBy("bucket").transformWithStateInPandas(TrailingCount(seconds), "event_id long, frequency int", "Append", "EventTime")
    out = run_batches(counted, base or stream_folder(spark, "trailing_frequency"))
    return out.select(F.col("event_id").alias("deposit_id"), "frequency")


def closed_before(df: DataFrame, history: DataFrame, ts: str = "ts", delay_hours: int = 2) -> DataFrame:
    """Keep windows whose end is at or before max(ts) - delay: the ones a finished stream
    has emitted, for comparing with the batch twin."""
    mx = history.agg((F.max(ts) - F.expr(f"INTERVAL {delay_hours} HOURS")).alias("_wm"))
    return df.crossJoin(F.broadcast(mx)).filter(F.col("window_end") <= F.col("_wm")).drop("_wm")
