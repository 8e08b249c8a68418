"""Structured Streaming forms: extraction, upserts, counters, recent rows, give-up, retry queue."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sitesignal import fixed_values as fv
from sitesignal.operators.extraction import page_signals
from sitesignal.operators.rollup import latest_per_target, retry_targets
from sitesignal.sources.tables import exists


def stream_extract(captures: DataFrame, **options) -> DataFrame:
    """Signals of each new capture. Row-wise: no state and no shuffle, append output."""
    return page_signals(captures, keep=["url", "fetched_at"], **options)


def upsert_writer(path: str):
    """``foreachBatch`` sink: every batch is its own folder, replaced if the batch is replayed.

    A later row of a target wins when read with ``read_upserted``; nothing is
    rewritten per batch, so cost follows the batch and not the table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        rows.write.mode("overwrite").parquet(f"{path}/part-{batch_id:020d}")

    return write


def read_upserted(spark: SparkSession, path: str, key: str = "input_url", seq: str = "seq") -> DataFrame:
    """Latest row per key over all batches; ``seq`` orders rows within a batch."""
    rows = spark.read.parquet(f"{path}/part-*")
    ordered = rows.withColumn("_order", F.struct("batch_id", seq)).drop("batch_id", seq)
    return latest_per_target(ordered, key, "_order").drop("first_seq")


def compact_upserts(spark: SparkSession, path: str, upto: int, target: str, key: str = "input_url", seq: str = "seq") -> None:
    """Write the latest row per key of the batches up to ``upto`` as the first batch of the folder ``target``.

    Run it while the stream is stopped, then let the stream write to
    ``target``: later batches stay apart from the compacted ones there, and the
    old folder may go. Nothing is changed in place, so a failed run leaves both
    folders usable.
    """
    rows = spark.read.parquet(f"{path}/part-*").filter(F.col("batch_id") <= upto)
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct("batch_id", seq)).alias("_row"))
    latest.select(key, "_row.*").select(*rows.columns).write.mode("overwrite").parquet(f"{target}/part-{upto:020d}")


def stream_upsert_results(results: DataFrame, path: str, checkpoint: str, **trigger):
    """Start the upsert stream; the caller awaits the returned query."""
    return (
        results.writeStream.foreachBatch(upsert_writer(path)).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def hit_rate_windows(events: DataFrame, ts: str = "ts", hit: str = "hit", error: str = "failed",
                     width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Done, hit and error counts per tumbling window; works on streams and tables alike."""
    timed = events.withWatermark(ts, lateness) if events.isStreaming else events
    return timed.groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("done"), F.count_if(F.col(hit)).alias("with_email"), F.count_if(F.col(error)).alias("errors"),
    ).select(F.col("w.start").alias("window_start"), "done", "with_email", "errors")


def stream_counters(results: DataFrame) -> DataFrame:
    """Running totals of a stream of result rows (complete or update output)."""
    return results.groupBy().agg(
        F.count(F.lit(1)).alias("done"), F.count_if(F.size("emails") > 0).alias("with_email"),
        F.count_if(F.col("error") != "").alias("errors"),
    )


def recent_writer(path: str, n: int = fv.RECENT_ROWS, ts: str = "finished_at"):
    """``foreachBatch`` sink keeping the newest ``n`` rows, newest first.

    Each batch writes the best of itself and of the snapshot before it, so a
    batch handles at most its own rows plus ``n``; a replayed batch reads the
    same earlier snapshot and gives the same result.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [i for i in _snapshots(spark, path) if i < batch_id]
        rows = batch.orderBy(F.col(ts).desc()).limit(n)
        if earlier:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/snap-{max(earlier):020d}"))
        rows.orderBy(F.col(ts).desc()).limit(n).write.mode("overwrite").parquet(f"{path}/snap-{batch_id:020d}")
        for i in sorted(earlier)[:-1]:  # a replay of this batch reads the one before it, and nothing older
            _drop_snapshot(spark, f"{path}/snap-{i:020d}")

    return write


def _drop_snapshot(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    if not exists(spark, path):
        return []
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return [int(x[5:]) for x in names if x.startswith("snap-")]


def read_recent(spark: SparkSession, path: str, ts: str = "finished_at") -> DataFrame:
    newest = max(_snapshots(spark, path))
    return spark.read.parquet(f"{path}/snap-{newest:020d}").orderBy(F.col(ts).desc())


GIVE_UP_OUTPUT = "input_url string, method string, error string, gave_up_at timestamp"


def stream_give_up(progress: DataFrame, seconds: int = fv.GIVE_UP_SECONDS, lateness: str = "0 seconds") -> DataFrame:
    """Targets started but not finished within ``seconds`` of event time.

    ``progress`` is a stream of ``(input_url, kind, at)`` with kind ``started``
    or ``finished``. One short row of state per open target; a target that
    finishes drops its state and its timer.
    """
    message = fv.ERROR_GAVE_UP.format(seconds=seconds)

    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (started,) = state.get
            state.remove()
            at = pd.Timestamp(started + seconds * 1000, unit="ms")
            yield pd.DataFrame({"input_url": [key[0]], "method": ["none"], "error": [message], "gave_up_at": [at]})
            return
        started, finished = (state.get[0] if state.exists else None), False
        for rows in batches:
            finished = finished or bool((rows["kind"] == "finished").any())
            begun = rows.loc[rows["kind"] == "started", "at"]
            if len(begun):
                first = int(begun.min().timestamp() * 1000)
                started = first if started is None else min(started, first)
        if finished:
            if state.exists:
                state.remove()
        elif started is not None:
            state.update((started,))
            state.setTimeoutTimestamp(max(started + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    return (
        progress.withWatermark("at", lateness).groupBy("input_url")
        .applyInPandasWithState(follow, GIVE_UP_OUTPUT, "started long", "append", GroupStateTimeout.EventTimeTimeout)
    )


class GiveUp(StatefulProcessor):
    """State of one target by the clock of the job: its deadline while it is open, and that it is closed for a while after."""

    def __init__(self, seconds: int, remember_seconds: int):
        self.seconds, self.remember = seconds, remember_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deadline = handle.getValueState("deadline", "at long")
        self.closed = handle.getValueState("closed", "at long", ttlDurationMs=self.remember * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kinds = set()
        for part in rows:
            kinds |= set(part["kind"])
        now = timerValues.getCurrentProcessingTimeInMs()
        if "finished" in kinds:
            if self.deadline.exists():
                self.handle.deleteTimer(self.deadline.get()[0])
                self.deadline.clear()
            self.closed.update((now,))
        elif "started" in kinds and not self.deadline.exists() and not self.closed.exists():
            self.deadline.update((now + self.seconds * 1000,))
            self.handle.registerTimer(now + self.seconds * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.deadline.exists():
            at = self.deadline.get()[0]
            self.deadline.clear()
            self.closed.update((at,))
            yield pd.DataFrame({"input_url": [key[0]], "method": ["none"], "error": [fv.ERROR_GAVE_UP.format(seconds=self.seconds)],
                                "gave_up_at": [pd.Timestamp(at, unit="ms")]})

    def close(self) -> None:
        pass


def stream_give_up_by_clock(progress: DataFrame, seconds: int = fv.GIVE_UP_SECONDS, remember_seconds: int = 24 * 3600) -> DataFrame:
    """Targets not finished within ``seconds`` of the arrival of their start, by processing time.

    A target is reported though no later row comes. For ``remember_seconds``
    after it has finished or was given up, a late ``started`` does not open it
    again; then its state expires. The state store has to be RocksDB, see
    ``rocksdb_state``.
    """
    return progress.select("input_url", "kind").groupBy("input_url").transformWithStateInPandas(
        GiveUp(seconds, remember_seconds), GIVE_UP_OUTPUT, "Append", "ProcessingTime")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _moved(progress) -> bool:
    """Whether a batch has taken anything from its sources, be it files without a row."""
    return progress["numInputRows"] > 0 or any(s["startOffset"] != s["endOffset"] for s in progress["sources"])


def run_until_idle(query: StreamingQuery, batches: int = 3, timeout_seconds: float | None = None) -> None:
    """Wait until so many batches in a row have found nothing to read, then stop the query.

    A query with processing-time timers always has another batch to run, so it
    never counts as having processed all that is available. What it has written
    is whole when this returns; a query that fails, is stopped by others or,
    where a time is given, takes longer raises an error.
    """
    until, quiet, last = None if timeout_seconds is None else time.monotonic() + timeout_seconds, 0, -1
    late = False
    while query.isActive and quiet < batches and not late:
        time.sleep(0.05)
        for p in query.recentProgress:
            if p["batchId"] > last:
                last = p["batchId"]
                quiet = 0 if _moved(p) else quiet + 1
        late = until is not None and quiet < batches and time.monotonic() >= until
    failure = query.exception()
    query.stop()
    if failure is not None:
        raise failure
    if late:
        raise TimeoutError(f"the query was still reading after {timeout_seconds:g} seconds and {last + 1} batches; its output is not whole")
    if quiet < batches:
        raise RuntimeError(f"the query was stopped after {last + 1} batches, before it was idle; its output is not whole")


def stream_retry_queue(results: DataFrame, already_retried: DataFrame) -> DataFrame:
    """Failed targets of a result snapshot that were not retried before; each is retried once."""
    return retry_targets(results).select("input_url").join(already_retried.select("input_url"), "input_url", "left_anti")
