"""Streams whose result is their state, read back as a table through the state data source.

Nothing is written per batch but the state store's own change files. A replayed
batch starts from the state before it, so every row counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from sitesignal import fixed_values as fv
from sitesignal.operators.rollup import latest_per_target
from sitesignal.streaming.streams import rocksdb_state, stream_counters

MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def keep_state(query: DataFrame, checkpoint: str, mode: str = "update", **trigger) -> StreamingQuery:
    """Start a stream that leaves nothing but its state; the caller awaits the returned query."""
    writer = query.writeStream.format("noop").outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def keep_latest(rows: DataFrame, checkpoint: str, key: str = "input_url", seq: str = "seq", **trigger) -> StreamingQuery:
    """The last row per target, whatever batch it came in: ``seq`` alone decides."""
    return keep_state(latest_per_target(rows, key, seq), checkpoint, **trigger)


def read_latest(spark: SparkSession, checkpoint: str, schema: StructType, key: str = "input_url", seq: str = "seq") -> DataFrame:
    """The table ``latest_per_target`` gives over all rows so far; ``schema`` is that of the streamed rows."""
    rest = [f for f in schema.fields if f.name not in (key, seq)]
    order = schema[seq].dataType.simpleString()
    # the state of an aggregate has fields by position: the row, its order, the first order
    shape = f"struct<last:{StructType(rest).simpleString()},last_seq:{order},first_seq:{order}>"
    state = spark.read.format("statestore").load(checkpoint).select(F.col(f"key.{key}").alias(key), F.col("value").cast(shape).alias("_v"))
    return state.select(key, *[F.col(f"_v.last.{f.name}").alias(f.name) for f in rest], F.col("_v.first_seq").alias("first_seq"))


def keep_counters(results: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    return keep_state(stream_counters(results), checkpoint, **trigger)


def read_counters(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row of running totals; no row before the first batch."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("value").cast("struct<done:bigint,with_email:bigint,errors:bigint>").alias("_v")).select("_v.*")


class Newest(StatefulProcessor):
    """The newest rows of one part of the stream, as ``(at, row)``; older ones are evicted."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getListState("newest", "at long, row string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [(int(at), row) for at, row in self.newest.get()]
        for part in rows:
            kept.extend((int(at), row) for at, row in zip(part["at"], part["row"]))
            kept = sorted(kept, reverse=True)[:self.n]
        self.newest.put(kept)
        return iter(())

    def close(self) -> None:
        pass


def keep_newest(rows: DataFrame, checkpoint: str, n: int = fv.RECENT_ROWS, ts: str = "finished_at", parts: int = 32, **trigger) -> StreamingQuery:
    """The newest ``n`` rows of each of ``parts`` parts by hash, so that no task sees the whole stream.

    Rows without a time are the oldest; equal times are ordered by the row's
    JSON text. Repeated rows count as often as they come.
    """
    at = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(2**63)))
    text = rows.select(at.alias("at"), F.to_json(F.struct(*rows.columns), MICROS).alias("row"))
    dealt = text.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    with rocksdb_state(rows.sparkSession):
        return keep_state(dealt.groupBy("part").transformWithStateInPandas(Newest(n), "part long", "Append", "None"), checkpoint, "append", **trigger)


def read_newest(spark: SparkSession, checkpoint: str, schema: StructType, n: int = fv.RECENT_ROWS) -> DataFrame:
    """Newest first, at most ``n``, which is the number the stream was started with."""
    with rocksdb_state(spark):
        state = spark.read.format("statestore").option("stateVarName", "newest").load(checkpoint)
    best = state.select("list_element.at", "list_element.row").orderBy(F.col("at").desc(), F.col("row").desc()).limit(n)
    return best.select("at", F.from_json("row", schema, MICROS).alias("_r"), "row").orderBy(F.col("at").desc(), F.col("row").desc()).select("_r.*")
