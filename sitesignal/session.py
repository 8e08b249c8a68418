"""Session settings and lineage cutting."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even when the split costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # lets a table bucketed by URL key join on (key, time) without a shuffle
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    # plans here have many columns; recording a call site for each one costs more than building it
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # pages vary from bytes to megabytes, so batches are small in rows and bounded in bytes
    BATCH_ROWS: "1000",
    BATCH_BYTES: str(64 * 1024 * 1024),
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST_BYTES = 64 * 1024 * 1024
PAGE_BATCH_BYTES = 8 * 1024 * 1024
ROW_OVERHEAD_BYTES = 64
#: options for rows of up to megabytes. A Parquet writer looks at the size of its pages and row groups after each row, not
#: after 100 of them, and holds a quarter of the usual row group
LONG_ROWS = {
    BATCH_ROWS: RECOMMENDED[BATCH_ROWS],
    BATCH_BYTES: str(PAGE_BATCH_BYTES),
    "parquet.page.size.row.check.min": "1",
    "parquet.block.size": str(32 * 1024 * 1024),
}


def build_session(app: str = "sitesignal", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: the cluster's ``spark.checkpoint.dir``.

    Where that is unset, as in tests, a folder in the warehouse, which all
    executors share as well. No session option is changed.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/_staged").rstrip("/")


_group: ContextVar[str | None] = ContextVar("staging_group", default=None)
_staged: dict[str, list[str]] = {}


@contextmanager
def staging_group(name: str) -> Iterator[None]:
    """Tables staged inside belong to the group, so that ``release`` can delete them when their last reader is done."""
    token = _group.set(name)
    try:
        yield
    finally:
        _group.reset(token)


def release(spark: SparkSession, name: str) -> None:
    """Delete what a group has staged. Results that still read it must have been written before."""
    jvm = spark._jvm
    for path in _staged.pop(name, []):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def _option(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session option that is as before once the block ends."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _own_shuffles_removed(spark: SparkSession):
    """Shuffle files of a job that runs inside go when it ends, not when the driver happens to collect its garbage."""
    return _option(spark, SHUFFLE_CLEANUP, "true")


@contextmanager
def page_batches(spark: SparkSession) -> Iterator[None]:
    """What is staged inside hands pages to Python in batches of the recommended number of rows and ``PAGE_BATCH_BYTES``,
    whatever the session has, so that a worker's memory does not follow the size of its split."""
    with _option(spark, BATCH_ROWS, RECOMMENDED[BATCH_ROWS]), _option(spark, BATCH_BYTES, str(PAGE_BATCH_BYTES)):
        yield


def keep_long_rows_bounded(spark: SparkSession) -> None:
    """Set the options of ``LONG_ROWS`` that the session has not or has larger. They stay: what a function returns is computed
    and written when its caller asks for it, under the options the session has by then."""
    for name, value in LONG_ROWS.items():
        before = spark.conf.get(name, None) or ""
        if not (before.isdigit() and 0 < int(before) <= int(value)):
            spark.conf.set(name, value)


@contextmanager
def long_rows(spark: SparkSession) -> Iterator[None]:
    """What is written inside is written under the options of ``LONG_ROWS``; the session is as before afterwards."""
    before = {name: spark.conf.get(name, None) for name in LONG_ROWS}
    keep_long_rows_bounded(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stage(df: DataFrame, label: str, **options: str | int) -> DataFrame:
    """Write a step to the shared folder and read it back.

    Cuts the lineage, survives lost executors, lets later joins see the real
    size of the step and keeps column pruning, which a checkpoint does not.
    What the step shuffled is of no more use then and is removed. ``options``
    are the writer's.
    """
    path = f"{stage_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if group := _group.get():
        _staged.setdefault(group, []).append(path)
    with _own_shuffles_removed(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _estimated_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits_broadcast(staged: DataFrame, column: str, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the values of a staged table's column, once in memory, are within the bound.

    The files' size rules out large tables; what passes is measured, since
    files are compressed.
    """
    if _estimated_bytes(staged) > limit:
        return False
    size = staged.agg(F.sum(F.octet_length(column) + F.lit(ROW_OVERHEAD_BYTES)).alias("n")).first()["n"] or 0
    return size <= limit


def spread(scan: DataFrame, bytes_per_core: int = 4 * 1024 * 1024) -> DataFrame:
    """Use all cores for a scan too small to have a split per core.

    Meant for inputs of costly row-wise work. The shuffle is at most
    ``bytes_per_core`` per core; a larger input passes unchanged.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if _estimated_bytes(scan) < bytes_per_core * cores else scan
