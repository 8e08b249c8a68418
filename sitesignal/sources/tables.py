"""Readers: targets, captures, robots, sitemaps, MX snapshot, fetch log, results, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitesignal import fixed_values as fv
from sitesignal.functions.urls import netloc, strip_blanks
from sitesignal.operators.rollup import latest_per_target
from sitesignal.session import stage

CAPTURES = "url string, html string, status int, fetched_at timestamp, pass string"
RESULTS = T.StructType([T.StructField(c, T.StringType()) for c in fv.RESULT_COLUMNS])
HISTORY = "timestamp timestamp, total bigint, " + ", ".join(f"{c} bigint" for c in fv.CATEGORIES)


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jvm_path)


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """``(input_url)`` from a text file: blank and ``#`` lines dropped, text before the first comma kept."""
    return targets_of_lines(spark.read.text(path))


def read_target_list(spark: SparkSession, path: str) -> DataFrame:
    """``(input_url, ord)`` of text files: ``ord`` is the number of the line, from 1, files in the order of their names.

    A line's number is its place in its block plus the lines of all blocks
    before, so only one row per block is ever in one order.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    lines = stage(lines, "target-lines")
    blocks = lines.groupBy("file", "block").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).drop("n", "least")
    numbered = lines.join(F.broadcast(blocks), ["file", "block"]).withColumn("ord", F.col("place") + F.col("offset") + 1)
    return targets_of_lines(numbered, keep=["ord"])


def targets_of_lines(lines: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    line = strip_blanks(value)
    return lines.withColumn("_line", line).filter((F.col("_line") != "") & ~F.col("_line").startswith("#")).select(
        strip_blanks(F.substring_index("_line", ",", 1)).alias("input_url"), *(keep or []))


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captured pages. A ``body`` column of bytes is decoded, bad bytes replaced."""
    raw = spark.read.format(fmt)
    if fmt == "json":
        raw = raw.schema(CAPTURES)
    return decoded_captures(raw.load(path))


def decoded_captures(captures: DataFrame) -> DataFrame:
    if "html" not in captures.columns and "body" in captures.columns:
        captures = captures.withColumn("html", F.make_valid_utf8(F.col("body").cast("string"))).drop("body")
    if "pass" not in captures.columns:
        captures = captures.withColumn("pass", F.lit("static"))
    return captures


def usable_text(captures: DataFrame) -> DataFrame:
    """``text`` of answered pages; other answers keep only ``block_text`` for block-page checks."""
    ok = F.coalesce(F.col("status") == 200, F.lit(False))
    return captures.withColumn("usable", ok).withColumn("text", F.when(ok, F.col("html"))).withColumn(
        "block_text", F.col("html"))


def write_captures(captures: DataFrame, table: str, buckets: int = 512) -> None:
    """Captures as a table bucketed by URL key, so URL lookups do not shuffle page bodies."""
    from sitesignal.functions.urls import capture_key

    keyed = captures.withColumn("key", capture_key("url"))
    keyed.write.bucketBy(buckets, "key").sortBy("key").format("parquet").saveAsTable(table)


def read_robots(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``(host, body)``; with ``fmt='text'`` one file per host, named after it."""
    if fmt == "text":
        files = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_name").alias("_name"), F.col("value").alias("body"))
        return files.select(F.regexp_replace(F.url_decode("_name"), r"\.txt$", "").alias("host"), "body")
    return spark.read.format(fmt).load(path)


def read_sitemaps(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``(url, host, body)``; with ``fmt='binaryFile'`` one file per URL, named after its encoded form."""
    if fmt == "binaryFile":
        files = spark.read.format("binaryFile").load(path)
        named = files.select(F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1)).alias("url"), F.col("content").alias("body"))
        # a listed path may carry one more level of encoding
        named = named.withColumn("url", F.when(F.col("url").contains("%3A"), F.url_decode("url")).otherwise(F.col("url")))
        return named.withColumn("host", netloc("url"))
    return spark.read.format(fmt).load(path)


def read_mx(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``(domain, has_mx)``; null means unknown."""
    return spark.read.format(fmt).load(path)


def read_fetch_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def read_completed(spark: SparkSession, path: str) -> DataFrame:
    """Distinct targets that already have a row, error rows included; a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "input_url string")
    return read_results_csv(spark, path).select("input_url").filter(F.coalesce("input_url", F.lit("")) != "").distinct()


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULTS).option("header", True).option("multiLine", True).option("quote", '"').option(
        "escape", '"').csv(path)


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """Every row written by any pass, with its ``seq``."""
    return spark.read.parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per target: its latest attempt, with its first position."""
    return latest_per_target(read_attempts(spark, path))


def read_history(spark: SparkSession, path: str, limit: int = fv.HISTORY_LIMIT) -> DataFrame:
    """Last ``limit`` summaries, oldest first; unreadable lines are skipped, a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], HISTORY)
    return last_summaries(spark.read.text(path), limit)


def last_summaries(lines: DataFrame, limit: int = fv.HISTORY_LIMIT, value: str = "value") -> DataFrame:
    parsed = lines.select(F.from_json(value, HISTORY, {"mode": "PERMISSIVE"}).alias("_h")).select("_h.*")
    good = parsed.filter(F.col("timestamp").isNotNull())
    return good.orderBy(F.col("timestamp").desc()).limit(limit).orderBy("timestamp")
