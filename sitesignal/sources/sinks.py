"""Writers: result files, attempt log, run history, job key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal import fixed_values as fv


def write_results_csv(flat: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header and the 18 columns in their fixed order, UTF-8."""
    flat.select(*fv.RESULT_COLUMNS).write.mode(mode).option("header", True).option("encoding", "UTF-8").option(
        "quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def append_attempts(flat: DataFrame, path: str, seq: int) -> None:
    """Append one pass; ``seq`` grows with every pass, so the latest row of a target wins."""
    flat.withColumn("seq", F.lit(seq).cast("bigint")).write.mode("append").parquet(path)


def append_history(summary: DataFrame, path: str) -> None:
    """Append one JSON record with the current UTC time."""
    stamped = summary.select(
        F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).alias("_t"), *summary.columns)
    stamped = stamped.withColumn("timestamp", F.concat(F.date_format("_t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")))
    stamped.select("timestamp", "total", *fv.CATEGORIES).write.mode("append").json(path)


def job_key(targets: DataFrame) -> DataFrame:
    """Order-independent key of a target list, one row.

    Each line is hashed, its hash is cut into five numbers, and the numbers are
    added up over all lines; the key is the start of the hash of the sums. Any
    size has the same form, repeats count, and no task holds the list. The key
    of an empty list is that of five zeros.
    """
    line = targets.select(F.sha1(F.coalesce("input_url", F.lit(""))).alias("h"))
    chunk = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = line.agg(*[F.coalesce(F.sum(chunk(i)), F.lit(0)).cast("string").alias(f"s{i}") for i in range(5)])
    return sums.select(F.substring(F.sha1(F.concat_ws(",", *[f"s{i}" for i in range(5)])), 1, 16).alias("job_key"))
