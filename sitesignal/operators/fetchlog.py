"""Fetch-log and politeness analytics over ``(url, domain, attempt, status, retry_after, requested_at)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesignal import fixed_values as fv
from sitesignal.functions.urls import strip_blanks
from sitesignal.operators.skew import join_by_load, position_in_key, previous_in_time


def fetch_outcome(log: DataFrame) -> DataFrame:
    """Outcome of the last attempt per URL: ``ok``, ``retryable`` or ``failed``."""
    last = log.groupBy("url").agg(F.max(F.struct("attempt", "status")).alias("_last"))
    status, attempt = F.col("_last.status"), F.col("_last.attempt")
    transient = status.isNull() | status.isin(fv.RETRYABLE_STATUSES)
    outcome = (
        F.when(status == 200, "ok").when(transient & (attempt < fv.FETCH_ATTEMPTS - 1), "retryable").otherwise("failed")
    )
    return last.select("url", attempt.alias("attempt"), status.alias("status"), outcome.alias("outcome"))


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds asked for by a Retry-After value: whole seconds or an HTTP date; null when unreadable."""
    v = strip_blanks(value)
    shape = r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})(?:\s+(GMT|UTC|[+\-]\d{4}))?$"
    date, zone = F.regexp_extract(v, shape, 1), F.regexp_extract(v, shape, 2)
    offset = F.when(zone.rlike(r"^[+\-]\d{4}$") & (zone != "-0000"), zone).otherwise(F.lit("+0000"))
    when = F.try_to_timestamp(F.concat(date, F.lit(" "), offset), F.lit("d MMM yyyy HH:mm:ss Z"))
    wait = (F.unix_micros(when) - F.unix_micros(now)) / 1e6
    return F.when(v.rlike(r"^\d+$"), v.try_cast("double")).when(date != "", F.greatest(F.lit(0.0), wait))


def backoff_ceiling(attempt: Column, base: float = 1.0, cap: float = fv.MAX_BACKOFF_SECONDS) -> Column:
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt))


def capped_retry_after(value: Column, now: Column) -> Column:
    """The wait that is honoured; null when the value is unreadable."""
    seconds = retry_after_seconds(value, now)
    return F.when(seconds.isNotNull(), F.least(F.lit(fv.MAX_RETRY_AFTER_SECONDS), seconds))


def backoff_audit(log: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """Retries with the time waited and whether it exceeds the ceiling of the failed attempt.

    ``intervals`` holds ``(domain, min_interval)``. Where the failed attempt was
    refused with 429 and a readable Retry-After, the capped value of that is
    the ceiling in place of the backoff.
    """
    steps = previous_in_time(log, ["url"], "requested_at", ["attempt"], ["requested_at", "attempt", "status", "retry_after"])
    retries = steps.filter((F.col("attempt") > 0) & (F.col("prev_attempt") == F.col("attempt") - 1))
    if intervals is not None:
        retries = join_by_load(retries, intervals, "domain")
    else:
        retries = retries.withColumn("min_interval", F.lit(None).cast("double"))
    waited = (
        F.unix_micros(F.col("requested_at").cast("timestamp")) - F.unix_micros(F.col("prev_requested_at").cast("timestamp"))
    ) / 1e6
    asked = F.when(F.col("prev_status") == 429, capped_retry_after(F.col("prev_retry_after"), F.col("prev_requested_at")))
    ceiling = F.coalesce(asked, backoff_ceiling(F.col("prev_attempt"))) + F.coalesce("min_interval", F.lit(fv.DEFAULT_MIN_INTERVAL_SECONDS))
    return retries.select(
        "url", "domain", "attempt", waited.alias("waited"), ceiling.alias("ceiling"),
        (waited > ceiling).alias("excess"),
    )


def politeness_audit(log: DataFrame, intervals: DataFrame | None = None, tie: str = "url") -> DataFrame:
    """Gap to the domain's previous request, and whether it is shorter than the interval."""
    rows = previous_in_time(log, ["domain"], "requested_at", [tie], ["requested_at"])
    gap = (
        F.unix_micros(F.col("requested_at").cast("timestamp")) - F.unix_micros(F.col("prev_requested_at").cast("timestamp"))
    ) / 1e6
    if intervals is not None:
        rows = join_by_load(rows, intervals, "domain")
    else:
        rows = rows.withColumn("min_interval", F.lit(None).cast("double"))
    rows = rows.withColumn("min_interval", F.coalesce("min_interval", F.lit(fv.DEFAULT_MIN_INTERVAL_SECONDS)))
    return rows.withColumn("gap", gap).withColumn(
        "too_soon", F.coalesce(F.col("gap") < F.col("min_interval"), F.lit(False))
    ).drop("prev_requested_at")


def crawl_schedule(candidates: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """Earliest start in seconds per allowed candidate ``(domain, site, url, rank)``.

    Requests to one domain follow each other at its interval, best ranks first.
    """
    placed = position_in_key(candidates, ["domain"], ["rank", "site", "url"])
    if intervals is not None:
        placed = join_by_load(placed, intervals, "domain")
    else:
        placed = placed.withColumn("min_interval", F.lit(None).cast("double"))
    interval = F.coalesce("min_interval", F.lit(fv.DEFAULT_MIN_INTERVAL_SECONDS))
    return placed.withColumn("start_seconds", (F.col("position") - 1) * interval).drop("min_interval")
