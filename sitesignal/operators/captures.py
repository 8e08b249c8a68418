"""Lookup of captured pages by URL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.functions.urls import capture_key, site_of
from sitesignal.session import fits_broadcast, spread


def keyed(captures: DataFrame, pass_name: str = "static") -> DataFrame:
    """Captures of one pass as ``(key, site, html, status, fetched_at)``."""
    if "pass" in captures.columns:
        captures = captures.filter(F.col("pass") == pass_name)
    # a table bucketed by key keeps its own key column and layout
    bucketed = "key" in captures.columns
    captures = captures if bucketed else spread(captures)
    at = F.col("fetched_at").cast("timestamp") if "fetched_at" in captures.columns else F.lit(None).cast("timestamp")
    return captures.select(
        F.col("key") if bucketed else capture_key("url").alias("key"), site_of("url").alias("site"), "html", F.col("status").cast("int").alias("status"),
        F.coalesce(at, F.timestamp_seconds(F.lit(0))).alias("fetched_at"),
    )


def latest_matching(captures: DataFrame, wanted: DataFrame) -> DataFrame:
    """Newest capture of each wanted key.

    ``wanted`` is a staged table, so its size is known. The newest time per key
    is found on the two narrow columns alone; page bodies are then read once
    and, when the keys fit the broadcast bound, never shuffled.
    """
    small = fits_broadcast(wanted, "key")
    hint = F.broadcast if small else (lambda df: df)
    keys = wanted.select("key").distinct()
    # one row per wanted key, so it is no larger than `wanted` plus a time
    newest = (
        captures.select("key", "fetched_at").join(hint(keys), "key", "left_semi")
        .groupBy("key").agg(F.max("fetched_at").alias("fetched_at"))
    )
    return captures.join(hint(newest), ["key", "fetched_at"])


def one_per_key(rows: DataFrame, tie: str = "_tie") -> DataFrame:
    """Settle captures of one URL at one time; the rows are small by now."""
    rest = [c for c in rows.columns if c not in ("key", tie)]
    picked = rows.groupBy("key").agg(F.min_by(F.struct(*rest), F.col(tie)).alias("_row"))
    return picked.select("key", *[F.col(f"_row.{c}").alias(c) for c in rest])
