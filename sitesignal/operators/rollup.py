"""Per-site rollup, status, categories and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesignal import fixed_values as fv
from sitesignal.functions.emails import email_role, empty_strings, own_emails, ranked
from sitesignal.operators.attribution import hashed_personal, primary_of, ranked_emails

METADATA = ["page_title", "meta_description", "og_title", "og_description"]
SETS = {  # rollup column: page column
    "emails": "emails",
    "mailto_emails": "mailto_emails",
    "phones": "phones",
    "whatsapp_links": "whatsapp",
    "social_links": "social",
}


def _union(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))


def rollup_site(pages: DataFrame, keys: list[str], salts: int = 256, metadata: str = "block") -> DataFrame:
    """One row per key from its page signals.

    ``pages`` holds ``url, rank, fetched`` and the signal columns. Sets are
    united, the first vendor and the first fetched page's metadata win by rank.
    Two levels: a key with very many pages is first reduced in ``salts`` parts.
    ``salts=1`` skips the first level for groups known to be small.
    ``metadata="fields"`` takes each text from the first page that has it.
    """
    salted = pages.withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(salts)) if salts > 1 else F.lit(0))
    has_email = F.size("emails") > 0
    level1 = [*keys, "_salt"] if salts > 1 else keys
    parts = salted.groupBy(*level1).agg(
        *[_union(page).alias(name) for name, page in SETS.items()],
        F.array_sort(F.collect_set(F.when(has_email, F.col("url")))).alias("source_pages"),
        F.count_if("fetched").alias("pages_ok"),
        F.count_if(~F.col("fetched")).alias("pages_failed"),
        F.min(F.when(F.col("blocked_by") != "", F.struct("rank", "blocked_by"))).alias("_blocked"),
        F.bool_or("has_contact_form").alias("has_contact_form"),
        *_first_metadata(metadata),
    )
    if salts > 1:
        parts = parts.groupBy(*keys).agg(
            *[_union(name).alias(name) for name in SETS],
            _union("source_pages").alias("source_pages"),
            F.sum("pages_ok").alias("pages_ok"),
            F.sum("pages_failed").alias("pages_failed"),
            F.min("_blocked").alias("_blocked"),
            F.bool_or("has_contact_form").alias("has_contact_form"),
            *[F.min(f"_{m}").alias(f"_{m}") for m in METADATA],
        )
    return parts.select(
        *keys, *SETS, "source_pages", "pages_ok", "pages_failed",
        F.coalesce(F.col("_blocked.blocked_by"), F.lit("")).alias("blocked_by"),
        "has_contact_form",
        *[F.coalesce(F.col(f"_{m}.{m}"), F.lit("")).alias(m) for m in METADATA],
    )


def _first_metadata(mode: str) -> list[Column]:
    """Per text, the lowest ``(rank, url)`` among fetched pages, or among those where it is not empty."""
    out = []
    for m in METADATA:
        value = F.col(f"metadata.{m}")
        use = F.col("fetched") if mode == "block" else F.col("fetched") & (value != "")
        out.append(F.min(F.when(use, F.struct("rank", "url", value.alias(m)))).alias(f"_{m}"))
    return out


def _first_text(a: Column, b: Column) -> Column:
    return F.coalesce(F.nullif(a, F.lit("")), b, F.lit(""))


def merge_passes(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Add a later pass: sets united, flags or-ed, texts kept from the earlier pass unless empty. A site known to one pass only stays."""
    merged = [*SETS, "source_pages", "pages_ok", "pages_failed", "blocked_by", "has_contact_form", *METADATA]
    plain = [c for c in first.columns if c not in (*keys, *merged) and c in second.columns]
    later = second.select(*keys, *[F.col(c).alias(f"_2_{c}") for c in [*merged, *plain]])
    out = first.join(later, keys, "full")
    for c in plain:
        out = out.withColumn(c, F.coalesce(c, f"_2_{c}"))
    for c in [*SETS, "source_pages"]:
        out = out.withColumn(c, F.array_sort(F.array_union(F.coalesce(c, empty_strings()), F.coalesce(f"_2_{c}", empty_strings()))))
    for c in ["pages_ok", "pages_failed"]:
        out = out.withColumn(c, F.coalesce(c, F.lit(0)) + F.coalesce(f"_2_{c}", F.lit(0)))
    for c in ["blocked_by", *METADATA]:
        out = out.withColumn(c, _first_text(F.col(c), F.col(f"_2_{c}")))
    out = out.withColumn("has_contact_form", F.coalesce("has_contact_form", F.lit(False)) | F.coalesce("_2_has_contact_form", F.lit(False)))
    return out.drop(*[f"_2_{c}" for c in [*merged, *plain]])


def empty_status(emails: Column, ok: Column, failed: Column) -> tuple[Column, Column]:
    """``(fetch_failed, error)`` of a site whose candidate pages were looked at."""
    none = F.size(emails) == 0
    all_failed = none & (ok == 0) & (failed > 0)
    before, after = fv.ERROR_ALL_FAILED.split("{n}")
    message = (
        F.when(all_failed, F.concat(F.lit(before), failed.cast("string"), F.lit(after)))
        .when(none, fv.ERROR_NO_EMAILS)
        .otherwise("")
    )
    return all_failed, message


def salvage_gate(results: DataFrame) -> DataFrame:
    """Expose phones, messaging and social links only where no address was found on fetched pages."""
    open_ = (F.size("emails") == 0) & ~F.col("fetch_failed")
    for c in ["phones", "whatsapp_links", "social_links"]:
        results = results.withColumn(c, F.when(open_, F.col(c)).otherwise(empty_strings()))
    return results


def flatten_result(results: DataFrame, personal_salt: str | None = None) -> DataFrame:
    """The 18 text columns of a result file; ``personal_salt`` hashes personal addresses."""
    both = ranked_emails(results)
    shown = (
        (lambda e: e["email"]) if personal_salt is None
        else (lambda e: hashed_personal(e["email"], e["role"], personal_salt))
    )
    best = primary_of(F.col("ranked_own"), F.col("ranked_other"))
    join = lambda c: F.array_join(c, "; ")
    best_email = best["email"] if personal_salt is None else hashed_personal(best["email"], best["role"], personal_salt)
    return both.select(
        "input_url", "domain",
        F.coalesce(best_email, F.lit("")).alias("primary_email"),
        F.coalesce(best["role"], F.lit("")).alias("primary_role"),
        join(F.transform("ranked_own", shown)).alias("own_domain_emails"),
        join(F.transform("ranked_other", shown)).alias("other_domain_emails"),
        join(F.array_sort("phones")).alias("phone"),
        join(F.array_sort("whatsapp_links")).alias("whatsapp"),
        join(F.array_sort("social_links")).alias("social_links"),
        "method",
        join(F.array_sort("source_pages")).alias("source_pages"),
        "error", "blocked_by",
        F.when(F.col("has_contact_form"), "True").otherwise("False").alias("has_contact_form"),
        *METADATA,
    )


def category_of() -> Column:
    """One of six exclusive outcomes of a result row."""
    salvage = (F.size("phones") > 0) | (F.size("whatsapp_links") > 0) | (F.size("social_links") > 0)
    return (
        F.when(F.size("emails") > 0, "email_found")
        .when(F.col("blocked_by") != "", "permanently_blocked")
        .when(F.col("method").isin("", "none") | F.col("fetch_failed"), "connection_failed")
        .when(salvage, "salvage_only")
        .when(F.col("has_contact_form"), "has_contact_form")
        .otherwise("genuine_no_result")
    )


def categorize(results: DataFrame) -> DataFrame:
    return results.withColumn("category", category_of())


def retry_targets(results: DataFrame) -> DataFrame:
    """Connection-class failures that are not known blocks."""
    return results.filter(((F.col("method") == "none") | F.col("fetch_failed")) & (F.col("blocked_by") == ""))


def is_low_quality() -> Column:
    own = own_emails("emails", "domain")
    best = F.get(ranked(own, "mailto_emails"), F.lit(0))
    return (F.size("emails") > 0) & ((F.size(own) == 0) | (best["role"] == "other"))


def low_quality(results: DataFrame) -> DataFrame:
    """Sites with an address, but none of their own, or only one without a clear role."""
    return results.filter(is_low_quality())


def second_pass_targets(results: DataFrame) -> DataFrame:
    """Sites worth a rendered pass; ``pass_order`` 0 are empty results, 1 weak ones."""
    order = F.when(category_of() == "genuine_no_result", 0).when(is_low_quality(), 1)
    return results.withColumn("pass_order", order).filter(F.col("pass_order").isNotNull())


def latest_per_target(rows: DataFrame, key: str = "input_url", seq: str = "seq") -> DataFrame:
    """Last content per target at its first position (``first_seq``)."""
    rest = [c for c in rows.columns if c not in (key, seq)]
    latest = rows.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.col(seq)).alias("_row"), F.min(seq).alias("first_seq")
    )
    return latest.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest], "first_seq")


def resume_remaining(targets: DataFrame, done: DataFrame) -> DataFrame:
    """Targets without a row in ``done``; error rows count as done."""
    return targets.join(done.select("input_url"), "input_url", "left_anti")


def summarize(categorized: DataFrame) -> DataFrame:
    """Total and the six counts in one row, zeros included."""
    return categorized.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("category") == c).alias(c) for c in fv.CATEGORIES],
    )


def hit_rate_trend(history: DataFrame, limit: int = fv.HISTORY_LIMIT) -> DataFrame:
    """Newest summaries, oldest first, with hit rate and its change."""
    newest = history.orderBy(F.col("timestamp").desc()).limit(limit)
    rate = F.when(F.col("total") > 0, F.col("email_found") / F.col("total")).otherwise(F.lit(0.0))
    in_time = Window.orderBy("timestamp")  # at most `limit` rows
    return (
        newest.withColumn("hit_rate", rate)
        .withColumn("hit_rate_change", F.col("hit_rate") - F.lag("hit_rate").over(in_time))
        .orderBy("timestamp")
    )


def run_counters(results: DataFrame, total: int, elapsed_seconds: float) -> DataFrame:
    """Done, with-email and error counts, rate per second and seconds left."""
    counts = results.agg(
        F.count(F.lit(1)).alias("done"),
        F.count_if(F.size("emails") > 0).alias("with_email"),
        F.count_if(F.col("error") != "").alias("errors"),
    )
    rate = F.lit(0.0) if elapsed_seconds <= 0 else F.col("done") / F.lit(float(elapsed_seconds))
    return counts.withColumn("rate", rate).withColumn(
        "eta_seconds", F.when(F.col("rate") > 0, (F.lit(total) - F.col("done")) / F.col("rate")).otherwise(F.lit(0.0))
    )
