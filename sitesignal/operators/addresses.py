"""Addresses and site facts in long form: no array grows with the pages or addresses of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesignal.functions.emails import belongs_to, email_role, role_priority


def site_addresses(pages: DataFrame, keys: list[str], domain: str) -> DataFrame:
    """One row per site and address: role, owner and mailto flags, the first page that shows it, and how many do.

    ``pages`` holds ``url, rank, emails, mailto_emails``. Rows are made distinct
    by (site, address, page) and then counted by (site, address); both steps
    are partial aggregates, and a site's addresses lie in many tasks.
    """
    shown = F.transform("emails", lambda e: F.struct(e.alias("email"), F.lit(True).alias("shown")))
    linked = F.transform("mailto_emails", lambda e: F.struct(e.alias("email"), F.lit(False).alias("shown")))
    hits = pages.select(*keys, "rank", "url", F.explode(F.concat(shown, linked)).alias("_h")).select(*keys, "rank", "url", "_h.*")
    on_page = hits.groupBy(*keys, "email", "url").agg(
        F.min(F.when(F.col("shown"), F.col("rank"))).alias("rank"), F.bool_or(~F.col("shown")).alias("linked"))
    first = F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "url")))
    whole = on_page.groupBy(*keys, "email").agg(
        first.alias("_first"), F.bool_or("linked").alias("from_mailto"), F.count("rank").alias("n_pages"))
    return whole.filter("n_pages > 0").select(
        *keys, "email", email_role("email").alias("role"), belongs_to("email", domain).alias("is_own"), "from_mailto",
        F.col("_first.url").alias("source_page"), "n_pages")


def site_facts(pages: DataFrame, addresses: DataFrame, keys: list[str]) -> DataFrame:
    """One row of fixed size per site: counts, flags and the best address.

    ``best`` is the first own address in contact order, else the first other
    one, and null where a site has none.
    """
    place = F.struct(
        (~F.col("is_own")).alias("not_own"), role_priority("role").alias("priority"), (~F.col("from_mailto")).alias("not_mailto"), "email", "role")
    best = addresses.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_emails"), F.count_if("is_own").alias("n_own"), F.min(place).alias("best"))
    extra = F.size("phones") + F.size("whatsapp") + F.size("social") > 0
    seen = pages.groupBy(*keys).agg(
        F.count_if("fetched").alias("pages_ok"), F.count_if(~F.col("fetched")).alias("pages_failed"),
        F.min(F.when(F.col("blocked_by") != "", F.struct("rank", "blocked_by"))).alias("_blocked"),
        F.bool_or("has_contact_form").alias("has_contact_form"), F.bool_or(extra).alias("has_salvage"))
    facts = seen.join(best, keys, "left").withColumn("blocked_by", F.coalesce("_blocked.blocked_by", F.lit(""))).drop("_blocked")
    facts = facts.withColumn("n_emails", F.coalesce("n_emails", F.lit(0))).withColumn("n_own", F.coalesce("n_own", F.lit(0)))
    return facts.withColumn("fetch_failed", (F.col("n_emails") == 0) & (F.col("pages_ok") == 0) & (F.col("pages_failed") > 0))


def fact_category(method: Column) -> Column:
    """The outcome ``operators.rollup.category_of`` gives the gated result row of the same site."""
    return (
        F.when(F.col("n_emails") > 0, "email_found").when(F.col("blocked_by") != "", "permanently_blocked")
        .when(method.isin("", "none") | F.col("fetch_failed"), "connection_failed")
        .when(F.col("has_salvage"), "salvage_only").when(F.col("has_contact_form"), "has_contact_form").otherwise("genuine_no_result")
    )


def fact_low_quality() -> Column:
    """Addresses found, but none of the site's own, or none of those with a clear role."""
    return (F.col("n_emails") > 0) & ((F.col("n_own") == 0) | (F.col("best.role") == "other"))
