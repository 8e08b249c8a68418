"""Which pages of a site to look at, in which order, and where to stop."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesignal import fixed_values as fv
from sitesignal.functions.files import resolve_links
from sitesignal.functions.urls import (
    is_rejected_path, netloc, path_segments, path_tokens, score_expr, url_path,
)
from sitesignal.operators.skew import top_k


def score_contact_urls(urls: DataFrame, url: str = "url", keywords=fv.CONTACT_KEYWORDS,
                       hard=fv.HARD_CONTACT_KEYWORDS, primary=fv.PRIMARY_CONTACT_KEYWORDS,
                       negative=fv.NEGATIVE_PATH_WORDS) -> DataFrame:
    """Adds ``score``; rows that are no contact candidates are dropped.

    A keyword that is a token stands between slashes, hyphens or ends of the
    path, so one pattern discards almost all URLs before any array is built.
    """
    any_word = "(?:^|[/-])(?:" + "|".join(re.escape(w) for w in keywords) + ")(?:[/-]|$)"
    return (
        urls.withColumn("_path", F.lower(url_path(url)))
        .filter(F.col("_path").rlike(any_word))
        .withColumn("_segments", path_segments("_path"))
        .withColumn("_tokens", path_tokens("_segments"))
        # unfolding zero or one score drops rejected rows without a filter, which
        # the optimizer would push down as a second copy of the whole expression
        .withColumn("score", F.explode(F.array_compact(F.array(score_expr(
            F.col("_segments"), F.col("_tokens"), F.col("_path"), keywords, hard, primary, negative)))))
        .drop("_path", "_segments", "_tokens")
    )


def top_candidates(scored: DataFrame, keys: list[str], k: int = fv.MAX_PAGES_PER_SITE) -> DataFrame:
    """Best ``k`` per site; equal scores keep the input order ``ord``."""
    return top_k(scored, keys, [F.col("score").desc(), F.col("ord"), F.col("url")], k)


def footer_links(base: Column, page: Column) -> Column:
    """Contact-like links of the first footer, or of the page when it has none; resolved, in order."""
    chosen = F.filter(
        page["anchors"], lambda a: a["hinted"] & (a["in_footer"] | ~page["has_footer"])
    )
    return F.array_distinct(resolve_links(base, F.transform(chosen, lambda a: a["href"])))


def all_links(base: Column, page: Column) -> Column:
    return F.array_distinct(resolve_links(base, F.transform(page["anchors"], lambda a: a["href"])))


def second_hop_links(base: Column, links: Column, tried: Column, k: int = fv.MAX_SECOND_HOP_LINKS) -> Column:
    """Shallow links to the same host not tried yet, fewest path segments first.

    ``links`` are resolved and distinct; equal depths keep the page order.
    """

    def entry(link: Column, i: Column) -> Column:
        path = F.lower(url_path(link))
        segments = path_segments(path)
        fits = (
            (netloc(link) == netloc(base))
            & ~F.array_contains(tried, link)
            & ~is_rejected_path(path_tokens(segments), path)
            & (F.size(segments) <= fv.MAX_SECOND_HOP_SEGMENTS)
        )
        return F.struct(fits.alias("fits"), F.size(segments).alias("depth"), i.alias("i"), link.alias("link"))

    entries = F.filter(F.transform(links, entry), lambda e: e["fits"])
    return F.slice(F.transform(F.array_sort(entries), lambda e: e["link"]), 1, k)


def early_stop(pages: DataFrame, keys: list[str], wave_size: int = fv.WAVE_SIZE,
               min_pages: int = fv.MIN_PAGES_BEFORE_STOP) -> DataFrame:
    """Pages that still count: waves in rank order end once an address was seen.

    ``pages`` holds the allowed pages of each key with ``rank`` and
    ``has_email``. Groups are small: candidate lists are capped per site.
    """
    by_rank = Window.partitionBy(*keys).orderBy("rank")
    earlier = Window.partitionBy(*keys).orderBy("wave").rangeBetween(Window.unboundedPreceding, -1)
    waved = pages.withColumn("wave", F.floor((F.row_number().over(by_rank) - 1) / wave_size))
    seen = F.coalesce(F.sum(F.col("has_email").cast("int")).over(earlier), F.lit(0))
    checked = F.coalesce(F.count(F.lit(1)).over(earlier), F.lit(0))
    return (
        waved.withColumn("_stop", (seen > 0) & (checked >= min_pages)).filter(~F.col("_stop")).drop("_stop")
    )


def reachable_gate(sites: DataFrame, probe: DataFrame, site: str = "site") -> DataFrame:
    """Adds ``reachable``: any HTTP status counts as an answer."""
    answered = probe.groupBy(site).agg(F.max(F.col("status").isNotNull()).alias("_answered"))
    return (
        sites.join(answered, site, "left")
        .withColumn("reachable", F.coalesce("_answered", F.lit(False))).drop("_answered")
    )
