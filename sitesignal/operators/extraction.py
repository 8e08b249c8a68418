"""Page signals: one row of captured markup to one row of contact signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesignal import fixed_values as fv
from sitesignal.functions import emails as E
from sitesignal.functions import signals as S
from sitesignal.functions.page_scan import scan

SIGNALS = ["emails", "mailto_emails", "phones", "whatsapp", "social", "blocked_by", "has_contact_form", "metadata"]


def hrefs(page: Column) -> Column:
    return F.coalesce(F.transform(page["anchors"], lambda a: a["href"]), E.empty_strings())


def page_signals(captures: DataFrame, keep: list[str], html: str = "html", status: str | None = "status",
                 blocked_domains=fv.BLOCKED_DOMAINS, blocked_locals=fv.BLOCKED_LOCAL_PARTS,
                 strict_obfuscation: bool = False, keywords=fv.CONTACT_KEYWORDS) -> DataFrame:
    """Columns ``keep`` plus ``fetched`` and the signal columns.

    Only pages with status 200 yield signals; the body of any other answer is
    still checked for block-page markers. Row-wise, so it also runs on streams.
    """
    usable = F.lit(True) if status is None else F.coalesce(F.col(status) == 200, F.lit(False))
    scanned = captures.select(
        *keep,
        F.col(html).alias("_raw"),
        usable.alias("fetched"),
        scan(F.when(usable, F.col(html)), keywords).alias("_page"),
    )
    page, raw = F.col("_page"), F.when(F.col("fetched"), F.col("_raw"))
    links = hrefs(page)
    mailto = E.mailto_addresses(links)
    found = F.concat(
        E.protected_emails(raw), E.plain_emails(page["json_hits"]), mailto, E.plain_emails(page["text"]),
        E.plain_emails(page["markup_hits"]), E.obfuscated_emails(page["text"], strict_obfuscation),
    )
    phones = F.concat(
        F.coalesce(S.tel_links(raw), E.empty_strings()), S.international_phones(page["text"])
    )
    text = lambda name: F.coalesce(page[name], F.lit(""))
    return scanned.select(
        *keep,
        "fetched",
        E.valid_distinct(found, blocked_domains, blocked_locals).alias("emails"),
        E.valid_distinct(mailto, blocked_domains, blocked_locals).alias("mailto_emails"),
        F.array_sort(F.array_distinct(phones)).alias("phones"),
        F.coalesce(S.whatsapp_links(raw), E.empty_strings()).alias("whatsapp"),
        S.social_profiles(links).alias("social"),
        F.coalesce(S.block_vendor("_raw"), F.lit("")).alias("blocked_by"),
        F.coalesce(S.has_contact_form(page["forms"]), F.lit(False)).alias("has_contact_form"),
        F.struct(
            text("title").alias("page_title"),
            text("description").alias("meta_description"),
            text("og_title").alias("og_title"),
            text("og_description").alias("og_description"),
        ).alias("metadata"),
    )
