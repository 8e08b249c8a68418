"""Phone, messaging, social, block-page and form expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitesignal import fixed_values as fv
from sitesignal.functions.emails import _all_matches, empty_strings
from sitesignal.functions.urls import col_of, strip_blanks


def tel_links(html: Column | str) -> Column:
    c = col_of(html)
    found = F.transform(
        _all_matches(c, fv.TEL_LINK_PATTERN, 1), lambda t: strip_blanks(F.substring_index(t, "?", 1))
    )
    return F.when(F.lower(c).contains("tel:"), F.filter(found, lambda t: t != "")).otherwise(empty_strings())


def international_phones(text: Column | str) -> Column:
    c = col_of(text)
    hits = F.transform(_all_matches(c, fv.INTERNATIONAL_PHONE_PATTERN), strip_blanks)
    return F.when(c.contains("+"), hits).otherwise(empty_strings())


def whatsapp_links(html: Column | str) -> Column:
    links = F.array_sort(F.array_distinct(_all_matches(col_of(html), fv.WHATSAPP_PATTERN)))
    low = F.lower(col_of(html))
    return F.when(low.contains("wa.me/") | low.contains("whatsapp.com/send?"), links).otherwise(empty_strings())


def social_profiles(hrefs: Column | str) -> Column:
    """Company or personal profile links; share buttons and pixels are no profiles."""
    named = F.filter(col_of(hrefs), lambda h: h.rlike(r"(?i)facebook|instagram|linkedin|twitter|x\.com"))
    stripped = F.transform(named, strip_blanks)

    def is_profile(h: Column) -> Column:
        shapes = reduce(lambda x, y: x | y, [h.rlike(p) for p in fv.SOCIAL_PROFILE_PATTERNS])
        return ~h.rlike(fv.SHARE_LINK_PATTERN) & shapes

    return F.array_sort(F.array_distinct(F.filter(stripped, is_profile)))


def block_vendor(html: Column | str, signatures=fv.BLOCK_SIGNATURES) -> Column:
    """Name of the vendor whose challenge page this is, else ''. Labelling only."""

    def first_vendor(lowered: Column) -> Column:
        chain = None
        for vendor, rules in signatures:
            any_rule = reduce(
                lambda x, y: x | y,
                [reduce(lambda x, y: x & y, [lowered.contains(m) for m in rule]) for rule in rules],
            )
            chain = F.when(any_rule, vendor) if chain is None else chain.when(any_rule, vendor)
        return chain.otherwise("")

    # bound as a lambda variable, the page is lower-cased once and not once per marker
    return F.get(F.transform(F.array(F.lower(col_of(html))), first_vendor), F.lit(0))


def has_contact_form(forms: Column | str) -> Column:
    return F.exists(
        col_of(forms),
        lambda f: f["marker"].rlike(fv.FORM_MARKER_PATTERN) | (f["has_email"] & f["has_textarea"]),
    )
