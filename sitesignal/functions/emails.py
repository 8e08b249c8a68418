"""Address expressions: extraction, decoding, validity, ownership, role, rank."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitesignal import fixed_values as fv
from sitesignal.functions.urls import brand_label, col_of, strip_blanks, word_array

NO_STRINGS = "array<string>"


def empty_strings() -> Column:
    return F.expr(f"cast(array() as {NO_STRINGS})")


def _all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def plain_emails(text: Column | str) -> Column:
    """Addresses written out in a text, as found; only texts with an '@' are scanned."""
    c = col_of(text)
    return F.when(c.contains("@"), _all_matches(c, fv.EMAIL_PATTERN)).otherwise(empty_strings())


_BLANK_OR_OPEN = r"(?:\s+|\s*[\[\(]\s*)"
_BLANK_OR_CLOSE = r"(?:\s+|\s*[\]\)]\s*)"
STRICT_OBFUSCATED_PATTERN = (
    r"(?U)([a-zA-Z0-9._%+\-]{1,64})" + _BLANK_OR_OPEN + r"(?:at|AT|@)" + _BLANK_OR_CLOSE
    + r"([a-zA-Z0-9.\-]{1,253})" + _BLANK_OR_OPEN + r"(?:dot|DOT)" + _BLANK_OR_CLOSE
    + r"([a-zA-Z]{2,24})"
    + r"(?:" + _BLANK_OR_OPEN + r"(?:dot|DOT)" + _BLANK_OR_CLOSE + r"([a-zA-Z]{2,24}))?"
)


_OUTSIDE_OBFUSCATED = r"(?U)[^a-zA-Z0-9._%+\-\s\[\]()@]+"


def obfuscated_emails(text: Column | str, strict: bool = False) -> Column:
    """Spelled-out addresses, rebuilt and lower-cased.

    ``strict`` asks for a bracket or blank on both sides of "at" and "dot"; the
    default does not, and therefore also rebuilds some ordinary words.
    """
    c = col_of(text)
    pattern = STRICT_OBFUSCATED_PATTERN if strict else fv.OBFUSCATED_EMAIL_PATTERN

    def rebuild(hit: Column) -> Column:
        local, host, tld, tld2 = (F.regexp_extract(hit, pattern, i) for i in (1, 2, 3, 4))
        ending = F.when(tld2 != "", F.concat(tld, F.lit("."), tld2)).otherwise(tld)
        return F.lower(F.concat(local, F.lit("@"), host, F.lit("."), ending))

    # "dot" is required, so texts without it skip the costly pattern. No match
    # crosses a character outside its alphabet, so only the stretches between
    # such characters that hold a "dot" are searched.
    has_dot = lambda t: t.contains("dot") | t.contains("DOT")
    stretches = F.filter(F.split(c, _OUTSIDE_OBFUSCATED), has_dot)
    hits = F.flatten(F.transform(stretches, lambda t: _all_matches(t, pattern)))
    return F.when(has_dot(c), F.transform(hits, rebuild)).otherwise(empty_strings())


def decode_protected(hex_text: Column | str) -> Column:
    """XOR-protected address: the first byte is the key; null when it cannot be decoded."""
    h = col_of(hex_text)
    size = F.length(h)

    def byte_at(i: Column) -> Column:
        return F.conv(F.substr(h, i * 2 - 1, F.lit(2)), 16, 10).cast("int")

    key = byte_at(F.lit(1))
    plain = F.transform(
        F.sequence(F.lit(2), (size / 2).cast("int")),
        lambda i: F.lpad(F.hex(byte_at(i).bitwiseXOR(key).cast("bigint")), 2, "0"),
    )
    usable = h.rlike(r"^[0-9a-fA-F]+$") & (size % 2 == 0) & (size >= 4)
    return F.when(usable, F.try_validate_utf8(F.unhex(F.array_join(plain, "")).cast("string")))


def protected_emails(html: Column | str) -> Column:
    """Protected addresses anywhere in the raw page, scripts included."""
    c = col_of(html)
    hits = F.concat(
        _all_matches(c, fv.PROTECTED_ATTRIBUTE_PATTERN, 1), _all_matches(c, fv.PROTECTED_LINK_PATTERN, 1)
    )
    decoded = F.filter(F.transform(hits, decode_protected), lambda e: e.isNotNull() & (e != ""))
    marked = c.contains("data-cfemail") | c.contains("/cdn-cgi/l/email-protection#")
    return F.when(marked, decoded).otherwise(empty_strings())


def mailto_addresses(hrefs: Column | str) -> Column:
    """Addresses of mailto links, lower-cased; query cut, no percent-decoding."""
    links = F.filter(col_of(hrefs), lambda h: F.lower(h).startswith("mailto:"))
    found = F.transform(
        links, lambda h: F.lower(strip_blanks(F.substring_index(F.substr(h, F.lit(8)), "?", 1)))
    )
    return F.filter(found, lambda e: e != "")


def _bad_domain_pattern(blocked_domains) -> str:
    names = "|".join(re.escape(d) for d in blocked_domains)
    rules = [
        r"[\s?=&#/%]",
        r"^example(?:\.|$)",
        r"\.(?:" + "|".join(fv.ASSET_SUFFIXES) + r")$",
    ]
    if names:
        rules.append(r"(?:^|\.)(?:" + names + r")$")
    return "(?U)" + "|".join(rules)


def is_valid_email(
    email: Column | str, blocked_domains=fv.BLOCKED_DOMAINS, blocked_locals=fv.BLOCKED_LOCAL_PARTS
) -> Column:
    """False for placeholders, assets, escapes and addresses under a blocked domain.

    The domain list is folded into one pattern, so it should be a list of
    modest size; use ``operators.attribution.drop_blocked_domains`` for a table.
    """
    trimmed = F.regexp_replace(strip_blanks(email), r"^[.,;:]+|[.,;:]+$", "")
    local = F.regexp_extract(trimmed, r"(?s)^([^@]*)@(.*)$", 1)
    domain = F.lower(F.regexp_extract(trimmed, r"(?s)^([^@]*)@(.*)$", 2))
    return (
        (local != "")
        & (domain != "")
        & ~trimmed.rlike(fv.RETINA_SUFFIX_PATTERN)
        & ~domain.rlike(_bad_domain_pattern(blocked_domains))
        & ~F.array_contains(word_array(blocked_locals), F.lower(local))
        & ~local.rlike(fv.ESCAPED_LOCAL_PART_PATTERN)
    )


def valid_distinct(
    emails: Column | str, blocked_domains=fv.BLOCKED_DOMAINS, blocked_locals=fv.BLOCKED_LOCAL_PARTS
) -> Column:
    """Lower-cased, deduplicated, sorted valid addresses of an array."""
    lowered = F.array_distinct(F.transform(col_of(emails), F.lower))
    return F.array_sort(
        F.filter(lowered, lambda e: is_valid_email(e, blocked_domains, blocked_locals))
    )


def email_domain(email: Column | str) -> Column:
    return F.lower(F.substring_index(col_of(email), "@", -1))


def mx_domain(email: Column | str) -> Column:
    """Everything after the first '@'."""
    return F.regexp_extract(col_of(email), r"(?s)^[^@]*@(.*)$", 1)


def belongs_to(email: Column | str, domain: Column | str) -> Column:
    """True when an address is the site's own: same domain, subdomain or same brand label."""
    have, want = email_domain(email), F.lower(col_of(domain))
    a, b = brand_label(have), brand_label(want)
    # equal lengths keep the address label first, which matters for no rule below
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long_ = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n, m = F.length(short), F.length(long_)
    tail = F.substr(long_, n + 1)
    contained = (n >= 5) & (m <= n * 2.5) & long_.contains(short)
    suffixed = (
        (n >= 4) & long_.startswith(short) & (tail != "") & ~tail.contains("-") & (F.length(tail) <= 15)
    )
    return (have == want) | have.endswith(F.concat(F.lit("."), want)) | contained | suffixed


def email_role(email: Column | str) -> Column:
    """Function of an address, from its local part."""
    local = F.lower(F.substring_index(col_of(email), "@", 1))
    words = F.concat(F.split(local, r"[._\-+]"), F.array(local))
    parts = F.array_remove(F.split(local, r"[._\-]"), "")
    role = None
    for name, keywords in fv.ROLE_KEYWORDS:
        hit = F.arrays_overlap(words, word_array(keywords))
        role = F.when(hit, name) if role is None else role.when(hit, name)
    full_name = (F.size(parts) >= 2) & (
        F.concat_ws(" ", F.slice(parts, 1, 2)).rlike(r"^\p{L}{2,} \p{L}{2,}\z")
    )
    single = F.element_at(parts, 1)
    first_name = (
        (F.size(parts) == 1) & single.rlike(r"^\p{L}{2,20}\z") & ~F.array_contains(word_array(fv.SYSTEM_LOCAL_PARTS), single)
    )
    return role.when(full_name, "personal").when(first_name, "personal").otherwise("other")


def role_priority(role: Column | str) -> Column:
    return (F.array_position(word_array(fv.ROLE_ORDER), col_of(role)) - 1).cast("int")


def ranked(emails: Column | str, mailto: Column | str) -> Column:
    """Array of ``(priority, not_mailto, email, role)``, best contact first."""

    def entry(e: Column) -> Column:
        role = email_role(e)
        return F.struct(
            role_priority(role).alias("priority"),
            (~F.array_contains(col_of(mailto), e)).alias("not_mailto"),
            e.alias("email"),
            role.alias("role"),
        )

    return F.array_sort(F.transform(col_of(emails), entry))


def own_emails(emails: Column | str, domain: Column | str) -> Column:
    return F.filter(col_of(emails), lambda e: belongs_to(e, domain))


def other_emails(emails: Column | str, domain: Column | str) -> Column:
    return F.filter(col_of(emails), lambda e: ~belongs_to(e, domain))
