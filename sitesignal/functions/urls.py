"""URL and path expressions (all native)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitesignal import fixed_values as fv


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_blanks(c: Column | str) -> Column:
    """Trim every Unicode blank, not only spaces."""
    return F.regexp_replace(col_of(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def word_array(words) -> Column:
    """Constant array; parsed in one call, since a call per word would slow plan building."""
    quoted = ("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return F.expr(f"cast(array({', '.join(quoted)}) as array<string>)")


def netloc(url: Column | str) -> Column:
    """Authority of an absolute URL: port and userinfo kept, '' when there is none."""
    return F.regexp_extract(col_of(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)


def base_url(raw: Column | str) -> Column:
    """Target string to ``https://`` + authority; an empty target stays empty."""
    text = F.regexp_replace(strip_blanks(raw), r"[\t\r\n]", "")
    authority = F.regexp_extract(text, r"^(?:(?i:https?)://)?([^/?#]*)", 1)
    # an unbalanced bracket is no host; the row ends as unparseable
    sane = authority.contains("[") == authority.contains("]")
    return F.when(text == "", text).otherwise(
        F.concat(F.lit("https://"), F.when(sane, authority).otherwise(F.lit("")))
    )


def bare_domain(base: Column | str) -> Column:
    return F.regexp_replace(netloc(base), r"^www\.", "")


def site_of(url: Column | str) -> Column:
    """Base URL of the site a page URL belongs to."""
    return F.concat(F.lit("https://"), netloc(url))


def brand_label(domain: Column | str) -> Column:
    return F.lower(F.substring_index(col_of(domain), ".", 1))


def url_path(url: Column | str) -> Column:
    """Path without parameters of the last segment, query and fragment."""
    clean = col_of(url)
    for blank in ("\t", "\r", "\n"):
        clean = F.replace(clean, F.lit(blank), F.lit(""))
    return F.regexp_extract(
        clean, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?((?:[^?#]*/)?[^/?#;]*)", 1)


def path_segments(path: Column | str) -> Column:
    return F.array_remove(F.split(col_of(path), "/"), "")


def path_tokens(segments: Column | str) -> Column:
    """Segments and their hyphen-separated parts, each once.

    Splitting the re-joined segments gives all parts in one call, which keeps
    the expression inside generated code (a lambda would not be).
    """
    segs = col_of(segments)
    parts = F.split(F.array_join(segs, "/"), "[/-]")
    return F.when(F.size(segs) == 0, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(segs, parts))
    )


def capture_key(url: Column | str) -> Column:
    """Join key of a captured URL: no fragment, and the bare root slash dropped."""
    return F.regexp_replace(
        F.regexp_replace(col_of(url), r"#.*$", ""), r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)/$", "$1"
    )


def percent_decode(c: Column | str) -> Column:
    """Percent-decoding that leaves '+' and malformed escapes alone."""
    safe = F.regexp_replace(col_of(c), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(col_of(c).contains("%"), F.try_url_decode(F.replace(safe, F.lit("+"), F.lit("%2B")))).otherwise(
        col_of(c)
    )


def percent_encode(c: Column | str) -> Column:
    """Percent-encoding of everything but unreserved characters and '/'."""
    out = F.url_encode(col_of(c))
    for got, want in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(got), F.lit(want))
    return F.when(col_of(c).rlike(r"^[A-Za-z0-9_.~/\-]*$"), col_of(c)).otherwise(out)


def robots_path(url: Column | str) -> Column:
    """The part of a URL that robots rules are matched against."""
    rest = F.regexp_replace(percent_decode(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?", "")
    rest = F.regexp_replace(rest, r"#$", "")
    rest = F.regexp_replace(rest, r"^([^?#]*)\?(?=#|$)", "$1")
    quoted = percent_encode(rest)
    return F.when(quoted == "", F.lit("/")).otherwise(quoted)


def score_expr(
    segments: Column,
    tokens: Column,
    path: Column,
    keywords=fv.CONTACT_KEYWORDS,
    hard=fv.HARD_CONTACT_KEYWORDS,
    primary=fv.PRIMARY_CONTACT_KEYWORDS,
    negative=fv.NEGATIVE_PATH_WORDS,
) -> Column:
    """Contact score of a lower-cased path, null when the URL is no candidate."""
    depth = F.size(segments)
    matched = F.size(F.array_intersect(tokens, word_array(keywords)))
    is_hard = F.arrays_overlap(segments, word_array(hard))
    bonus = F.greatest(F.lit(0), F.lit(3) - depth).cast("double") * 0.5
    primary_bonus = F.when(F.arrays_overlap(segments, word_array(primary)), 10.0).otherwise(0.0)
    rejected = is_rejected_path(tokens, path, negative)
    return (
        F.when(rejected | (matched == 0), F.lit(None).cast("double"))
        .when(is_hard, F.lit(100.0) + primary_bonus + bonus)
        .when(depth > fv.MAX_SOFT_MATCH_SEGMENTS, F.lit(None).cast("double"))
        .otherwise(matched.cast("double") + bonus)
    )


def is_rejected_path(tokens: Column, path: Column, negative=fv.NEGATIVE_PATH_WORDS) -> Column:
    """Content, policy and dated pages."""
    return F.arrays_overlap(tokens, word_array(negative)) | path.rlike(fv.DATED_PATH_PATTERN)
