"""Small Arrow UDFs around standard-library parsers: sitemap XML, link joins."""

from __future__ import annotations

import gzip
import zlib
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sitesignal.functions.urls import col_of

_SITEMAP_TYPE = pa.struct([("children", pa.list_(pa.string())), ("pages", pa.list_(pa.string()))])


def sitemap_fields(body: bytes) -> dict:
    """Child sitemaps of an index, or page URLs of a URL set; both empty when unreadable."""
    children, pages = [], []
    try:
        root = ElementTree.fromstring(body)
    except (ElementTree.ParseError, ValueError, LookupError):
        return {"children": children, "pages": pages}
    target = children if root.tag.lower().endswith("sitemapindex") else pages
    for entry in root:
        first = next((c for c in entry if c.tag.lower().endswith("loc")), None)
        loc = (first.text or "").strip() if first is not None else ""
        if loc:
            target.append(loc)
    return {"children": children, "pages": pages}


def gunzip(body: bytes) -> bytes:
    if body[:2] == b"\x1f\x8b":
        try:
            return gzip.decompress(body)
        except (OSError, EOFError, zlib.error):
            return body
    return body


def _join(base: str, href: str):
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def parse_sitemap(body: Column | str) -> Column:
    @F.arrow_udf("struct<children:array<string>,pages:array<string>>")
    def sitemap_of(bodies: pa.Array) -> pa.Array:
        rows = [None if b is None else sitemap_fields(gunzip(b)) for b in bodies.to_pylist()]
        return pa.array(rows, type=_SITEMAP_TYPE)

    return sitemap_of.asNondeterministic()(col_of(body))


def resolve_links(base: Column | str, hrefs: Column | str) -> Column:
    """Absolute form of an array of links; a link that cannot be joined is dropped."""

    @F.arrow_udf("array<string>")
    def resolve(bases: pa.Array, links: pa.Array) -> pa.Array:
        rows = []
        for b, hs in zip(bases.to_pylist(), links.to_pylist()):
            if b is None or hs is None:
                rows.append(None)
                continue
            joined = (_join(b, h) for h in hs)
            rows.append([j for j in joined if j is not None])
        return pa.array(rows, type=pa.list_(pa.string()))

    return resolve.asNondeterministic()(col_of(base), col_of(hrefs))
