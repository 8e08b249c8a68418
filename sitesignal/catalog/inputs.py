"""Inputs the registered queries derive from the given tables.

The given pages carry few contact signals, so each page gets one more snippet
of markup chosen by its number, and hosts move from the blocked ``.example.``
names to ``.sample.``. The snippets are written in SQL that Spark and the
checking engine both accept. All rows of every table are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOST_SQL = "replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '.example.', '.sample.')"
TAIL_SQL = "regexp_extract(url, '^https?://[^/?#]*(.*)$', 1)"
STATUS_SQL = "CASE WHEN page_id % 12 = 9 THEN 403 WHEN page_id % 17 = 16 THEN 500 ELSE 200 END"

SNIPPET_SQL = """CASE page_id % 12
  WHEN 0 THEN '<p>Write to <a href="mailto:Info@' || host || '?subject=hi">us</a></p>'
  WHEN 1 THEN '<p>sales@' || host || ' or partner.' || (page_id % 5) || '@helpers.io</p>'
  WHEN 2 THEN '<meta name="Description" content=" About ' || host || ' "><p>john.smith@' || host || '</p>'
  WHEN 3 THEN '<p>support [at] ' || replace(host, '.sample.', '.sample [dot] ') || ' , please</p>'
  WHEN 4 THEN '<a href="tel:+4420' || page_id || '?x">call</a><p>Phone: +1 (555) 010-' || (1000 + page_id % 9000) || ' now</p>'
  WHEN 5 THEN '<a href="https://wa.me/4475' || page_id || '">w</a><a href=" https://www.instagram.com/shop' || (page_id % 7)
           || '/ ">i</a><a href="https://www.facebook.com/sharer.php?u=x">s</a><a href="https://twitter.com/shop' || (page_id % 3) || '">t</a>'
  WHEN 6 THEN '<form id="contact-form"><input name="q"></form>'
  WHEN 7 THEN '<form action="/go"><input type="email" name="e"><textarea name="m"></textarea></form><meta property="og:title" content="Shop">'
  WHEN 8 THEN '<script type="application/ld+json">{"org": {"email": ["press@' || host || '"], "n": 1}}</script>'
  WHEN 9 THEN '<h1>Access Denied</h1><p>Reference #' || page_id || '</p>'
  WHEN 10 THEN '<a href="#" data-cfemail="00' || hex('hidden.' || (page_id % 4) || '@' || host) || '">protected</a>'
  ELSE '<!-- xq' || (page_id % 3) || 'z@' || host || ' --><form><input type="email"></form>'
END"""

# contact-like paths, one per page
CONTACT_PATH_SQL = """CASE page_id % 14
  WHEN 0 THEN '/contact'
  WHEN 1 THEN '/about-us'
  WHEN 2 THEN '/about/team'
  WHEN 3 THEN '/blog/how-to-contact-support'
  WHEN 4 THEN '/2024/06/contact-form-tips'
  WHEN 5 THEN '/es-es/help/connect-a-custom-domain-' || page_id
  WHEN 6 THEN '/company/global/contact-us'
  WHEN 7 THEN '/contact.html'
  WHEN 8 THEN '/Kontakt/?p=' || page_id
  WHEN 9 THEN '/about-us/contact-support-team'
  WHEN 10 THEN '/help-' || (page_id % 4) || '/faq'
  WHEN 11 THEN '/sobre-nosotros;v=' || page_id
  WHEN 12 THEN '/privacy-policy/contact'
  ELSE '/' || (page_id % 9) || '/support'
END"""

ROBOTS_SQL = """CASE length(host) % 3
  WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /de/' || chr(10) || 'Allow: /de/1' || chr(10) || 'Crawl-delay: 7' || chr(10)
  WHEN 1 THEN 'User-agent: other' || chr(10) || 'Disallow: /' || chr(10) || chr(10) || 'User-agent: *' || chr(10)
           || 'Allow: /fr/1' || chr(10) || 'Disallow: /fr/ # closed' || chr(10) || 'Disallow: /en/2' || chr(10)
           || 'Sitemap: https://' || host || '/maps/a.xml' || chr(10)
  ELSE 'sitemap: https://' || host || '/sitemap.xml' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow:' || chr(10)
       || 'Crawl-delay: 0.5' || chr(10) || 'Sitemap:  https://' || host || '/b.xml ' || chr(10)
END"""

# every page stands for one sitemap file: an index of the next two, or a list of three pages
SITEMAP_SQL = """CASE WHEN page_id % 3 = 0 THEN
  '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc> https://maps.sample.net/' || (page_id + 1)
  || '.xml </loc></sitemap><sitemap><loc>https://maps.sample.net/' || (page_id + 2)
  || '.xml</loc></sitemap><sitemap><loc>https://maps.sample.net/' || (page_id + 3) || '.xml</loc></sitemap></sitemapindex>'
WHEN page_id % 11 = 10 THEN '<urlset><url><loc>broken'
ELSE '<urlset><url><lastmod>2024</lastmod><loc>https://' || host || '/contact</loc></url><url><loc></loc></url><url><loc>https://'
  || host || '/p/' || page_id || '</loc></url><url><loc>https://' || host || '/about-us?n=' || (page_id % 2) || '</loc></url></urlset>'
END"""

# the given times carry no zone; they are read as UTC whatever the session's zone is
INSTANT_SQL = "timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))"

LOG_SQL = {
    "status": "CASE WHEN value < 5 THEN NULL WHEN value < 12 THEN 503 WHEN value < 16 THEN 429 WHEN value < 19 THEN 404 ELSE 200 END",
    "retry_after": """CASE WHEN value >= 11 AND value < 12 THEN '3'
                      WHEN value >= 12 AND value < 14 THEN ' ' || (event_id % 30) || ' '
                      WHEN value >= 14 AND value < 15 THEN 'Wed, 03 Jan 2024 10:00:00 GMT'
                      WHEN value >= 15 AND value < 16 THEN 'soon' END""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of its files, be it one file or a folder of them.

    A pattern for the name lets Spark take either; a plain path to a stream has to be a folder.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def site_pages(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, site, url, status, html)``; ``pages`` may be a stream of the table."""
    pages = table(spark, sf_dir, "pages") if pages is None else pages
    hosted = pages.select(
        "page_id", "html", F.expr(HOST_SQL).alias("host"), F.expr(TAIL_SQL).alias("tail"), F.expr(STATUS_SQL).alias("status"))
    return hosted.select(
        "page_id", "host", F.expr("'https://' || host").alias("site"), F.expr("'https://' || host || tail").alias("url"),
        "status", F.expr(f"html || {SNIPPET_SQL}").alias("html"))


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows without page bodies: only ``page_id`` and ``url`` are read."""
    pages = table(spark, sf_dir, "pages")
    hosted = pages.select(
        "page_id", F.expr(HOST_SQL).alias("host"), F.expr(TAIL_SQL).alias("tail"), F.expr(STATUS_SQL).alias("status"))
    return hosted.select(
        "page_id", "host", F.expr("'https://' || host").alias("site"), F.expr("'https://' || host || tail").alias("url"), "status")


def contact_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(site, url, ord)`` with one contact-like URL per page."""
    return page_hosts(spark, sf_dir).select(
        "site", F.expr(f"site || {CONTACT_PATH_SQL}").alias("url"), F.col("page_id").alias("ord"))


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One body per host, but for hosts whose name length is a multiple of five."""
    hosts = page_hosts(spark, sf_dir).select("host").distinct().filter("length(host) % 5 <> 0")
    return hosts.select("host", F.expr(ROBOTS_SQL).alias("body"))


def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(url, body)``: one file per page, and per site an index naming two of them."""
    pages = page_hosts(spark, sf_dir)
    leaves = pages.select(
        F.expr("'https://maps.sample.net/' || page_id || '.xml'").alias("url"), F.expr(SITEMAP_SQL).cast("binary").alias("body"))
    roots = pages.groupBy("site").agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).select(
        F.expr("site || '/sitemap.xml'").alias("url"),
        F.expr("""'<sitemapindex><sitemap><loc>https://maps.sample.net/' || lo || '.xml</loc></sitemap><sitemap><loc>https://maps.sample.net/'
                  || hi || '.xml</loc></sitemap></sitemapindex>'""").cast("binary").alias("body"))
    return leaves.unionByName(roots)


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: three in a row share a URL and count its attempts."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.expr("'https://d' || (floor(event_id / 3) % 40) || '.sample.net/p/' || cast(floor(event_id / 3) AS bigint)").alias("url"),
        F.expr("'d' || (cast(floor(event_id / 3) AS bigint) % 40) || '.sample.net'").alias("domain"),
        F.expr("cast(event_id % 3 AS int)").alias("attempt"),
        F.expr(LOG_SQL["status"]).alias("status"),
        F.expr(LOG_SQL["retry_after"]).alias("retry_after"),
        F.expr(INSTANT_SQL).alias("requested_at"),
        "event_id",
    )
