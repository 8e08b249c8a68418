"""One query per operator, each over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesignal import fixed_values as fv
from sitesignal.catalog import inputs as I
from sitesignal.functions import emails as E
from sitesignal.functions import signals as S
from sitesignal.functions.page_scan import scan
from sitesignal.functions.urls import bare_domain, base_url, brand_label, netloc, path_segments, path_tokens, url_path
from sitesignal.operators import addresses as L
from sitesignal.operators import attribution as A
from sitesignal.operators import candidates as C
from sitesignal.operators import fetchlog as H
from sitesignal.operators import robots as R
from sitesignal.operators import rollup as G
from sitesignal.operators import sitemaps as M
from sitesignal.operators import skew
from sitesignal.operators.extraction import hrefs, page_signals
from sitesignal.plans.analyze import analyze, apply_rendered_pass
from sitesignal.session import page_batches, spread, stage, stage_dir
from sitesignal.sources.sinks import job_key, write_results_csv
from sitesignal.sources.tables import decoded_captures, last_summaries, read_completed, read_target_list, targets_of_lines, usable_text
from sitesignal.streaming import state_tables as T
from sitesignal.streaming.streams import (
    GIVE_UP_OUTPUT, compact_upserts, hit_rate_windows, read_upserted, rocksdb_state, run_until_idle, stream_extract, stream_give_up_by_clock,
    stream_retry_queue, stream_upsert_results,
)

# the given addresses all sit under example.*, so queries about them allow those names
OPEN_DOMAINS = [d for d in fv.BLOCKED_DOMAINS if not d.startswith("example.")]

NO_RULES = "array<struct<allow:boolean,path:string>>"


def listed(c: str | Column, sep: str = " ") -> Column:
    return F.array_join(F.array_sort(c), sep)


def flag(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("int")


# ---- urls -------------------------------------------------------------------------


def normalize_hosts(spark: SparkSession, d: str) -> DataFrame:
    raw = """CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '  ' || regexp_extract(url, '^https?://(.*)$', 1)
             WHEN 2 THEN 'HTTP://user@' || regexp_extract(url, '^https?://([^/]*)', 1) || ':8080/x'
             WHEN 3 THEN 'www.' || regexp_extract(url, '^https?://([^/]*)', 1) ELSE '/no/host' END"""
    return I.table(spark, d, "pages").select("page_id", F.expr(raw).alias("input_url")).select(
        "page_id", base_url("input_url").alias("base_url"), bare_domain(base_url("input_url")).alias("domain"),
        brand_label(bare_domain(base_url("input_url"))).alias("brand"))


def unparseable_targets(spark: SparkSession, d: str) -> DataFrame:
    raw = "CASE WHEN page_id % 4 = 0 THEN '/p/' || page_id WHEN page_id % 4 = 1 THEN '' ELSE url END"
    targets = I.table(spark, d, "pages").select(F.expr(raw).alias("input_url")).distinct()
    return targets.filter(bare_domain(base_url("input_url")) == "").select(
        "input_url", F.lit(fv.ERROR_UNPARSEABLE).alias("error"))


def url_tokens(spark: SparkSession, d: str) -> DataFrame:
    path = F.lower(url_path("url"))
    return I.contact_urls(spark, d).select(
        F.col("ord").alias("page_id"), path.alias("path"), F.size(path_segments(path)).cast("bigint").alias("segments"),
        listed(path_tokens(path_segments(path))).alias("tokens"))


# ---- candidates ----------------------------------------------------------------------


def rank_contact_urls(spark: SparkSession, d: str) -> DataFrame:
    return C.score_contact_urls(I.contact_urls(spark, d)).select(F.col("ord").alias("page_id"), "url", "score")


def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    top = C.top_candidates(C.score_contact_urls(I.contact_urls(spark, d)), ["site"], k=3)
    return top.select("site", "url", F.col("rank").cast("bigint").alias("rank"), "score")


def early_stop_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = skew.top_k(I.page_hosts(spark, d), ["site"], [F.col("page_id")], fv.MAX_PAGES_PER_SITE)
    kept = C.early_stop(pages.withColumn("has_email", F.col("page_id") % 5 == 0), ["site"], wave_size=2, min_pages=3)
    return kept.select("site", "page_id", F.col("wave").cast("bigint").alias("wave"))


def reachable_sites(spark: SparkSession, d: str) -> DataFrame:
    pages = I.page_hosts(spark, d)
    probe = pages.select("site", F.when(F.col("page_id") % 3 == 0, F.col("status")).alias("status"))
    return C.reachable_gate(pages.select("site").distinct(), probe).select("site", flag("reachable").alias("reachable"))


def _linked_pages(spark: SparkSession, d: str) -> DataFrame:
    nav = """replace(html, '<footer>', '<footer><a href="/kontakt/' || page_id || '">k</a><a href="/imprint">Reach us or <b>con</b>tact</a><a href="https://'
             || host || '/team?x=' || page_id || '">team</a><a href="/a/b/c">deep</a><a href="/blog/x">b</a>')"""
    return I.site_pages(spark, d).select("page_id", "site", F.expr(nav).alias("html"))


def footer_links(spark: SparkSession, d: str) -> DataFrame:
    scanned = spread(_linked_pages(spark, d)).select("page_id", "site", scan("html").alias("page"))
    links = scanned.select("page_id", F.posexplode(C.footer_links(F.col("site"), F.col("page"))).alias("ord", "url"))
    return links.select("page_id", F.col("ord").cast("bigint").alias("ord"), "url")


def second_hop_links(spark: SparkSession, d: str) -> DataFrame:
    scanned = spread(_linked_pages(spark, d)).select("page_id", "site", scan("html").alias("page"))
    linked = scanned.select("page_id", "site", C.all_links(F.col("site"), F.col("page")).alias("links"))
    tried = F.array(F.concat("site", F.lit("/imprint")))
    hops = linked.select("page_id", F.posexplode(C.second_hop_links(F.col("site"), F.col("links"), tried, 4)).alias("ord", "url"))
    return hops.select("page_id", F.col("ord").cast("bigint").alias("ord"), "url")


# ---- robots and sitemaps ------------------------------------------------------------------


def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = R.robots_rules(I.robots(spark, d))
    return rules.select("host", F.col("rule_ord").cast("bigint").alias("rule_ord"), flag("allow").alias("allow"), "path")


def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    marked = R.with_allowed(I.page_hosts(spark, d), R.robots_policy(I.robots(spark, d)))
    return marked.select("page_id", "url", flag("allowed").alias("allowed"))


def crawl_delay(spark: SparkSession, d: str) -> DataFrame:
    return R.crawl_delay(I.robots(spark, d))


def min_intervals(spark: SparkSession, d: str) -> DataFrame:
    return R.min_interval(R.robots_policy(I.robots(spark, d)))


def declared_sitemaps(spark: SparkSession, d: str) -> DataFrame:
    found = R.declared_sitemaps(I.robots(spark, d))
    return found.select("host", F.col("ord").cast("bigint").alias("ord"), "sitemap_url")


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    declared = R.declared_sitemaps(I.robots(spark, d)).select(
        F.concat(F.lit("https://"), "host").alias("site"), "ord", "sitemap_url")
    return M.sitemap_candidates(I.page_hosts(spark, d).select("site").distinct(), declared)


def sitemap_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _seeds(spark, d).select("site", "sitemap_url", "ord")


def sitemap_parse(spark: SparkSession, d: str) -> DataFrame:
    parsed = M.parsed_sitemaps(I.sitemap_files(spark, d))
    both = parsed.select(
        "url", F.explode(F.concat(
            F.transform("children", lambda x, i: F.struct(F.lit("sitemap").alias("kind"), i.alias("ord"), x.alias("loc"))),
            F.transform("pages", lambda x, i: F.struct(F.lit("page").alias("kind"), i.alias("ord"), x.alias("loc"))),
        )).alias("e"))
    return both.select("url", F.col("e.kind").alias("kind"), F.col("e.ord").cast("bigint").alias("ord"), F.col("e.loc").alias("loc"))


WALK_LIMITS = {"max_files": 12, "max_pages": 9}


def sitemap_walk(spark: SparkSession, d: str) -> DataFrame:
    parsed = stage(M.parsed_sitemaps(I.sitemap_files(spark, d)), "parsed")
    walked = M.walk_sitemaps(_seeds(spark, d), parsed, **WALK_LIMITS)
    return walked.select(
        "site", "url", F.expr(f"ord div {M.FILE_STRIDE}").alias("file_no"), F.expr(f"ord % {M.FILE_STRIDE}").alias("pos"))


def _leftovers(spark: SparkSession, d: str, **limits: int) -> DataFrame:
    parsed, seeds = stage(M.parsed_sitemaps(I.sitemap_files(spark, d)), "parsed"), _seeds(spark, d)
    return M.walk_leftovers(seeds, parsed, M.walk_files(seeds, parsed, **limits))


def sitemap_leftovers(spark: SparkSession, d: str) -> DataFrame:
    """What the default budgets and the depth leave out, by site."""
    return _leftovers(spark, d)


def sitemap_leftovers_tight(spark: SparkSession, d: str) -> DataFrame:
    return _leftovers(spark, d, **WALK_LIMITS)


def sitemap_pages(spark: SparkSession, d: str) -> DataFrame:
    parsed = stage(M.parsed_sitemaps(I.sitemap_files(spark, d)), "parsed")
    pages = M.dedupe_pages(M.walk_sitemaps(_seeds(spark, d), parsed))
    return pages.select("site", "url")


# ---- page signals ------------------------------------------------------------------------------


def usable_captures(spark: SparkSession, d: str) -> DataFrame:
    """Bodies arrive as bytes; every fifth one with a byte that is no UTF-8."""
    raw = I.site_pages(spark, d).select(
        "page_id", "url", "status", F.expr("CASE WHEN page_id % 5 = 0 THEN cast(html AS binary) || X'FF' ELSE cast(html AS binary) END").alias("body"))
    usable = usable_text(decoded_captures(raw))
    return usable.select("page_id", flag("usable").alias("usable"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    scanned = spread(I.table(spark, d, "pages")).select("page_id", scan("html").alias("page"))
    return scanned.select("page_id", F.md5("page.text").alias("text_md5"), F.length("page.text").cast("bigint").alias("n_chars"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    scanned = spread(I.table(spark, d, "pages")).select("page_id", scan("html").alias("page"))
    links = scanned.select("page_id", F.posexplode("page.anchors").alias("ord", "a"))
    return links.select("page_id", F.col("ord").cast("bigint").alias("ord"), F.col("a.href").alias("href"), flag("a.in_footer").alias("in_footer"))


def text_emails(spark: SparkSession, d: str) -> DataFrame:
    docs = I.table(spark, d, "documents")
    return docs.select("doc_id", F.explode(F.array_distinct(E.plain_emails("text"))).alias("email"))


def valid_emails(spark: SparkSession, d: str) -> DataFrame:
    mixed = F.expr("""CASE doc_id % 9 WHEN 0 THEN 'banner@3x.webp' WHEN 1 THEN 'noreply@shop.io' WHEN 2 THEN 'a' || doc_id || '@sub.acme.com'
        WHEN 3 THEN 'u00e9@talheim.net' WHEN 4 THEN 'kontor@example.shop' WHEN 5 THEN 'Sales.' || doc_id || '@shop.io' WHEN 6 THEN 'w@laden.net?cc=z'
        WHEN 7 THEN 'pack@3.1.r' || doc_id || '.wasm' ELSE 'not-an-address' END""")
    found = I.table(spark, d, "documents").select(
        "doc_id", F.explode(F.concat(E.plain_emails("text"), F.array(mixed))).alias("email"))
    return found.select("doc_id", "email", flag(E.is_valid_email("email", OPEN_DOMAINS)).alias("valid")).distinct()


def blocked_domain_rows(spark: SparkSession, d: str) -> DataFrame:
    """The blocked domains as a table: hosts of every third page."""
    docs = I.table(spark, d, "documents").select("doc_id", F.expr("source || '-' || (doc_id % 25) || '.sample.org'").alias("domain"))
    blocked = docs.filter("doc_id % 25 % 3 = 0").select("domain")
    docs = docs.select("doc_id", F.expr("'c' || doc_id || '@mail.' || domain").alias("email"))
    return A.drop_blocked_domains(docs, blocked)


def obfuscated_emails(spark: SparkSession, d: str) -> DataFrame:
    docs = I.table(spark, d, "documents")
    text = F.expr("text || CASE doc_id % 4 WHEN 0 THEN ' hello [at] shop' || doc_id || ' [dot] co [dot] uk' WHEN 1 THEN ' that anecdotes' "
                  "WHEN 2 THEN ' Sales AT Acme-' || doc_id || ' DOT com' ELSE ' jane [at] acme.com' END")
    return docs.select("doc_id", text.alias("text")).select(
        "doc_id", listed(F.array_distinct(E.obfuscated_emails("text"))).alias("loose"),
        listed(F.array_distinct(E.obfuscated_emails("text", strict=True))).alias("strict"))


def protected_emails(spark: SparkSession, d: str) -> DataFrame:
    return I.site_pages(spark, d).select("page_id", F.explode(E.protected_emails("html")).alias("email"))


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    return spread(I.site_pages(spark, d)).select("page_id", "host", "site", "html", scan("html").alias("page"))


def mailto_emails(spark: SparkSession, d: str) -> DataFrame:
    found = E.valid_distinct(E.mailto_addresses(hrefs(F.col("page"))))
    return _scanned(spark, d).select("page_id", F.explode(found).alias("email"))


def json_emails(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d).select("page_id", F.explode(F.array_distinct(E.plain_emails("page.json_hits"))).alias("email"))


def markup_emails(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d).select("page_id", F.explode(F.array_distinct(E.plain_emails("page.markup_hits"))).alias("email"))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return page_signals(spread(I.site_pages(spark, d)), keep=["page_id", "host", "site", "url"], blocked_domains=OPEN_DOMAINS)


def page_emails(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("page_id", F.explode("emails").alias("email"))


def phones(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("page_id", F.explode("phones").alias("phone"))


def document_phones(spark: SparkSession, d: str) -> DataFrame:
    docs = I.table(spark, d, "documents")
    return docs.select("doc_id", F.explode(F.array_distinct(S.international_phones("text"))).alias("phone"))


def whatsapp_links(spark: SparkSession, d: str) -> DataFrame:
    return I.site_pages(spark, d).select("page_id", F.explode(S.whatsapp_links("html")).alias("link"))


def social_links(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d).select("page_id", F.explode(S.social_profiles(hrefs(F.col("page")))).alias("link"))


def block_signatures(spark: SparkSession, d: str) -> DataFrame:
    marked = F.expr("""html || CASE page_id % 9 WHEN 0 THEN '<div class="cf-browser-verification">' WHEN 1 THEN '<div id="px-captcha">'
        WHEN 2 THEN 'Please verify you are a human' WHEN 3 THEN 'AkamaiGHost' ELSE '' END""")
    return I.site_pages(spark, d).select("page_id", S.block_vendor(marked).alias("blocked_by"))


def contact_forms(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d).select("page_id", flag(S.has_contact_form("page.forms")).alias("has_contact_form"))


def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    page = F.col("page")
    return _scanned(spark, d).select(
        "page_id", page["title"].alias("page_title"), page["description"].alias("meta_description"),
        page["og_title"].alias("og_title"), page["og_description"].alias("og_description"))


# ---- attribution ------------------------------------------------------------------------------------


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    """One address per document, over many roles and owners."""
    local = """CASE doc_id % 16 WHEN 0 THEN 'info' WHEN 1 THEN 'sales.team' WHEN 2 THEN 'help' WHEN 3 THEN 'press-office' WHEN 4 THEN 'hr'
        WHEN 5 THEN 'billing' WHEN 6 THEN 'dpo' WHEN 7 THEN 'jane.doe' WHEN 8 THEN 'do-not-reply' WHEN 9 THEN 'webmaster' WHEN 10 THEN 'xq7z'
        WHEN 11 THEN 'alex' WHEN 12 THEN 'josé' WHEN 13 THEN 'Support+eu' WHEN 14 THEN 'j.smith' ELSE 'unsubscribe' END"""
    owner = """CASE doc_id % 7 WHEN 0 THEN source || '.com' WHEN 1 THEN 'mail.' || source || '.com' WHEN 2 THEN 'make' || source || '.io'
        WHEN 3 THEN source || '-tutors.com' WHEN 4 THEN source || 'corp.net' WHEN 5 THEN 'partner.org' ELSE source || '.org' END"""
    return I.table(spark, d, "documents").select(
        "doc_id", F.expr("source || '.com'").alias("domain"), F.expr(f"{local} || '@' || {owner}").alias("email"))


def own_vs_other(spark: SparkSession, d: str) -> DataFrame:
    return _addresses(spark, d).select("doc_id", "email", "domain", flag(E.belongs_to("email", "domain")).alias("is_own"))


def email_roles(spark: SparkSession, d: str) -> DataFrame:
    role = E.email_role("email")
    return _addresses(spark, d).select("doc_id", "email", role.alias("role"), E.role_priority(role).alias("priority"))


def _site_results(spark: SparkSession, d: str) -> DataFrame:
    """Result rows of every site over all of its pages, in page order."""
    pages = _signals(spark, d).withColumn("rank", F.col("page_id"))
    sites = G.rollup_site(pages, ["site", "host"])
    failed, error = G.empty_status(F.col("emails"), F.col("pages_ok"), F.col("pages_failed"))
    return sites.select(
        F.col("site").alias("input_url"), F.col("host").alias("domain"), "emails", "mailto_emails", "phones", "whatsapp_links",
        "social_links", "source_pages", "pages_ok", "pages_failed", "blocked_by", "has_contact_form", *G.METADATA,
        F.expr(METHOD_SQL).alias("method"),
        failed.alias("fetch_failed"), error.alias("error"))


METHOD_SQL = "CASE WHEN length(host) % 7 = 0 THEN 'none' WHEN length(host) % 7 = 1 THEN '' ELSE 'sitemap' END"


def _long_form(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Addresses and facts of every site, from signals that are scanned once."""
    with page_batches(spark):
        pages = stage(_signals(spark, d).withColumn("rank", F.col("page_id")), "signals")
    addresses = L.site_addresses(pages, ["site", "host"], "host")
    facts = L.site_facts(pages, addresses, ["site", "host"]).withColumn("method", F.expr(METHOD_SQL))
    return addresses, facts.withColumnRenamed("site", "input_url")


def address_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every address of a site with the first page that shows it."""
    return _long_form(spark, d)[0].select(
        F.col("site").alias("input_url"), "email", "role", flag("is_own").alias("is_own"), flag("from_mailto").alias("from_mailto"),
        "source_page", "n_pages")


def site_facts(spark: SparkSession, d: str) -> DataFrame:
    return _long_form(spark, d)[1].select(
        "input_url", "n_emails", "n_own", "pages_ok", "pages_failed", "blocked_by", flag("has_contact_form").alias("has_contact_form"),
        F.coalesce("best.email", F.lit("")).alias("primary_email"), L.fact_category(F.col("method")).alias("category"),
        flag(L.fact_low_quality()).alias("low_quality"))


def ranked_emails(spark: SparkSession, d: str) -> DataFrame:
    both = A.ranked_emails(_site_results(spark, d))
    names = lambda c: F.array_join(F.transform(c, lambda e: e["email"]), " ")
    return both.select("input_url", names("ranked_own").alias("own"), names("ranked_other").alias("other"))


def primary_email(spark: SparkSession, d: str) -> DataFrame:
    return _long_form(spark, d)[1].select(
        "input_url", F.coalesce("best.email", F.lit("")).alias("primary_email"), F.coalesce("best.role", F.lit("")).alias("primary_role"))


def mx_filtered(spark: SparkSession, d: str) -> DataFrame:
    hosts = I.page_hosts(spark, d).select("host").distinct()
    known = hosts.select(
        F.col("host").alias("domain"),
        F.expr("CASE length(host) % 3 WHEN 0 THEN false WHEN 1 THEN true END").alias("has_mx"))
    kept = A.mx_filter(_site_results(spark, d), known, "input_url")
    return kept.select("input_url", listed("emails").alias("emails"))


def email_dictionary(spark: SparkSession, d: str) -> DataFrame:
    rows = A.email_dictionary(_site_results(spark, d))
    return rows.select("input_url", "email", "role", flag("is_own").alias("is_own"), flag("from_mailto").alias("from_mailto"))


def protected_results(spark: SparkSession, d: str) -> DataFrame:
    """Result rows with personal addresses dropped, and the same with them hashed."""
    results = _site_results(spark, d)
    kept = A.drop_personal(results).select("input_url", listed("emails").alias("impersonal"))
    hashed = G.flatten_result(results, personal_salt="pepper").select("input_url", "own_domain_emails", "other_domain_emails")
    return kept.join(hashed, "input_url")


# ---- rollup ---------------------------------------------------------------------------------------------


def site_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = _site_results(spark, d)
    return r.select(
        "input_url", listed("emails").alias("emails"), listed("mailto_emails").alias("mailto_emails"), listed("phones", "|").alias("phones"),
        listed("whatsapp_links").alias("whatsapp"), listed("social_links").alias("social"), listed("source_pages").alias("source_pages"),
        "pages_ok", "pages_failed", "blocked_by", flag("has_contact_form").alias("has_contact_form"), *G.METADATA)


def merged_passes(spark: SparkSession, d: str) -> DataFrame:
    """Even pages as the first pass, odd pages as the second."""
    with page_batches(spark):
        pages = stage(_signals(spark, d).withColumn("rank", F.col("page_id")), "signals")
    first = G.rollup_site(pages.filter("page_id % 2 = 0"), ["site"])
    second = G.rollup_site(pages.filter("page_id % 2 = 1"), ["site"])
    m = G.merge_passes(first, second, ["site"])
    return m.select(
        "site", listed("emails").alias("emails"), listed("source_pages").alias("source_pages"), "pages_ok", "pages_failed",
        "blocked_by", flag("has_contact_form").alias("has_contact_form"), "page_title", "meta_description", "og_title")


def empty_status(spark: SparkSession, d: str) -> DataFrame:
    counts = I.page_hosts(spark, d).groupBy("site").agg(
        F.count_if(F.col("status") == 200).alias("ok"), F.count_if(F.col("status") != 200).alias("failed"),
        F.count_if(F.col("page_id") % 6 == 0).alias("n_emails"))
    emails = F.array_repeat(F.lit("a@b.io"), F.col("n_emails").cast("int"))
    failed, error = G.empty_status(emails, F.col("ok"), F.col("failed"))
    return counts.select("site", flag(failed).alias("fetch_failed"), error.alias("error"))


def salvage(spark: SparkSession, d: str) -> DataFrame:
    r = G.salvage_gate(_site_results(spark, d))
    return r.select("input_url", listed("phones", "|").alias("phones"), listed("whatsapp_links").alias("whatsapp"), listed("social_links").alias("social"))


def result_rows(spark: SparkSession, d: str) -> DataFrame:
    return G.flatten_result(G.salvage_gate(_site_results(spark, d)))


def _categorized(spark: SparkSession, d: str) -> DataFrame:
    return _long_form(spark, d)[1].withColumn("category", L.fact_category(F.col("method")))


def categories(spark: SparkSession, d: str) -> DataFrame:
    return _categorized(spark, d).select("input_url", "category")


def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return G.summarize(_categorized(spark, d))


def retry_list(spark: SparkSession, d: str) -> DataFrame:
    return G.retry_targets(_site_results(spark, d)).select("input_url")


def retry_queue(spark: SparkSession, d: str) -> DataFrame:
    results = _site_results(spark, d)
    done = I.page_hosts(spark, d).filter("length(host) % 2 = 0").select(F.col("site").alias("input_url")).distinct()
    return stream_retry_queue(results, done)


def low_quality(spark: SparkSession, d: str) -> DataFrame:
    return _long_form(spark, d)[1].filter(L.fact_low_quality()).select("input_url")


def second_pass_list(spark: SparkSession, d: str) -> DataFrame:
    return G.second_pass_targets(G.salvage_gate(_site_results(spark, d))).select(
        "input_url", F.col("pass_order").cast("bigint").alias("pass_order"))


def run_counters(spark: SparkSession, d: str) -> DataFrame:
    return G.run_counters(_site_results(spark, d), total=10_000_000, elapsed_seconds=50.0)


def latest_per_target(spark: SparkSession, d: str) -> DataFrame:
    return G.latest_per_target(_turns(I.table(spark, d, "conversations")))


def resume_remaining(spark: SparkSession, d: str) -> DataFrame:
    hosts = I.page_hosts(spark, d).select(F.col("site").alias("input_url"), "page_id")
    return G.resume_remaining(hosts.select("input_url").distinct(), hosts.filter("page_id % 4 = 1"))


def _history(spark: SparkSession, d: str) -> DataFrame:
    """One summary per day and hour of the events."""
    events = I.table(spark, d, "events").select(
        F.expr("date_trunc('hour', ts)").alias("hour"), F.expr("event_type").alias("kind"))
    return events.groupBy("hour").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == "click").alias("email_found"),
        F.count_if(F.col("kind") == "error").alias("connection_failed"), F.count_if(F.col("kind") == "view").alias("salvage_only"))


def hit_rate_trend(spark: SparkSession, d: str) -> DataFrame:
    trend = G.hit_rate_trend(_history(spark, d).withColumnRenamed("hour", "timestamp"))
    return trend.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "total", "email_found", F.round("hit_rate", 9).alias("hit_rate"),
        F.round("hit_rate_change", 9).alias("hit_rate_change"))


def history_lines(spark: SparkSession, d: str) -> DataFrame:
    """History kept as JSON lines, every fifth of them cut off."""
    line = F.to_json(F.struct(
        F.concat(F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("timestamp"), "total", "email_found"))
    cut = F.when(F.hour("hour") % 5 == 3, F.substring(line, 1, 30)).otherwise(line)
    lines = _history(spark, d).select(cut.alias("value"))
    last = last_summaries(lines)
    return last.select(F.unix_seconds("timestamp").alias("at"), "total", "email_found")


def target_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.expr("""CASE doc_id % 5 WHEN 0 THEN '# ' || source WHEN 1 THEN '   ' WHEN 2 THEN ' shop' || doc_id || '.io , note'
                     WHEN 3 THEN 'https://site' || doc_id || '.org/a' ELSE source || '.com' END""")
    return targets_of_lines(I.table(spark, d, "documents").select(line.alias("value")))


def target_positions(spark: SparkSession, d: str) -> DataFrame:
    """Target files of one line per document, read back with line numbers over all files."""
    line = F.expr("""CASE doc_id % 4 WHEN 0 THEN '# ' || source WHEN 1 THEN '' WHEN 2 THEN ' shop' || doc_id || '.io , note' ELSE source || '.com' END""")
    path = f"{stage_dir(spark)}/targets-{uuid.uuid4().hex}"
    I.table(spark, d, "documents").repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").select(line.alias("value")).write.text(path)
    return read_target_list(spark, path)


def results_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Targets that a written result file has a row for, of twice as many."""
    path = f"{stage_dir(spark)}/results-{uuid.uuid4().hex}"
    rows = G.flatten_result(G.salvage_gate(_site_results(spark, d)))
    write_results_csv(rows, path)
    asked = rows.select("input_url").unionByName(rows.select(F.concat("input_url", F.lit("/more")).alias("input_url")))
    left = G.resume_remaining(asked, read_completed(spark, path)).withColumn("done", F.lit(0))
    return left.unionByName(read_completed(spark, path).withColumn("done", F.lit(1)))


def job_keys(spark: SparkSession, d: str) -> DataFrame:
    return job_key(I.page_hosts(spark, d).select(F.col("site").alias("input_url")).distinct())


# ---- fetch log --------------------------------------------------------------------------------------------


def fetch_outcome(spark: SparkSession, d: str) -> DataFrame:
    out = H.fetch_outcome(I.fetch_log(spark, d))
    return out.select("url", "attempt", F.coalesce("status", F.lit(0)).alias("status"), "outcome")


def retry_after(spark: SparkSession, d: str) -> DataFrame:
    log = I.fetch_log(spark, d).filter("retry_after IS NOT NULL")
    wait = H.retry_after_seconds(F.col("retry_after"), F.col("requested_at"))
    return log.select("event_id", F.round(wait, 3).alias("seconds"),
                      F.round(H.capped_retry_after(F.col("retry_after"), F.col("requested_at")), 3).alias("capped"))


def backoff_audit(spark: SparkSession, d: str) -> DataFrame:
    audit = H.backoff_audit(I.fetch_log(spark, d))
    return audit.select("url", "attempt", F.round("waited", 6).alias("waited"), "ceiling", flag("excess").alias("excess"))


def _domain_intervals(spark: SparkSession, d: str) -> DataFrame:
    domains = I.fetch_log(spark, d).select("domain").distinct()
    return domains.select("domain", F.expr("CASE WHEN length(domain) % 2 = 0 THEN 7.0D ELSE 0.5D END").alias("min_interval"))


def politeness_audit(spark: SparkSession, d: str) -> DataFrame:
    audit = H.politeness_audit(I.fetch_log(spark, d), _domain_intervals(spark, d), tie="event_id")
    return audit.select("event_id", "domain", F.round("gap", 6).alias("gap"), flag("too_soon").alias("too_soon"))


def crawl_schedule(spark: SparkSession, d: str) -> DataFrame:
    top = C.top_candidates(C.score_contact_urls(I.contact_urls(spark, d)), ["site"])
    domain = F.regexp_replace(netloc("site"), r"^(?:www|m|blog)\.", "")
    rows = top.select("site", "url", F.col("rank"), domain.alias("domain"))
    intervals = rows.select("domain").distinct().select(
        "domain", F.expr("CASE WHEN length(domain) % 2 = 0 THEN 7.0D ELSE 0.5D END").alias("min_interval"))
    plan = H.crawl_schedule(rows, intervals)
    return plan.select("domain", "site", "url", F.col("position").cast("bigint").alias("position"), "start_seconds")


def hit_rate_by_window(spark: SparkSession, d: str) -> DataFrame:
    events = I.table(spark, d, "events").select(
        F.expr(I.INSTANT_SQL).alias("ts"), (F.col("event_type") == "click").alias("hit"), (F.col("event_type") == "error").alias("failed"))
    return hit_rate_windows(events).select(F.unix_seconds("window_start").alias("window_start"), "done", "with_email", "errors")


# ---- streams --------------------------------------------------------------------------------------------------


def _run_stream(spark: SparkSession, query: DataFrame, schema) -> DataFrame:
    """Run a stream over all available rows into a staged folder and read the folder."""
    path = f"{stage_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = query.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/rows")


def given_up_targets(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the events as targets: a view starts one, a click finishes it. Given up by the clock, at once, in a stream over the events."""
    progress = I.table_stream(spark, d, "events").select(F.expr("'https://u' || user_id || '-' || event_id % 37 || '.sample.net'").alias("input_url"), F.expr(
        "CASE event_type WHEN 'view' THEN 'started' WHEN 'click' THEN 'finished' ELSE 'other' END").alias("kind"))
    path = f"{stage_dir(spark)}/stream-{uuid.uuid4().hex}"
    with rocksdb_state(spark):
        writer = stream_give_up_by_clock(progress, seconds=0).writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
        run_until_idle(writer.start(f"{path}/rows"))
    return spark.read.schema(GIVE_UP_OUTPUT).parquet(f"{path}/rows").drop("gave_up_at")


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.expr("'https://s' || conv_id || '.sample.net'").alias("input_url"), F.md5("text").alias("content"), "role",
        F.expr("conv_id * 1000 + turn").alias("seq"))


def upserted_targets(spark: SparkSession, d: str) -> DataFrame:
    """The turns as a stream of rows per target; the last one of each is read from the stream's state."""
    rows = _turns(I.table_stream(spark, d, "conversations"))
    path = f"{stage_dir(spark)}/stream-{uuid.uuid4().hex}"
    T.keep_latest(rows, path).awaitTermination()
    return T.read_latest(spark, path, rows.schema)


def upserted_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same rows in several batches, each a folder of its own, then compacted into one."""
    path = f"{stage_dir(spark)}/stream-{uuid.uuid4().hex}"
    turns = _turns(I.table(spark, d, "conversations"))
    turns.repartition(6, "input_url").write.parquet(f"{path}/source")
    source = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/source")
    stream_upsert_results(source, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    last = spark.read.parquet(f"{path}/rows/part-*").agg(F.max("batch_id")).first()[0]
    compact_upserts(spark, f"{path}/rows", last, f"{path}/compacted")
    return read_upserted(spark, f"{path}/compacted")


def streamed_counters(spark: SparkSession, d: str) -> DataFrame:
    """Running totals over the events as results, read from the stream's state."""
    results = I.table_stream(spark, d, "events").select(
        F.expr("CASE WHEN event_type = 'click' THEN array('a@b.io') ELSE array() END").alias("emails"),
        F.expr("CASE WHEN event_type = 'error' THEN 'failed' ELSE '' END").alias("error"))
    path = f"{stage_dir(spark)}/stream-{uuid.uuid4().hex}"
    T.keep_counters(results, path).awaitTermination()
    return T.read_counters(spark, path)


def newest_results(spark: SparkSession, d: str) -> DataFrame:
    """The newest events, held as list state in salted parts."""
    rows = I.table_stream(spark, d, "events").select("event_id", F.expr("'https://u' || user_id || '.sample.net'").alias("input_url"), F.expr(I.INSTANT_SQL).alias("finished_at"))
    path = f"{stage_dir(spark)}/stream-{uuid.uuid4().hex}"
    T.keep_newest(rows, path).awaitTermination()
    newest = T.read_newest(spark, path, rows.schema)
    return newest.select("event_id", "input_url", F.unix_micros("finished_at").alias("at"))


def streamed_emails(spark: SparkSession, d: str) -> DataFrame:
    """The page addresses again, extracted from a stream of the pages."""
    captures = I.site_pages(spark, d, I.table_stream(spark, d, "pages")).withColumn("fetched_at", F.timestamp_seconds("page_id"))
    found = stream_extract(captures, blocked_domains=OPEN_DOMAINS).select(
        F.unix_seconds("fetched_at").alias("page_id"), F.explode("emails").alias("email"))
    return _run_stream(spark, found, "page_id bigint, email string")


# ---- whole job -------------------------------------------------------------------------------------------------


def _job_inputs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Every site as a target; its pages captured under contact-like URLs and one of them as the homepage."""
    pages = I.site_pages(spark, d).withColumn("contact", F.expr(f"site || {I.CONTACT_PATH_SQL}"))
    link = F.expr("""replace(html, '<footer>', '<footer><a href="' || CASE WHEN page_id % 2 = 0 THEN contact ELSE '/team/' || page_id END || '">More</a>')""")
    firsts = I.page_hosts(spark, d).groupBy("site").agg(F.min("page_id").alias("page_id")).select("page_id")
    first = pages.join(firsts, "page_id", "left_semi")
    columns = lambda df, url, html, name: df.select(
        url.alias("url"), html.alias("html"), F.col("status"), F.timestamp_seconds(F.col("page_id")).alias("fetched_at"),
        F.lit(name).alias("pass"))
    captures = columns(pages, F.col("contact"), F.col("html"), "static").unionByName(
        columns(first, F.col("site"), link, "static")).unionByName(
        columns(pages.filter("page_id % 3 = 0"), F.col("contact"), F.expr("html || '<p>rendered@' || host || '</p>'"), "rendered"))
    files = I.page_hosts(spark, d).filter("length(host) % 2 = 0").withColumn("contact", F.expr(f"site || {I.CONTACT_PATH_SQL}"))
    bodies = files.select(
        F.expr("site || CASE page_id % 3 WHEN 0 THEN '/sitemap.xml' WHEN 1 THEN '/sitemap_index.xml' ELSE '/wp-sitemap.xml' END").alias("url"),
        F.expr("'<urlset><url><loc>' || replace(contact, '&', '&amp;') || '</loc></url></urlset>'").alias("body"), "page_id")
    sitemaps = bodies.groupBy("url").agg(F.min_by("body", "page_id").cast("binary").alias("body"))
    targets = I.page_hosts(spark, d).select(F.expr("CASE WHEN page_id % 2 = 0 THEN host ELSE site || '/x' END").alias("input_url"))
    return {"targets": targets, "captures": captures, "robots": I.robots(spark, d), "sitemaps": sitemaps}


def site_analysis(spark: SparkSession, d: str) -> DataFrame:
    return G.flatten_result(analyze(**_job_inputs(spark, d)))


def rendered_pass(spark: SparkSession, d: str) -> DataFrame:
    inputs = _job_inputs(spark, d)
    results = stage(analyze(**inputs), "results")
    chosen = G.second_pass_targets(results).drop("pass_order")
    return G.flatten_result(apply_rendered_pass(chosen, inputs["captures"]))


QUERIES = {f.__name__: f for f in [
    normalize_hosts, unparseable_targets, url_tokens, rank_contact_urls, top_candidates, early_stop_pages, reachable_sites,
    footer_links, second_hop_links, robots_rules, robots_allowed, crawl_delay, min_intervals, declared_sitemaps,
    sitemap_candidates, sitemap_parse, sitemap_walk, sitemap_leftovers, sitemap_leftovers_tight, sitemap_pages, usable_captures, page_text, page_links, text_emails,
    valid_emails, blocked_domain_rows, obfuscated_emails, protected_emails, mailto_emails, json_emails, markup_emails,
    page_emails, phones, document_phones, whatsapp_links, social_links, block_signatures, contact_forms, page_metadata,
    own_vs_other, email_roles, address_pages, site_facts, ranked_emails, primary_email, mx_filtered, email_dictionary, protected_results, site_rollup,
    merged_passes, empty_status, salvage, result_rows, categories, batch_summary, retry_list, retry_queue, low_quality,
    second_pass_list, run_counters, latest_per_target, resume_remaining, hit_rate_trend, history_lines, target_lines, target_positions,
    job_keys, fetch_outcome, retry_after, backoff_audit, politeness_audit, crawl_schedule, hit_rate_by_window,
    results_round_trip, given_up_targets, upserted_targets, upserted_batches, streamed_counters, newest_results, streamed_emails, site_analysis, rendered_pass,
]}
