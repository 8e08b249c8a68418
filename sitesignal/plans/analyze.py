"""The whole job: targets and captured data in, one result row per target out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesignal import fixed_values as fv
from sitesignal.functions.emails import empty_strings
from sitesignal.functions.page_scan import scan
from sitesignal.functions.signals import block_vendor
from sitesignal.functions.urls import bare_domain, base_url, capture_key, robots_path
from sitesignal.operators.attribution import drop_personal as without_personal
from sitesignal.operators.attribution import mx_filter
from sitesignal.operators.candidates import (
    all_links, early_stop, footer_links, reachable_gate, score_contact_urls, second_hop_links, top_candidates,
)
from sitesignal.operators.captures import keyed, latest_matching, one_per_key
from sitesignal.operators.extraction import SIGNALS, page_signals
from sitesignal.operators.robots import is_allowed, robots_policy, with_allowed
from sitesignal.operators.rollup import METADATA, SETS, empty_status, rollup_site, salvage_gate
from sitesignal.operators.sitemaps import (
    dedupe_pages, parsed_sitemaps, sitemap_candidates, walk_sitemaps,
)
from sitesignal.session import stage

NO_RULES = "array<struct<allow:boolean,path:string>>"

RESULT = [
    "input_url", "domain", "emails", "source_pages", "method", "error", "fetch_failed", "phones",
    "whatsapp_links", "social_links", "base_url", "pages_checked", "blocked_by", "has_contact_form",
    *METADATA, "mailto_emails",
]


def sites_of(targets: DataFrame) -> DataFrame:
    """Distinct base URLs of the targets with their domain.

    Every later step works per base URL, so a site named by many targets is
    handled once.
    """
    return targets.select(base_url("input_url").alias("site")).distinct().withColumn("domain", bare_domain("site"))


def _policies(sites: DataFrame, robots: DataFrame | None, respect: bool) -> DataFrame:
    """``(site, rules, crawl_delay, sitemaps)`` for every site; rules empty when robots are ignored."""
    no_rules, no_maps = F.array().cast(NO_RULES), empty_strings()
    if robots is None:
        return sites.select("site", no_rules.alias("rules"), no_maps.alias("sitemaps"))
    own = robots.withColumn("site", F.concat(F.lit("https://"), "host")).join(sites.select("site"), "site", "left_semi")
    policy = robots_policy(own, key="site")
    full = sites.select("site").join(policy, "site", "left")
    rules = F.coalesce("rules", no_rules) if respect else no_rules
    return full.select("site", rules.alias("rules"), F.coalesce("sitemaps", no_maps).alias("sitemaps"))


def ranked_pages(sites: DataFrame, policy: DataFrame, sitemaps: DataFrame, **limits: int) -> DataFrame:
    """Best contact pages of the sites' sitemaps: ``(site, url, rank, score)``.

    Scoring comes first, since it needs nothing but the URL and drops nearly
    all of them before the robots join, the deduplication and the ranking.
    """
    parsed = stage(parsed_sitemaps(sitemaps), "sitemaps")
    declared = policy.select("site", F.posexplode("sitemaps").alias("ord", "sitemap_url"))
    seeds = sitemap_candidates(sites, declared)
    pages = score_contact_urls(walk_sitemaps(seeds, parsed, **limits))
    allowed = with_allowed(pages, policy, on="site").filter("allowed").drop("allowed")
    scores = dedupe_pages(allowed)
    return top_candidates(scores, ["site"]).select("site", "url", "rank", "score")


def homepage_plan(homes: DataFrame) -> DataFrame:
    """Adds the homepage's ``first`` pages (itself and allowed footer links) and ``second`` hop links."""
    page = F.col("page")
    linked = homes.select(
        "site", "rules", "fetched", "home_blocked",
        footer_links(F.col("site"), page).alias("_footer"), all_links(F.col("site"), page).alias("_links"),
    )
    allowed = F.filter("_footer", lambda l: is_allowed(F.col("rules"), robots_path(l)))
    first = F.concat(F.array("site"), F.slice(allowed, 1, fv.MAX_PAGES_PER_SITE - 1))
    return linked.withColumn("first", first).select(
        "site", "rules", "fetched", "home_blocked", "first",
        second_hop_links(F.col("site"), F.col("_links"), F.col("first")).alias("second"),
    )


def read_homes(wanted: DataFrame, captures: DataFrame) -> DataFrame:
    """Homepages of ``wanted(site, rules)``: scanned page, fetch state and block vendor."""
    keys = stage(wanted.withColumn("key", capture_key("site")), "homes-wanted")
    found = latest_matching(captures.drop("site"), keys.select("key"))
    ok = F.coalesce(F.col("status") == 200, F.lit(False))
    scanned = found.select(
        "key", ok.alias("fetched"), block_vendor("html").alias("_vendor"),
        scan(F.when(ok, F.col("html"))).alias("page"), F.struct(~ok, F.xxhash64("html")).alias("_tie"),
    )
    return (
        keys.join(one_per_key(scanned), "key")
        .withColumn("home_blocked", F.when(~F.col("fetched"), F.coalesce("_vendor", F.lit(""))).otherwise(""))
        .drop("_vendor", "key")
    )


def candidate_plan(sites: DataFrame, policy: DataFrame, ranked: DataFrame | None, captures: DataFrame
                   ) -> tuple[DataFrame, DataFrame]:
    """Pages to look at, and what the homepages of sites without ranked pages gave.

    The first table is ``(site, phase, rank, url, key, allowed)``; phase 2 is
    the second hop. The second is ``(site, fetched, home_blocked)``.
    """
    open_sites = sites.filter("reachable").select("site", "domain")
    rest = open_sites if ranked is None else open_sites.join(ranked.select("site"), "site", "left_anti")
    home_allowed = is_allowed(F.col("rules"), robots_path("site"))
    wanted = rest.join(policy.select("site", "rules"), "site").filter(home_allowed).select("site", "rules")
    homes = stage(homepage_plan(read_homes(wanted, captures)), "homes")
    usable = homes.filter("fetched")
    first = usable.select(
        "site", F.lit(1).alias("phase"), F.posexplode("first").alias("rank", "url")
    ).withColumn("allowed", F.lit(True))
    second = usable.select(
        "site", "rules", F.lit(2).alias("phase"), F.posexplode("second").alias("rank", "url")
    ).withColumn("allowed", is_allowed(F.col("rules"), robots_path("url"))).drop("rules")
    pages = first.unionByName(second).withColumn("rank", F.col("rank") + 1)
    if ranked is not None:
        listed = ranked.select("site", F.lit(1).alias("phase"), "rank", "url", F.lit(True).alias("allowed"))
        pages = listed.unionByName(pages)
    return pages.withColumn("key", capture_key("url")), homes.select("site", "fetched", "home_blocked")


def signals_for(wanted: DataFrame, captures: DataFrame, **options) -> DataFrame:
    """Signals of the newest capture per wanted key; each distinct page is scanned once."""
    found = latest_matching(captures.drop("site"), wanted)
    found = found.withColumn("_tie", F.struct(~F.coalesce(F.col("status") == 200, F.lit(False)), F.xxhash64("html")))
    return one_per_key(page_signals(found, keep=["key", "_tie"], **options))


def with_signals(plan: DataFrame, signals: DataFrame) -> DataFrame:
    """Planned pages with their signals; a page without a capture counts as failed."""
    out = plan.join(signals, "key", "left").withColumn("fetched", F.coalesce("fetched", F.lit(False)))
    for c in SETS.values():
        out = out.withColumn(c, F.coalesce(c, empty_strings()))
    return out.withColumn("blocked_by", F.coalesce("blocked_by", F.lit(""))).withColumn(
        "has_contact_form", F.coalesce("has_contact_form", F.lit(False)))


def check_pages(pages: DataFrame, wave_size: int, min_pages: int) -> DataFrame:
    """One row per site over both phases; the second counts only if the first gave no address."""
    kept = early_stop(pages.withColumn("has_email", F.size("emails") > 0), ["site", "phase"], wave_size, min_pages)
    phases = rollup_site(kept, ["site", "phase"], salts=1)
    rows = phases.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(*[c for c in phases.columns if c != "site"]))).alias("_p"))
    one, two = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    # a site whose second-hop links alone were allowed still starts with phase 1: the homepage
    hop = (F.size(one["emails"]) == 0) & two.isNotNull()

    def united(c: str) -> Column:
        return F.when(hop, F.array_sort(F.array_union(one[c], two[c]))).otherwise(one[c])

    def first_text(c: str) -> Column:
        return F.when((one[c] == "") & hop, two[c]).otherwise(one[c])

    return rows.select(
        "site",
        *[united(c).alias(c) for c in [*SETS, "source_pages"]],
        *[(one[c] + F.when(hop, two[c]).otherwise(F.lit(0))).alias(c) for c in ["pages_ok", "pages_failed"]],
        *[first_text(c).alias(c) for c in ["blocked_by", *METADATA]],
        (one["has_contact_form"] | F.when(hop, two["has_contact_form"]).otherwise(F.lit(False))).alias("has_contact_form"),
        (F.size(one["emails"]) == 0).alias("_hop"),
    )


def _page_lists(plan: DataFrame) -> DataFrame:
    """``first_pages`` and ``second_pages`` of each site, in order (at most 28 rows per site)."""
    def urls(phase: int) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("phase") == phase, F.struct("rank", "url"))))
        return F.transform(rows, lambda r: r["url"])

    return plan.groupBy("site").agg(urls(1).alias("first_pages"), urls(2).alias("second_pages"))


def fold_rendered(state: DataFrame, key: str, captures: DataFrame, **options) -> DataFrame:
    """Look again at the pages of each row of ``state``, in a later, rendered capture set.

    Rows without known pages use the homepage and then its footer links.
    """
    # a rendered page counts whatever its status, as long as there is one
    later = keyed(captures, "rendered").withColumn("status", F.when(F.length("html") > 0, 200))
    known = state.filter(F.size("pages_checked") > 0).select(
        key, F.posexplode(F.slice("pages_checked", 1, fv.MAX_PAGES_PER_SITE)).alias("rank", "url"))
    blind = state.filter((F.size("pages_checked") == 0) & (F.col("base_url") != "")).select(
        key, F.col("base_url").alias("site"))
    homes = read_homes(blind.select("site").distinct().withColumn("rules", F.array().cast(NO_RULES)), later)
    links = homes.filter("fetched").select(
        "site", footer_links(F.col("site"), F.col("page")).alias("_l")
    ).select("site", F.slice("_l", 1, fv.MAX_PAGES_PER_SITE - 1).alias("_l"))
    opened = blind.join(links, "site", "left").select(
        key, F.posexplode(F.concat(F.array("site"), F.coalesce("_l", empty_strings()))).alias("rank", "url"))
    plan = stage(known.unionByName(opened).withColumn("key", capture_key("url")), "rendered-plan")
    pages = with_signals(plan, signals_for(plan.select("key"), later, **options)).filter("fetched")
    again = rollup_site(pages, [key], salts=1, metadata="fields")
    renamed = again.select(key, *[F.col(c).alias(f"_r_{c}") for c in again.columns if c != key])
    out = state.join(renamed, key, "left")
    seen = F.coalesce(F.col("_r_pages_ok"), F.lit(0)) > 0
    before = {c: F.col(c) for c in ["phones", "whatsapp_links", "social_links"]}
    union = lambda c: F.array_sort(F.array_union(c, F.coalesce(f"_r_{c}", empty_strings())))
    out = out.select(
        "*",
        union("emails").alias("_emails"), union("mailto_emails").alias("_mailto_emails"),
        union("source_pages").alias("_source_pages"),
    )
    has_email = F.size("_emails") > 0
    failed = F.when(has_email | seen, F.lit(False)).otherwise(F.col("fetch_failed"))
    error = (
        F.when(has_email, "")
        .when(seen | (F.col("error") == ""), fv.ERROR_NO_EMAILS_RENDERED)
        .otherwise(F.col("error"))
    )
    text = lambda c: F.when(F.col(c) == "", F.coalesce(f"_r_{c}", F.lit(""))).otherwise(F.col(c))
    new = {
        "emails": F.col("_emails"), "mailto_emails": F.col("_mailto_emails"), "source_pages": F.col("_source_pages"),
        "method": F.when(has_email, F.concat("method", F.lit("+playwright"))).otherwise(F.col("method")),
        "error": error, "fetch_failed": failed,
        "has_contact_form": F.col("has_contact_form") | F.coalesce("_r_has_contact_form", F.lit(False)),
        **{c: text(c) for c in ["blocked_by", *METADATA]},
        **{c: F.when(~has_email & ~failed, union(c)).otherwise(before[c]) for c in before},
    }
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in state.columns])


def apply_rendered_pass(results: DataFrame, captures: DataFrame, **options) -> DataFrame:
    """Second pass over result rows with rendered captures of their pages."""
    return fold_rendered(results, "input_url", captures, **options)


def analyze(targets: DataFrame, captures: DataFrame, robots: DataFrame | None = None,
            sitemaps: DataFrame | None = None, mx: DataFrame | None = None, *,
            respect_robots: bool = True, use_rendered: bool = False, drop_personal: bool = False,
            wave_size: int = fv.WAVE_SIZE, min_pages: int = fv.MIN_PAGES_BEFORE_STOP, **options) -> DataFrame:
    """Results, one row per distinct ``input_url`` (see ``RESULT`` for the columns).

    Sitemaps, the candidate pages and the homepages are staged on the way, so
    calling this runs jobs. ``options`` go to ``page_signals``.
    """
    named = targets.select("input_url").distinct().withColumn("site", base_url("input_url"))
    sites = sites_of(targets).filter(F.col("domain") != "")
    static = keyed(captures)
    probe = static.select("site", "status")
    if robots is not None:
        probe = probe.unionByName(robots.select(F.concat(F.lit("https://"), "host").alias("site"), F.lit(200).alias("status")))
    sites = stage(reachable_gate(sites, probe), "sites")
    policy = stage(_policies(sites, robots, respect_robots), "robots")
    open_sites = sites.filter("reachable")
    ranked = None
    if sitemaps is not None:
        ranked = stage(ranked_pages(open_sites.select("site"), policy, sitemaps), "ranked")
    plan, homes = candidate_plan(sites, policy, ranked, static)
    plan = stage(plan, "plan")
    pages = with_signals(plan, signals_for(plan.select("key"), static, **options)).filter("allowed")
    state = (
        sites.join(check_pages(pages, wave_size, min_pages), "site", "left")
        .join(_page_lists(plan), "site", "left").join(homes, "site", "left")
    )
    listed = F.coalesce(F.size("first_pages"), F.lit(0)) > 0
    method = F.when(~listed | ~F.col("reachable"), "none").when(F.col("fetched").isNull(), "sitemap").otherwise("homepage-fallback")
    status_failed, status_error = empty_status(F.col("emails"), F.col("pages_ok"), F.col("pages_failed"))
    error = (
        F.when(~F.col("reachable"), fv.ERROR_UNREACHABLE).when(~listed, fv.ERROR_NO_PAGES).otherwise(status_error)
    )
    no = empty_strings()
    state = state.select(
        "site", "domain", F.col("site").alias("base_url"),
        method.alias("method"), error.alias("error"),
        F.when(listed, status_failed).otherwise(F.lit(False)).alias("fetch_failed"),
        *[F.coalesce(c, no).alias(c) for c in [*SETS, "source_pages"]],
        F.coalesce(
            F.when(F.col("_hop"), F.array_union("first_pages", "second_pages")), F.col("first_pages"), no
        ).alias("pages_checked"),
        F.coalesce(F.nullif(F.col("home_blocked"), F.lit("")), F.col("blocked_by"), F.lit("")).alias("blocked_by"),
        F.coalesce("has_contact_form", F.lit(False)).alias("has_contact_form"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in METADATA],
    )
    if use_rendered:
        state = stage(state, "state")
        poor = fold_rendered(state.filter(F.size("emails") == 0), "base_url", captures, **options)
        state = state.filter(F.size("emails") > 0).unionByName(poor)
    if mx is not None:
        state = stage(state, "before-mx")
        early = F.col("method").startswith("none")  # sites without pages end before this check
        state = mx_filter(state.filter(~early), mx, "site").unionByName(state.filter(early))
    if drop_personal:
        state = without_personal(state)
    state = state.withColumn(
        "error", F.when((F.size("emails") == 0) & (F.col("error") == ""), fv.ERROR_NO_EMAILS).otherwise(F.col("error")))
    return _named_results(named, salvage_gate(state))


def _named_results(named: DataFrame, state: DataFrame) -> DataFrame:
    """Results under the name each target was given; unparseable targets get their error row."""
    out = named.join(state, "site", "left")
    bad = F.col("domain").isNull()
    defaults = {
        "domain": F.lit(""), "base_url": F.col("site"), "method": F.lit(""), "error": F.lit(fv.ERROR_UNPARSEABLE),
        "fetch_failed": F.lit(False), "has_contact_form": F.lit(False), "blocked_by": F.lit(""),
        **{c: F.lit("") for c in METADATA},
    }
    return out.select(*[
        F.col(c) if c == "input_url" else F.when(bad, defaults.get(c, empty_strings())).otherwise(F.col(c)).alias(c)
        for c in RESULT
    ])
