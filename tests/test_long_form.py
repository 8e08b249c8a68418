import random

from pyspark.sql import functions as F

from sitesignal.operators import addresses as L
from sitesignal.operators import rollup as G
from sitesignal.operators.attribution import email_dictionary, primary_of, ranked_emails
from sitesignal.operators.skew import join_by_load

PAGE = ("domain string, url string, rank int, fetched boolean, emails array<string>, mailto_emails array<string>, phones array<string>, "
        "whatsapp array<string>, social array<string>, blocked_by string, has_contact_form boolean, "
        "metadata struct<page_title:string,meta_description:string,og_title:string,og_description:string>")


def some_pages(n=400):
    dice = random.Random(7)
    locals_ = ["info", "sales", "xq7z", "press", "lena.kurz", "webmaster", "billing"]
    rows = []
    for i in range(n):
        domain = "hot.io" if i % 3 else f"d{dice.randrange(20)}.io"
        fetched = dice.random() < 0.8
        found = [f"{dice.choice(locals_)}@{dice.choice([domain, 'other.org', 'mail.' + domain])}" for _ in range(dice.choice([0, 0, 1, 2]))] if fetched and domain != "d3.io" else []
        found = sorted(set(found))
        rows.append((domain, f"https://{domain}/p{i // 2}", i, fetched, found, [e for e in found if dice.random() < 0.3], ["+1"] * dice.choice([0, 1]), [], [],
                     dice.choice(["", "", "akamai"]), dice.random() < 0.1, ("t", "", "", "")))
    return rows


def results(pages):
    sites = G.rollup_site(pages, ["domain"])
    failed, error = G.empty_status(F.col("emails"), F.col("pages_ok"), F.col("pages_failed"))
    return sites.select("*", F.col("domain").alias("input_url"), F.lit("sitemap").alias("method"), failed.alias("fetch_failed"), error.alias("error"))


def test_long_form_equals_the_rollup(table):
    pages = table(some_pages(), PAGE)
    rows = L.site_addresses(pages, ["domain"], "domain")
    facts = L.site_facts(pages, rows, ["domain"]).withColumn("category", L.fact_category(F.lit("sitemap")))
    whole = results(pages)
    key = lambda df, c: sorted(tuple(r) for r in df.select(*c).collect())
    columns = ["domain", "email", "role", "is_own", "from_mailto"]
    assert key(rows, columns) == key(email_dictionary(whole), columns)
    best = ranked_emails(whole).select("domain", primary_of(F.col("ranked_own"), F.col("ranked_other"))["email"].alias("email"))
    assert {r.domain: r.email for r in best.collect()} == {r.domain: r.email for r in facts.select("domain", "best.email").collect()}
    assert key(facts, ["domain", "category"]) == key(G.categorize(G.salvage_gate(whole)), ["domain", "category"])
    assert key(facts.filter(L.fact_low_quality()), ["domain"]) == key(G.low_quality(whole), ["domain"])


def test_source_page_and_page_count(table):
    pages = some_pages()
    where = {}
    for domain, url, rank, _, found, *_ in pages:
        for e in found:
            where.setdefault((domain, e), []).append((rank, url))
    got = {(r.domain, r.email): (r.source_page, r.n_pages) for r in L.site_addresses(table(pages, PAGE), ["domain"], "domain").collect()}
    assert got == {k: (min(v)[1], len({u for _, u in v})) for k, v in where.items()}


def test_long_form_of_odd_pages(table):
    none = table([], PAGE)
    assert L.site_addresses(none, ["domain"], "domain").count() == 0
    # an address that is only linked, on a page that shows none, is no address of the site
    only = table([("a.io", "u", 1, True, [], ["x@a.io"], [], [], [], "", False, None), (None, "v", 2, True, ["y@a.io"], [], [], [], [], "", False, None)], PAGE)
    assert [(r.domain, r.email) for r in L.site_addresses(only, ["domain"], "domain").collect()] == [(None, "y@a.io")]
    facts = L.site_facts(only, L.site_addresses(only, ["domain"], "domain"), ["domain"]).collect()
    assert {r.domain: (r.n_emails, r.fetch_failed) for r in facts if r.domain} == {"a.io": (0, False)}


def test_a_hot_key_is_dealt_over_tasks(spark):
    rows = spark.range(20000).selectExpr("CASE WHEN id % 10 < 9 THEN 'hot' WHEN id % 20 = 9 THEN NULL ELSE 'k' || id % 100 END AS host", "id")
    lookup = spark.range(100).selectExpr("'k' || id AS host", "id * 2 AS rules").unionByName(spark.range(1).selectExpr("'hot' AS host", "cast(7 AS bigint) AS rules"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        joined = join_by_load(rows, lookup, "host")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        got = sorted((r.id, r.rules) for r in joined.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(sizes) < 20000 / 4  # one host holds nine tenths
    want = {r.host: r.rules for r in lookup.collect()}
    assert [i for i, _ in got] == list(range(20000))
    assert got == sorted((r.id, want.get(r.host)) for r in rows.collect())
    assert join_by_load(rows.limit(0), lookup, "host").count() == 0
