from pyspark.sql import functions as F

from sitesignal.functions import urls as U
from sitesignal.operators import candidates as C
from sitesignal.operators import skew


def test_base_url_and_domain(each):
    raw = ["example.com", "https://example.com/foo/bar", "http://x.com:8080/a", " HTTP://www.Foo.com?x ", "", "//x.com", "u@h.io/a", "[bad"]
    assert each(raw, U.base_url("v")) == [
        "https://example.com", "https://example.com", "https://x.com:8080", "https://www.Foo.com", "", "https://", "https://u@h.io", "https://"]
    assert each(["https://www.example.com", "https://x.www.com", "https://"], U.bare_domain("v")) == ["example.com", "x.www.com", ""]
    assert each(["mail.X.com", "x"], U.brand_label("v")) == ["mail", "x"]


def test_path_and_tokens(each):
    assert each(["https://a.io/b/c;p=1?q#f", "https://a.io", "/x/y;z/w", "mailto:a@b"], U.url_path("v")) == ["/b/c", "", "/x/y;z/w", "a@b"]
    segments = U.path_segments("v")
    assert each(["/blog/customer-support/", "/", ""], segments) == [["blog", "customer-support"], [], []]
    assert each(["/blog/customer-support/", "/"], F.array_sort(U.path_tokens(segments))) == [["blog", "customer", "customer-support", "support"], []]


def test_robots_path_quoting(each):
    urls = ["https://a.io", "https://a.io/a b", "https://a.io/ä", "https://a.io/a%2Fb", "https://a.io/a?x=1&y", "https://a.io/a?#", "https://a.io/100%", "https://a.io/a+b*"]
    assert each(urls, U.robots_path("v")) == ["/", "/a%20b", "/%C3%A4", "/a/b", "/a%3Fx%3D1%26y", "/a", "/100%25", "/a%2Bb%2A"]


def scores(table, paths):
    df = table([("https://x.io" + p, i) for i, p in enumerate(paths)], "url string, ord bigint").withColumn("site", F.lit("s"))
    return df, {r.url[12:]: r.score for r in C.score_contact_urls(df).collect()}


def test_scores(table):
    paths = ["/contact", "/about-us", "/about/team", "/contact.html", "/blog/how-to-contact-support", "/privacy-policy",
             "/2024/06/contact-form-tips", "/es-es/help/connect-a-custom-domain-with-x-sites", "/company/global/contact-us",
             "/about-us/contact-support-team", "/contacto", "/contactez-nous", "/kontakt", "/contatti", "/pricing", "/Help"]
    _, got = scores(table, paths)
    assert got == {
        "/contact": 111.0, "/about-us": 101.0, "/about/team": 1.5, "/company/global/contact-us": 110.0,
        "/about-us/contact-support-team": 100.5, "/contacto": 111.0, "/contactez-nous": 111.0, "/kontakt": 111.0, "/contatti": 111.0, "/Help": 2.0}


def test_top_keeps_input_order_of_equal_scores(table):
    df, _ = scores(table, ["/about-us", "/kontakt", "/contact"] + [f"/help/{i}" for i in range(40)])
    top = C.top_candidates(C.score_contact_urls(df), ["site"], k=5).orderBy("rank").collect()
    assert [r.url[12:] for r in top] == ["/kontakt", "/contact", "/about-us", "/help/0", "/help/1"]
    assert C.top_candidates(C.score_contact_urls(df), ["site"]).count() == 20


def pages(table, n, hits):
    return table([("s", i + 1, (i + 1) in hits) for i in range(n)], "site string, rank int, has_email boolean")


def test_early_stop(table):
    def kept(n, hits, wave, least):
        return sorted(r["rank"] for r in C.early_stop(pages(table, n, hits), ["site"], wave, least).collect())

    assert kept(6, {1}, 4, 3) == [1, 2, 3, 4]
    assert kept(5, {1}, 1, 3) == [1, 2, 3]
    assert kept(7, set(), 4, 3) == list(range(1, 8))


def test_reachable_gate(table):
    sites = table([("a",), ("b",), ("c",)], "site string")
    probe = table([("a", 500), ("b", None)], "site string, status int")
    assert {r.site: r.reachable for r in C.reachable_gate(sites, probe).collect()} == {"a": True, "b": False, "c": False}


def test_top_k_matches_brute_force_on_a_hot_key(table):
    rows = [("hot" if i % 3 else f"k{i % 7}", (i * 7919) % 1000, i) for i in range(3000)]
    df = table(rows, "k string, v int, i int")
    got = skew.top_k(df, ["k"], [F.col("v").desc(), F.col("i")], 4)
    assert got._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2  # before the shuffle and after
    want = set()
    for k in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))
        want |= {(k, r[1], r[2], n + 1) for n, r in enumerate(ordered[:4])}
    assert {tuple(r) for r in got.collect()} == want


def test_previous_in_time_matches_brute_force(table):
    from datetime import datetime, timedelta, timezone
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [("hot" if i % 3 else f"k{i % 5}", start + timedelta(seconds=(i * 613) % 9000), i) for i in range(1500)]
    df = table(rows, "k string, at timestamp, i int")
    got = {r.i: r.prev_i for r in skew.previous_in_time(df, ["k"], "at", ["i"], ["i"], slice_seconds=60).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        last = None
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            want[r[2]], last = last, r[2]
    assert got == want


def test_position_in_key_is_a_numbering(table):
    rows = [("d", i % 5, f"s{i}") for i in range(400)] + [("e", 1, "x")]
    got = skew.position_in_key(table(rows, "domain string, rank int, url string"), ["domain"], ["rank"], ["url"]).collect()
    d = sorted((r for r in got if r.domain == "d"), key=lambda r: r.position)
    assert [r.position for r in d] == list(range(1, 401))
    assert [r["rank"] for r in d] == sorted(r["rank"] for r in d)
