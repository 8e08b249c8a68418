from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from sitesignal import fixed_values as fv
from sitesignal.operators import fetchlog as H
from sitesignal.operators import rollup as G

PAGE = ("site string, url string, rank int, fetched boolean, emails array<string>, mailto_emails array<string>, phones array<string>, "
        "whatsapp array<string>, social array<string>, blocked_by string, has_contact_form boolean, "
        "metadata struct<page_title:string,meta_description:string,og_title:string,og_description:string>")
RESULT = ("input_url string, domain string, emails array<string>, source_pages array<string>, method string, error string, fetch_failed boolean, "
          "phones array<string>, whatsapp_links array<string>, social_links array<string>, base_url string, pages_checked array<string>, blocked_by string, "
          "has_contact_form boolean, page_title string, meta_description string, og_title string, og_description string, mailto_emails array<string>")


def page(url, rank, fetched=True, emails=(), blocked="", form=False, title="", site="s"):
    return (site, url, rank, fetched, list(emails), [], [], [], [], blocked, form, (title, "", "", ""))


def result(url="u", emails=(), method="sitemap", failed=False, phones=(), blocked="", form=False, domain="x.com", mailto=(), error="", pages=(), title=""):
    return (url, domain, list(emails), [], method, error, failed, list(phones), [], [], "https://" + domain, list(pages), blocked, form, title, "", "", "", list(mailto))


def test_rollup(table):
    rows = [page("a", 1, False, blocked=""), page("b", 2, emails=["e@x.io"], title=""), page("c", 3, blocked="akamai", form=True, title="T"),
            page("d", 4, emails=["e@x.io", "a@x.io"], blocked="cloudflare")]
    for salts in (1, 16):
        r = G.rollup_site(table(rows, PAGE), ["site"], salts=salts).first()
        assert (r.emails, r.source_pages, r.pages_ok, r.pages_failed) == (["a@x.io", "e@x.io"], ["b", "d"], 3, 1)
        assert (r.blocked_by, r.has_contact_form, r.page_title) == ("akamai", True, "")
    assert G.rollup_site(table(rows, PAGE), ["site"], metadata="fields").first().page_title == "T"


def test_first_title_wins(table):
    rows = [page("b", 2, title="Second"), page("a", 1, title="First")]
    assert G.rollup_site(table(rows, PAGE), ["site"]).first().page_title == "First"


def test_merge_passes(table):
    one = G.rollup_site(table([page("a", 1, emails=["a@x.io"], title="")], PAGE), ["site"])
    two = G.rollup_site(table([page("b", 1, emails=["b@x.io"], title="Later", blocked="akamai", form=True), page("c", 2, False)], PAGE), ["site"])
    r = G.merge_passes(one, two, ["site"]).first()
    assert (r.emails, r.page_title, r.blocked_by, r.has_contact_form, r.pages_ok, r.pages_failed) == (["a@x.io", "b@x.io"], "Later", "akamai", True, 2, 1)


def test_empty_status(table):
    df = table([([], 0, 3), ([], 3, 0), ([], 1, 2), ([], 0, 0), (["a@b.io"], 0, 1)], "e array<string>, ok bigint, bad bigint")
    failed, error = G.empty_status(F.col("e"), F.col("ok"), F.col("bad"))
    got = {(tuple(r.e), r.ok, r.bad): (r.f, r.m) for r in df.select("*", failed.alias("f"), error.alias("m")).collect()}
    assert got[((), 0, 3)] == (True, 'pages failed to fetch (0 of 3 candidate page(s) returned a response — not a genuine "no email" result)')
    assert got[((), 3, 0)] == (False, "no emails found on checked pages")
    assert not got[((), 1, 2)][0] and not got[((), 0, 0)][0] and got[(("a@b.io",), 0, 1)] == (False, "")


def test_salvage(table):
    rows = [result("kept", phones=["+1"]), result("email", emails=["a@x.com"], phones=["+1"]), result("failed", failed=True, phones=["+1"])]
    assert {r.input_url: r.phones for r in G.salvage_gate(table(rows, RESULT)).collect()} == {"kept": ["+1"], "email": [], "failed": []}


def test_categories_and_summary(table):
    want = {"email": ("email_found", dict(emails=["a@x.com"])), "none": ("connection_failed", dict(method="none")), "blank": ("connection_failed", dict(method="")),
            "failed": ("connection_failed", dict(failed=True)), "phone": ("salvage_only", dict(phones=["+1"])), "nothing": ("genuine_no_result", {}),
            "blocked": ("permanently_blocked", dict(blocked="akamai", method="none")), "form": ("has_contact_form", dict(form=True)),
            "both": ("email_found", dict(emails=["a@x.com"], blocked="akamai")), "phone+form": ("salvage_only", dict(phones=["+1"], form=True))}
    df = G.categorize(table([result(k, **v[1]) for k, v in want.items()], RESULT))
    assert {r.input_url: r.category for r in df.collect()} == {k: v[0] for k, v in want.items()}
    assert set(v[0] for v in want.values()) == set(fv.CATEGORIES)
    s = G.summarize(df).first().asDict()
    assert s == {"total": 10, "email_found": 2, "connection_failed": 3, "salvage_only": 2, "genuine_no_result": 1, "permanently_blocked": 1, "has_contact_form": 1}
    assert set(G.summarize(df.filter("false")).first().asDict().values()) == {0}


def test_retry_and_low_quality(table):
    rows = [result("none", method="none"), result("failed", failed=True), result("blocked", method="none", blocked="akamai"), result("ok"), result("blank", method="")]
    assert sorted(r.input_url for r in G.retry_targets(table(rows, RESULT)).collect()) == ["failed", "none"]
    rows = [result("empty"), result("own", emails=["support@x.com"]), result("third", emails=["info@other.org"]), result("unclear", emails=["xq7z@x.com"])]
    df = table(rows, RESULT)
    assert sorted(r.input_url for r in G.low_quality(df).collect()) == ["third", "unclear"]
    assert [(r.input_url, r.pass_order) for r in G.second_pass_targets(df).orderBy("pass_order", "input_url").collect()] == [("empty", 0), ("third", 1), ("unclear", 1)]


def test_flat_row(table):
    df = table([result("u", emails=["support@x.com", "info@partner.com", "legal@x.com"], phones=["+2", "+1"], form=True, title="T"), result("v")], RESULT)
    flat = G.flatten_result(df)
    assert flat.columns == fv.RESULT_COLUMNS
    u, v = flat.orderBy("input_url").collect()
    assert (u.primary_email, u.primary_role, u.own_domain_emails, u.other_domain_emails, u.phone, u.has_contact_form) == (
        "support@x.com", "support", "support@x.com; legal@x.com", "info@partner.com", "+1; +2", "True")
    assert (v.primary_email, v.primary_role, v.own_domain_emails, v.has_contact_form) == ("", "", "", "False")
    third = G.flatten_result(table([result("u", emails=["hello@partner.com"])], RESULT)).first()
    assert (third.primary_email, third.primary_role) == ("hello@partner.com", "general")
    hashed = G.flatten_result(table([result("u", emails=["jane.doe1@x.com", "jane@x.com"])], RESULT), personal_salt="s").first()
    assert "jane@" not in hashed.own_domain_emails and hashed.own_domain_emails.count("@x.com") == 2 and hashed.primary_role == "personal"


def test_latest_and_resume(table):
    rows = table([("a", "old", 1), ("b", "x", 2), ("a", "new", 3)], "input_url string, content string, seq bigint")
    assert [(r.input_url, r.content, r.first_seq) for r in G.latest_per_target(rows).orderBy("first_seq").collect()] == [("a", "new", 1), ("b", "x", 2)]
    targets = table([("a",), ("c",)], "input_url string")
    assert [r.input_url for r in G.resume_remaining(targets, rows).collect()] == ["c"]


def test_trend_and_counters(table):
    history = table([(datetime(2024, 1, d), 10, d) for d in range(1, 25)], "timestamp timestamp, total bigint, email_found bigint")
    got = G.hit_rate_trend(history, 3).collect()
    assert [r.email_found for r in got] == [22, 23, 24] and got[0].hit_rate_change is None and abs(got[1].hit_rate_change - 0.1) < 1e-9
    c = G.run_counters(table([result("a", emails=["a@x.com"]), result("b", error="e")], RESULT), total=10, elapsed_seconds=4.0).first()
    assert (c.done, c.with_email, c.errors, c.rate, c.eta_seconds) == (2, 1, 1, 0.5, 16.0)


T0 = datetime(2024, 1, 3, 10, 0, tzinfo=timezone.utc)


def test_retry_after(each):
    now = F.lit(T0).cast("timestamp")
    values = [None, "", "  ", "12", " 7 ", "Wed, 03 Jan 2024 09:00:00 GMT", "Wed, 03 Jan 2024 10:00:30 GMT", "03 Jan 2024 12:00:10 +0200", "soon", "-5", "1.5"]
    assert each(values, H.retry_after_seconds(F.col("v"), now)) == [None, None, None, 12.0, 7.0, 0.0, 30.0, 10.0, None, None, None]


def test_backoff_and_outcome(table, each):
    assert each([0, 1, 2, 3, 4, 5, 10], H.backoff_ceiling(F.col("v")), "v int") == [1.0, 2.0, 4.0, 8.0, 10.0, 10.0, 10.0]
    log = table([("a", 0, 503), ("a", 1, 200), ("b", 0, None), ("c", 2, 503), ("d", 0, 404), ("e", 1, 429)], "url string, attempt int, status int")
    assert {r.url: r.outcome for r in H.fetch_outcome(log).collect()} == {"a": "ok", "b": "retryable", "c": "failed", "d": "failed", "e": "retryable"}


def test_audits(table):
    log = table([("u", "d", 0, 500, None, T0), ("u", "d", 1, 429, "30", T0 + timedelta(seconds=1.2)), ("u", "d", 2, 200, None, T0 + timedelta(seconds=40)),
                 ("w", "d", 0, 503, "30", T0 + timedelta(seconds=40.2)), ("w", "d", 1, 200, None, T0 + timedelta(seconds=50.2))],
                "url string, domain string, attempt int, status int, retry_after string, requested_at timestamp")
    back = {(r.url, r.attempt): (r.waited, r.ceiling, r.excess) for r in H.backoff_audit(log).collect()}
    # the wait a 429 asked for is honoured up to its cap; a 503 has no say
    assert back == {("u", 1): (1.2, 1.5, False), ("u", 2): (38.8, 15.5, True), ("w", 1): (10.0, 1.5, True)}
    gaps = [(round(r.gap, 3) if r.gap is not None else None, r.too_soon) for r in H.politeness_audit(log).orderBy("requested_at").collect()]
    assert gaps == [(None, False), (1.2, False), (38.8, False), (0.2, True), (10.0, False)]
    wide = H.politeness_audit(log, table([("d", 5.0)], "domain string, min_interval double"))
    assert sum(r.too_soon for r in wide.collect()) == 2


def test_schedule(table):
    rows = table([("d", "s", "u1", 1), ("d", "s", "u2", 2), ("d", "t", "u1", 1)], "domain string, site string, url string, rank int")
    got = H.crawl_schedule(rows, table([("d", 2.0)], "domain string, min_interval double")).orderBy("position").collect()
    assert [(r.position, r.start_seconds) for r in got] == [(1, 0.0), (2, 2.0), (3, 4.0)] and got[2].url == "u2"


def test_schedule_of_one_hot_domain(spark):
    rows = spark.range(3000).selectExpr("if(id % 10 = 0, 'd' || id % 7, 'hot') AS domain", "'s' || id % 40 AS site", "'u' || id AS url", "cast(id % 5 AS int) AS rank")
    rows = rows.unionByName(rows.limit(30))  # repeated rows have places of their own
    ranked = {}
    for r in sorted(rows.collect(), key=lambda r: (r.domain, r.rank, r.site, r.url)):
        ranked.setdefault(r.domain, []).append((r.rank, r.site, r.url))
    got = {}
    for r in H.crawl_schedule(rows.repartition(7)).collect():
        got.setdefault(r.domain, []).append((r.position, r.rank, r.site, r.url))
    assert {d: [x[1:] for x in sorted(v)] for d, v in got.items()} == ranked
    assert all(sorted(x[0] for x in v) == list(range(1, len(v) + 1)) for v in got.values())
    assert H.crawl_schedule(rows.limit(0)).count() == 0
