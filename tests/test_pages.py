import re

from pyspark.sql import functions as F

from sitesignal import fixed_values as fv
from sitesignal.functions import signals as S
from sitesignal.functions.page_scan import hint_pattern, scan, scan_page
from sitesignal.operators.candidates import all_links, footer_links, second_hop_links
from sitesignal.operators.extraction import page_signals

HINT = hint_pattern(fv.CONTACT_KEYWORDS)


def signals(table, html, status=200):
    return page_signals(table([("u", html, status)], "url string, html string, status int"), keep=["url"]).first()


def emails(table, html):
    return signals(table, html).emails


def test_mailto_and_text(table):
    r = signals(table, '<a href="mailto:kasse@kupfer-werk.net?cc=z">Schreiben</a><p>sonst lager@teich.eu</p>')
    assert r.emails == ["kasse@kupfer-werk.net", "lager@teich.eu"] and r.mailto_emails == ["kasse@kupfer-werk.net"]
    assert signals(table, "<p>Post an lager@teich.eu</p>").mailto_emails == []


def test_scripts_do_not_leak(table):
    assert emails(table, '<script>var x="\\u003ew@ufer.net"; a="stumm@skript.net"</script><style>r@stil.net</style><footer>w@ufer.net</footer>') == ["w@ufer.net"]


def test_attributes_comments_and_split_text(table):
    assert emails(table, '<div data-mail="attr@x.io"></div><!-- note@x.io --><p>info<b>@x.io</b></p>') == ["attr@x.io", "note@x.io"]
    assert emails(table, "<p>write a&#64;x.io</p><john@angle.org>") == ["a@x.io", "john@angle.org"]
    # a stray end tag leaves neighbouring text joined in the markup
    assert emails(table, "<p>info</i>@joined.io</p>") == ["info@joined.io"]


def test_json_scripts(table):
    page = '<script id="__NEXT_DATA__">{"page":{"reply":["lager@teich.eu"]}}</script>'
    assert emails(table, page) == ["lager@teich.eu"]
    assert emails(table, '<script type="application/ld+json">{"seller":{"email":"kasse@ufer.net"},"key@k.io":1}</script>') == ["kasse@ufer.net"]
    assert emails(table, '<script type="application/json">{"u":[[{"v":[0,{"w":"tief@ufer.net"}]}]]}</script>') == ["tief@ufer.net"]
    assert emails(table, '<script type="application/json">{"u": kasse@ufer.net</script><script>var a="c@d.io"</script>') == []


def test_phones_whatsapp_social(table):
    r = signals(table, '<a href="tel:+498912345670?x">c</a><p>Werk: +1 (555) 765-4321, werktags.</p><p>Stand 2023-11-30, 87,20 EUR, Nr. 31415926.</p>')
    assert r.phones == ["+1 (555) 765-4321", "+498912345670"]
    r = signals(table, '<a href="https://wa.me/498900011122">w</a> https://api.whatsapp.com/send?phone=498900011122&text=moin https://www.whatsapp.com/send?x')
    assert r.whatsapp == ["https://api.whatsapp.com/send?phone=498900011122&text=moin", "https://wa.me/498900011122"]
    hrefs = ["https://www.instagram.com/kupferwerk/", "https://www.facebook.com/sharer.php?u=x", "https://linkedin.com/company/x", "https://linkedin.com/jobs/x",
             "https://x.com/me", "https://twitter.com/share?url=x", "https://facebook.com/a/b"]
    r = signals(table, "".join(f'<a href="{h}">x</a>' for h in hrefs))
    assert r.social == ["https://linkedin.com/company/x", "https://twitter.com/share?url=x", "https://www.instagram.com/kupferwerk/", "https://x.com/me"]


def test_block_pages(table, each):
    pages = ['<div class="cf-browser-verification">', "<h1>Access Denied</h1> Reference #18.2f", '<div id="px-captcha">', "Access Denied: you need to log in first.", "",
             "Attention Required! | Cloudflare", "Please verify you are a human PerimeterX"]
    assert each(pages, S.block_vendor("v")) == ["cloudflare", "akamai", "perimeterx", "", "", "cloudflare", "perimeterx"]
    r = signals(table, "Access Denied Reference #1 a@x.io", status=403)
    assert (r.fetched, r.blocked_by, r.emails, r.metadata.page_title) == (False, "akamai", [], "")


def test_forms(table):
    def form(html):
        return signals(table, html).has_contact_form

    assert form('<form id="wpcf7-form-123"></form>') and form('<form class="hs-form  stacked"></form>')
    assert form('<form><div><input type="EMAIL"><textarea></textarea></div></form>') and form('<form><input name="your-email"><textarea></form>')
    assert not form('<form><input type="email"></form><textarea></textarea>') and not form("<p>none</p>")
    assert form('<form action="x"><form name="y"><input type=email><textarea></textarea>')


def test_metadata(table):
    m = signals(table, '<title> Kupferwerk, Start </title><title>second</title><meta name="Description" content=" Rohre und Bleche "><meta property="og:title" content="Kupferwerk">'
                       '<meta property="og:description" content="Seit 1912">').metadata
    assert tuple(m) == ("Kupferwerk, Start", "Rohre und Bleche", "Kupferwerk", "Seit 1912")
    assert tuple(signals(table, "<p>x</p>").metadata) == ("", "", "", "")


def test_visible_text():
    page = scan_page("<html><body><p>a <b>b</b><br>c<p>&amp; d<!-- no --><template>hid</template><script>x</script>", HINT)
    assert page["text"] == "a b c & d"
    assert scan_page("<![CDATA[ seen@x.io ]]><p>y", HINT)["text"] == "seen@x.io y"
    assert scan_page("", HINT)["text"] == "" and scan_page("<", HINT)["text"] in ("", "<")


def brute_hints(html):
    """Link hints found link by link from the whole text between open and close."""
    return [(a["href"], a["hinted"]) for a in scan_page(html, HINT)["anchors"]]


def test_hinted_links():
    assert brute_hints('<a href="/x">Get in <b>tou</b>ch</a><a href="/y">con<i>tact</i></a><a href="/About">z</a><a href="/q">q</a><a name="n">help</a>') == [
        ("/x", False), ("/y", True), ("/About", True), ("/q", False)]
    nested = '<a href="/1">pre <a href="/2">con<a href="/3">tact</a> more'
    assert brute_hints(nested) == [("/1", True), ("/2", True), ("/3", False)]
    many = "".join(f'<a href="/{i}">x' for i in range(3000)) + "contact"
    assert all(h for _, h in brute_hints(many))


def test_footer_and_second_hop(table):
    html = ('<nav><a href="/team">Team</a><a href="/contact">c</a></nav><footer><a href="about-us">x</a><a href="mailto:help@x.io">m</a><a href="/z">z</a></footer>'
            '<footer><a href="/support">s</a></footer><a href="https://www.x.io/other">o</a><a href="/blog/a">b</a><a href="/a/b/c">d</a><a href="/p/q">pq</a><a href="/team">t</a><a href="http://[bad">e</a>')
    df = table([("https://x.io", html)], "site string, html string").withColumn("page", scan("html"))
    got = df.select(footer_links(F.col("site"), F.col("page")).alias("f"),
                    second_hop_links(F.col("site"), all_links(F.col("site"), F.col("page")), F.array(F.lit("https://x.io/contact"))).alias("s")).first()
    assert got.f == ["https://x.io/about-us", "mailto:help@x.io"]
    assert got.s == ["https://x.io/team", "https://x.io/about-us", "https://x.io/z", "https://x.io/support", "https://x.io/p/q"]
    plain = table([("https://x.io", "<a href='/kontakt'>k</a><a href='/kontakt'>k</a>")], "site string, html string").withColumn("page", scan("html"))
    assert plain.select(footer_links(F.col("site"), F.col("page"))).first()[0] == ["https://x.io/kontakt"]


def test_pages_are_scanned_once(table):
    df = page_signals(table([("u", "x", 200)], "url string, html string, status int"), keep=["url"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("ArrowEvalPython", plan)) == 1


def test_fields_of_many_pages_are_packed_in_slices(monkeypatch):
    """The fields held as Python objects stay within a slice, however many pages come at once."""
    import pyarrow as pa

    from sitesignal.functions import page_scan

    held = []

    def packed(rows, type):
        held.append(sum(len(r["text"]) for r in rows if r))
        return pa.array(rows, type=type)

    monkeypatch.setattr(page_scan, "pa", type("Arrow", (), {"array": staticmethod(packed), "concat_arrays": pa.concat_arrays}))
    pages = [None, "", *[f"<p>{'word ' * 1000}{i}</p><a href='/c{i}'>contact</a>" for i in range(600)], None]
    found = page_scan.scan_array(pa.array(pages), HINT)
    assert len(held) > 2 and max(held) <= page_scan.SLICE_CHARS + 6000
    assert found.to_pylist() == [None if p is None else scan_page(p, HINT) for p in pages]
    assert len(page_scan.scan_array(pa.array([], pa.string()), HINT)) == 0


def test_page_batches_leave_the_session_as_it_was(spark):
    from sitesignal.session import BATCH_BYTES, BATCH_ROWS, PAGE_BATCH_BYTES, page_batches

    before = [spark.conf.get(k, None) for k in (BATCH_ROWS, BATCH_BYTES)]
    with page_batches(spark):
        assert [spark.conf.get(k) for k in (BATCH_ROWS, BATCH_BYTES)] == ["1000", str(PAGE_BATCH_BYTES)]
    assert [spark.conf.get(k, None) for k in (BATCH_ROWS, BATCH_BYTES)] == before
