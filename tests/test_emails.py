import pytest
from pyspark.sql import functions as F

from sitesignal.functions import emails as E


def protect(address, key=0x42):
    return bytes([key] + [b ^ key for b in address.encode()]).hex()


def test_plain_and_obfuscated(each):
    assert each(["Bestellung: order-desk+eu@kupfer-werk.net, danke", "nichts"], E.plain_emails("v")) == [["order-desk+eu@kupfer-werk.net"], []]
    texts = ["post [at] kupfer-werk [dot] net", "post(at)kupfer-werk(dot)net", "Post AT Kupfer-Werk DOT net", "shop @ teich dot com dot au",
             "w at x.y dot io", "the cat sat on a dot", "lena [at] talheim.org"]
    rebuilt = [["post@kupfer-werk.net"]] * 3 + [["shop@teich.com.au"], ["w@x.y.io"]]
    assert each(texts, E.obfuscated_emails("v", strict=True)) == [*rebuilt, [], []]
    assert each(texts[:5], E.obfuscated_emails("v")) == rebuilt
    # without brackets or blanks, "at" and "dot" inside ordinary words count in the loose form only
    assert each(["plateau adoted"], E.obfuscated_emails("v", strict=True)) == [[]]


def test_protected(each):
    assert each(["zz9", "7f", "7f0", protect("zoë@ufer.net"), protect("k@l.eu", 0)], E.decode_protected("v")) == [
        None, None, None, "zoë@ufer.net", "k@l.eu"]
    assert each(["42ff"], E.decode_protected("v")) == [None]  # no UTF-8
    page = f'<i data-cfemail="{protect("kasse@ufer.net", 0x9c)}">x</i><a href="/cdn-cgi/l/email-protection#{protect("lager@ufer.net", 0x17)}">y</a>'
    assert each([page, ""], E.protected_emails("v")) == [["kasse@ufer.net", "lager@ufer.net"], []]


@pytest.fixture
def valid(each):
    return lambda addresses: each(addresses, E.is_valid_email("v"))


def test_validity(valid):
    good = ["kasse@ufer.net", "Lager@Ufer.NET", " q7@r8.eu; ", "tests@ufer.net", "k@notexample.com.br", "png@ufer.net"]
    assert valid(good) == [True] * len(good)
    by_rule = {
        "reserved or blocked domain": ["k@example.org", "k@example.museum", "k@w3.org", "k@deep.sub.schema.org"],
        "placeholder local part": ["youremail@ufer.net", "YourName@ufer.net", "donotreply@ufer.net"],
        "file name": ["banner@3x.webp", "pack@3.1.r9.wasm", "icon@2x.svg"],
        "rest of a link": ["kasse@ufer.net?cc=w", "kasse@ufer.net&x", "kasse@ufer.net/y"],
        "escape in front": ["u00e9@ufer.net"],
        "no address": ["kasse.ufer.net", "@ufer.net", "kasse@", ""],
    }
    for rule, bad in by_rule.items():
        assert valid(bad) == [False] * len(bad), rule


def test_valid_distinct(each):
    got = each([["Z@ufer.net", "z@ufer.net", "k@example.org", "b@ufer.net"]], E.valid_distinct("v"), "v array<string>")
    assert got == [["b@ufer.net", "z@ufer.net"]]


def test_mailto(each):
    hrefs = ["mailto:Kasse@Ufer.net", "MailTo:  w@r8.eu  ?cc=z", "tel:1", "mailto:", "mailto:?body=y"]
    assert each([hrefs], E.mailto_addresses("v"), "v array<string>") == [["kasse@ufer.net", "w@r8.eu"]]


def test_ownership(table):
    cases = [("a@ufer.net", "ufer.net", True), ("a@post.ufer.net", "ufer.net", True), ("a@UFER.net", "ufer.NET", True),
             ("a@kupfer.org", "kupfer.net", True),  # one brand, two endings
             ("a@meinkupfer.com", "kupfer.de", True),  # contains the brand
             ("a@teichgmbh.com", "teich.eu", True), ("a@teich-bau.com", "teich.eu", True), ("a@moos-bau.com", "moos.eu", False),
             ("a@moosbau.com", "moos.eu", True), ("a@moo.in", "moos.eu", False), ("a@anders.org", "ufer.net", False)]
    df = table([(e, d) for e, d, _ in cases], "e string, d string")
    assert {(r.e, r.d): r.own for r in df.select("e", "d", E.belongs_to("e", "d").alias("own")).collect()} == {(e, d): o for e, d, o in cases}


def test_roles(each):
    want = {"hola": "general", "reception": "general", "bizdev": "sales", "reseller": "sales", "eu+deals": "sales", "team-nord": "general",
            "lena.kurz": "personal", "ole_berg": "personal", "jörg": "personal", "hostmaster": "other", "newsletter": "other", "daemon": "other",
            "optout": "other", "r2d2x": "other", "k.berg": "other", "q": "other", "z" * 21: "other", "do-not-reply": "personal"}
    assert each([f"{k}@ufer.net" for k in want], E.email_role("v")) == list(want.values())


def test_ranking(table):
    def order(emails, mailto=()):
        df = table([(emails, list(mailto))], "emails array<string>, mailto array<string>")
        return [e.email for e in df.select(E.ranked("emails", "mailto").alias("r")).first().r]

    assert order(["deals@u.net", "q9z@u.net", "hola@u.net"]) == ["hola@u.net", "deals@u.net", "q9z@u.net"]
    assert order(["office@u.net", "ask@u.net"]) == ["ask@u.net", "office@u.net"]  # one role: by name
    assert order(["office@u.net", "ask@u.net"], ["office@u.net"]) == ["office@u.net", "ask@u.net"]  # linked ones first
    assert order(["deals@u.net", "ask@u.net"], ["deals@u.net"]) == ["ask@u.net", "deals@u.net"]  # the role comes before the link


def test_blocked_domain_table(table):
    from sitesignal.operators.attribution import drop_blocked_domains
    rows = table([("a@x.bad.org",), ("b@bad.org",), ("c@notbad.org",), ("d@good.io",)], "email string")
    blocked = table([("BAD.org",), ("zzz.io",)], "domain string")
    assert sorted(r.email for r in drop_blocked_domains(rows, blocked).collect()) == ["c@notbad.org", "d@good.io"]


def test_mx_and_personal(table):
    from sitesignal.operators.attribution import drop_personal, mx_filter
    sites = table([(1, ["a@dead.io", "info@ok.io", "sales@unknown.io"]), (2, ["x@dead.io"]), (3, ["jane.doe@ok.io", "info@ok.io"])], "k int, emails array<string>")
    mx = table([("dead.io", False), ("ok.io", True), ("unknown.io", None)], "domain string, has_mx boolean")
    assert {r.k: r.emails for r in mx_filter(sites, mx, "k").collect()} == {
        1: ["info@ok.io", "sales@unknown.io"], 2: [], 3: ["jane.doe@ok.io", "info@ok.io"]}
    assert drop_personal(sites).filter("k = 3").first().emails == ["info@ok.io"]
