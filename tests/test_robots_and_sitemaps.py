import gzip
import random
from urllib.robotparser import RobotFileParser

from pyspark.sql import functions as F

from sitesignal.operators import robots as R
from sitesignal.operators import sitemaps as M


def allowed(table, body, urls, enabled=True):
    policy = R.robots_policy(table([("h", body)] if body is not None else [], "host string, body string"))
    pages = table([("h", u) for u in urls], "host string, url string")
    kept = {r.url for r in R.robots_filter(pages, policy, enabled=enabled).collect()}
    return [u in kept for u in urls]


def test_rules(table):
    body = "User-agent: *\nDisallow: /private/\n"
    assert allowed(table, body, ["https://h/private/x", "https://h/contact"]) == [False, True]
    assert allowed(table, "User-agent: *\nDisallow: /", ["https://h/x"], enabled=False) == [True]
    assert allowed(table, None, ["https://h/x"]) == [True]
    assert allowed(table, "User-agent: *\nDisallow: /a\nAllow: /a/b", ["https://h/a/b"]) == [False]
    assert allowed(table, "User-agent: *\nAllow: /a/b\nDisallow: /a", ["https://h/a/b", "https://h/a"]) == [True, False]
    assert allowed(table, "User-agent: bot\nDisallow: /\n\nUser-agent: *\nDisallow:", ["https://h/x"]) == [True]
    assert allowed(table, "User-agent: *\nDisallow: /ä b\nDisallow: /q?x=", ["https://h/%C3%A4%20b/c", "https://h/q?x=1", "https://h/q"]) == [False, False, True]
    # a lone star is percent-quoted like any other path, so it fits only itself
    assert allowed(table, "User-agent: *\nDisallow: *", ["https://h/x", "https://h/*"]) == [True, True]
    assert allowed(table, "User-agent: *\nDisallow: /", ["https://h"]) == [False]


def test_first_group_wins(table):
    body = "User-agent: a\nUser-agent: *\nDisallow: /one\n\nUser-agent: *\nDisallow: /two\n"
    assert allowed(table, body, ["https://h/one", "https://h/two"]) == [False, True]


def test_delay_and_declared(table):
    bodies = table([("a", "User-agent: *\nCrawl-delay: 7\n"), ("b", "User-agent: *\nDisallow:\nCrawl-delay: 0.5"), ("c", "x")], "host string, body string")
    assert {r.host: r.crawl_delay for r in R.crawl_delay(bodies).collect()} == {"a": 7.0, "b": None, "c": None}
    assert {r.crawl_delay for r in R.crawl_delay(bodies, enabled=False).collect()} == {None}
    assert {r.host: r.min_interval for r in R.min_interval(R.robots_policy(bodies)).collect()} == {"a": 7.0, "b": 0.5, "c": 0.5}
    maps = table([("h", "Sitemap: https://h/1.xml\r\nSITEMAP:https://h/2.xml \n Sitemap: https://h/no.xml\nx")], "host string, body string")
    assert [(r.ord, r.sitemap_url) for r in R.declared_sitemaps(maps).orderBy("ord").collect()] == [(0, "https://h/1.xml"), (1, "https://h/2.xml")]


def stated(body):
    """Rules and delay of the group for every agent, by the standard library."""
    parser = RobotFileParser()
    parser.parse(body.splitlines())
    groups = parser.entries + ([parser.default_entry] if parser.default_entry else [])
    group = next((g for g in groups if g.applies_to("*")), None)
    if group is None:
        return [], None
    return [(r.allowance, r.path) for r in group.rulelines], None if group.delay is None else float(group.delay)


def test_groups_match_the_standard_library(table):
    dice = random.Random(11)
    names = ["User-agent", "user-AGENT ", " Disallow", "Allow", "ALLOW", "Crawl-delay", "Request-rate", "Sitemap", "Noindex", "User-agent", "Disallow"]
    values = ["*", "", "bot", "%2A", "/a", "/a/b?x=1", "/ä b", "/%7Ejoe", "/q?", "/p;", "/p;v=1;", "/a%23", "/a%2Fb", "7", "0.5", " 12 ", "1/5", "/x # note", "*.pdf$", "/a:b", "/%e4%b8%ad/", "/100%"]
    breaks = ["\n", "\n", "\n", "\r\n", "\r", "\n\n", "\n \n", "\n# c\n", "\x0b", "\u2028"]
    bodies = ["", "\n", "x", "User-agent: *", "Disallow: /", "User-agent:\nDisallow: /n\n\nUser-agent: *\nDisallow: /s", "User-agent: *\nCrawl-delay: 3\nCrawl-delay: x"]
    for _ in range(400):
        bodies.append("".join(f"{dice.choice(names)}{dice.choice([':', ': ', ' :', ''])}{dice.choice(values)}{dice.choice(breaks)}" for _ in range(dice.randrange(1, 14))))
    rows = R.robots_policy(table([(str(i), b) for i, b in enumerate(bodies)] + [("none", None)], "host string, body string")).collect()
    got = {r.host: ([(x.allow, x.path) for x in r.rules], r.crawl_delay) for r in rows}
    assert got.pop("none") == ([], None)
    wrong = [(b, got[str(i)], stated(b)) for i, b in enumerate(bodies) if got[str(i)] != stated(b)]
    assert not wrong, (len(wrong), wrong[:3])


def test_robots_need_no_python(table):
    policy = R.robots_policy(table([("h", "User-agent: *")], "host string, body string"))
    assert "Python" not in policy._jdf.queryExecution().executedPlan().toString()


def parsed(table, bodies):
    df = table([(str(i), bytearray(b)) for i, b in enumerate(bodies)], "url string, body binary")
    return {int(r.url): (r.children, r.pages) for r in M.parsed_sitemaps(df).collect()}


def test_sitemap_files(table):
    urlset = b'<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://h/a </loc></url><url><loc></loc></url><url><lastmod>1</lastmod></url></urlset>'
    got = parsed(table, [b"<sitemapindex><sitemap><loc>https://h/s.xml</loc></sitemap></sitemapindex>", urlset, gzip.compress(urlset), b"\x1f\x8bbroken", b"<urlset><url>", b""])
    assert got == {0: (["https://h/s.xml"], []), 1: ([], ["https://h/a"]), 2: ([], ["https://h/a"]), 3: ([], []), 4: ([], []), 5: ([], [])}


def test_sitemap_candidates(table):
    sites = table([("https://h",)], "site string")
    declared = table([("https://h", 0, "https://h/own.xml"), ("https://h", 1, "https://h/sitemap.xml")], "site string, ord int, sitemap_url string")
    got = [r.sitemap_url for r in M.sitemap_candidates(sites, declared).orderBy("ord").collect()]
    assert got == ["https://h/own.xml", "https://h/sitemap.xml", "https://h/sitemap_index.xml", "https://h/sitemap-index.xml", "https://h/wp-sitemap.xml",
                   "https://h/sitemap.xml.gz", "https://h/sitemap/sitemap.xml", "https://h/sitemaps.xml"]


def walk(files, seeds, max_depth=3, max_files=50, max_pages=20000):
    """The walk stated file by file."""
    seen, pages, count, frontier = set(), [], 0, list(dict.fromkeys(seeds))
    for depth in range(max_depth + 1):
        if not frontier or count >= max_files or len(pages) >= max_pages:
            break
        wave = frontier[:max_files - count]
        seen.update(wave)
        count += len(wave)
        following = []
        for u in wave:
            children, own = files.get(u, ([], []))
            pages += own[:max(0, max_pages - len(pages))]
            following += [c for c in children if c not in seen]
        frontier = list(dict.fromkeys(following))
    return pages


def run_walk(table, files, seeds, **limits):
    parsed_files = table([(u, c, p) for u, (c, p) in files.items()], "url string, children array<string>, pages array<string>")
    rows = table([("s", u, i) for i, u in enumerate(seeds)], "site string, sitemap_url string, ord int")
    return [r.url for r in M.walk_sitemaps(rows, parsed_files, **limits).orderBy("ord").collect()]


def test_walk_depth_and_repeats(table):
    files = {f"m{i}": ([f"m{i + 1}", "m0"], [f"p{i}", "same"]) for i in range(7)}
    assert run_walk(table, files, ["m0", "missing"]) == walk(files, ["m0", "missing"]) == ["p0", "same", "p1", "same", "p2", "same", "p3", "same"]


def test_walk_file_budget(table):
    files = {"root": ([f"c{i}" for i in range(60)], [])} | {f"c{i}": ([], [f"p{i}"]) for i in range(60)}
    got = run_walk(table, files, ["root"])
    assert got == walk(files, ["root"]) and len(got) == 49


def test_walk_page_budget(table):
    files = {"a": (["b", "d"], [f"a{i}" for i in range(6)]), "b": ([], [f"b{i}" for i in range(9)]), "d": (["e"], ["d1", "d2"]), "e": ([], ["e1"])}
    for cap in (5, 6, 10, 16, 17, 18):
        assert run_walk(table, files, ["a"], max_pages=cap) == walk(files, ["a"], max_pages=cap)
    big = {"x": ([], [f"p{i}" for i in range(20001)])}
    assert len(run_walk(table, big, ["x"])) == 20000


def test_dedupe_keeps_first(table):
    rows = table([("s", "u", 3), ("s", "v", 1), ("s", "u", 0)], "site string, url string, ord bigint")
    assert [(r.url, r.ord) for r in M.dedupe_pages(rows).orderBy("ord").collect()] == [("u", 0), ("v", 1)]
