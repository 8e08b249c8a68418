"""SQL stating the results of the registered queries, for the checking engine.

Each statement restates a rule from its definition over the same tables; it
shares only the derived inputs and the fixed values with the Spark code.
"""

from __future__ import annotations

import re

from sitesignal import fixed_values as fv
from sitesignal.catalog import inputs as I
from sitesignal.catalog.queries import OPEN_DOMAINS, WALK_LIMITS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def arr(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


EMAIL = q(fv.EMAIL_PATTERN)


# ---- scalar rules ---------------------------------------------------------------------


def valid(e: str, domains=OPEN_DOMAINS) -> str:
    t = f"trim(trim({e}, ' \t\n'), '.,;:')"
    local = f"lower(split_part({t}, '@', 1))"
    dom = f"lower(CASE WHEN position('@' IN {t}) > 0 THEN substr({t}, position('@' IN {t}) + 1) ELSE '' END)"
    return f"""({local} <> '' AND {dom} <> '' AND NOT regexp_matches({t}, '@[0-9]+x[.][a-zA-Z]{{1,5}}$')
      AND NOT regexp_matches({dom}, '[ \\t?=&#/%]') AND split_part({dom}, '.', 1) <> 'example'
      AND NOT list_contains(list_transform({arr(domains)}, lambda b: {dom} = b OR ends_with({dom}, '.' || b)), true)
      AND NOT list_contains({arr(fv.BLOCKED_LOCAL_PARTS)}, {local}) AND NOT regexp_matches({local}, '^u[0-9a-f]{{4}}$')
      AND NOT list_contains({arr(fv.ASSET_SUFFIXES)}, split_part({dom}, '.', -1)))"""


def role(e: str) -> str:
    local = f"lower(split_part({e}, '@', 1))"
    tokens = f"list_append(string_split_regex({local}, '[._+-]'), {local})"
    parts = f"list_filter(string_split_regex({local}, '[._-]'), lambda p: p <> '')"
    cases = " ".join(f"WHEN list_has_any({tokens}, {arr(words)}) THEN {q(name)}" for name, words in fv.ROLE_KEYWORDS)
    return f"""CASE {cases}
      WHEN len({parts}) >= 2 AND regexp_matches({parts}[1], '^\\pL{{2,}}$') AND regexp_matches({parts}[2], '^\\pL{{2,}}$') THEN 'personal'
      WHEN len({parts}) = 1 AND regexp_matches({parts}[1], '^\\pL{{2,20}}$') AND NOT list_contains({arr(fv.SYSTEM_LOCAL_PARTS)}, {parts}[1])
        THEN 'personal' ELSE 'other' END"""


def priority(r: str) -> str:
    return f"(list_position({arr(fv.ROLE_ORDER)}, {r}) - 1)"


def owned(e: str, d: str) -> str:
    dom, want = f"lower(split_part({e}, '@', -1))", f"lower({d})"
    a, b = f"split_part({dom}, '.', 1)", f"split_part({want}, '.', 1)"
    s = f"(CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END)"
    g = f"(CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END)"
    rest = f"substr({g}, length({s}) + 1)"
    return f"""({dom} = {want} OR ends_with({dom}, '.' || {want})
      OR (length({s}) >= 5 AND length({g}) <= 2.5 * length({s}) AND contains({g}, {s}))
      OR (length({s}) >= 4 AND starts_with({g}, {s}) AND {rest} <> '' AND NOT contains({rest}, '-') AND length({rest}) <= 15))"""


def obfuscated(text: str, pattern: str) -> str:
    p = q(pattern.replace("(?U)", ""))
    x = lambda i: f"regexp_extract(m, {p}, {i})"
    return f"""list_transform(regexp_extract_all({text}, {p}),
      lambda m: lower({x(1)} || '@' || {x(2)} || '.' || {x(3)} || CASE WHEN {x(4)} <> '' THEN '.' || {x(4)} ELSE '' END))"""


def decoded(h: str) -> str:
    byte = lambda i: f"CAST('0x' || substr({h}, 2 * ({i}) - 1, 2) AS INTEGER)"
    return f"array_to_string(list_transform(range(2, length({h}) // 2 + 1), lambda i: chr(xor({byte('i')}, {byte('1')}))), '')"


def vendor(html: str) -> str:
    cases = []
    for name, rules in fv.BLOCK_SIGNATURES:
        any_rule = " OR ".join("(" + " AND ".join(f"contains(lower({html}), {q(m)})" for m in rule) + ")" for rule in rules)
        cases.append(f"WHEN {any_rule} THEN {q(name)}")
    return f"CASE {' '.join(cases)} ELSE '' END"


def path_of(url: str) -> str:
    return f"regexp_replace(regexp_extract({url}, '^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"


def segments(path: str) -> str:
    return f"list_filter(string_split({path}, '/'), lambda s: s <> '')"


def tokens(path: str) -> str:
    return f"list_distinct(list_concat({segments(path)}, flatten(list_transform({segments(path)}, lambda s: string_split(s, '-')))))"


def score(path: str) -> str:
    seg, tok = segments(path), tokens(path)
    bonus = f"greatest(0, 3 - len({seg})) * 0.5"
    return f"""CASE WHEN list_has_any({tok}, {arr(fv.NEGATIVE_PATH_WORDS)}) THEN NULL
      WHEN regexp_matches({path}, '/[0-9]{{4}}/([0-9]{{1,2}}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)/') THEN NULL
      WHEN NOT list_has_any({tok}, {arr(fv.CONTACT_KEYWORDS)}) THEN NULL
      WHEN list_has_any({seg}, {arr(fv.HARD_CONTACT_KEYWORDS)})
        THEN CAST(100 + CASE WHEN list_has_any({seg}, {arr(fv.PRIMARY_CONTACT_KEYWORDS)}) THEN 10 ELSE 0 END + {bonus} AS DOUBLE)
      WHEN len({seg}) > 2 THEN NULL
      ELSE CAST(len(list_intersect({tok}, {arr(fv.CONTACT_KEYWORDS)})) + {bonus} AS DOUBLE) END"""


def joined(c: str, sep: str = " ") -> str:
    return f"array_to_string(list_sort({c}), {q(sep)})"


PROFILE = r"^https?://(www\.)?(facebook\.com/[A-Za-z0-9_.\-]+|instagram\.com/[A-Za-z0-9_.\-]+|linkedin\.com/(company|in)/[A-Za-z0-9_.\-]+|(twitter|x)\.com/[A-Za-z0-9_]+)/?(\?[^\"'<>\s]*)?$"
# a named reference is read without its semicolon too, when no letter or digit follows
CLOSED = "regexp_replace({x}, '&(amp|quot|lt|gt|copy|middot)([^;a-zA-Z0-9]|$)', '&\\1;\\2', 'g')"
TITLE = "trim(regexp_extract(html, '<title>(.*?)</title>', 1))"
TITLE = CLOSED.format(x=TITLE)
for _ref, _char in (("&quot;", '"'), ("&#x27;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    TITLE = f"replace({TITLE}, '{_ref}', '{_char}')"

PHONE = r"\+\d{1,3}[\s.\-]?\(?\d{1,4}\)?(?:[\s.\-]?\d{2,4}){2,4}"


# ---- shared steps -------------------------------------------------------------------------

CTES = {
    "sp": f"""SELECT page_id, host, 'https://' || host AS site, 'https://' || host || tail AS url, status, html || {I.SNIPPET_SQL} AS html
      FROM (SELECT page_id, html, {I.HOST_SQL} AS host, {I.TAIL_SQL} AS tail, {I.STATUS_SQL} AS status FROM pages)""",
    "cu": f"SELECT site, site || {I.CONTACT_PATH_SQL} AS url, page_id FROM sp",
    "scored": f"SELECT site, url, page_id, {score(path_of('lower(url)'))} AS score FROM cu",
    "ro": f"SELECT host, {I.ROBOTS_SQL} AS body FROM (SELECT DISTINCT host FROM sp) WHERE length(host) % 5 <> 0",
    "decl": """SELECT host, row_number() OVER (PARTITION BY host ORDER BY i) - 1 AS ord, trim(substr(line, 9)) AS sitemap_url
      FROM (SELECT host, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM ro)
      WHERE lower(line) LIKE 'sitemap:%'""",
    "seeds": f"""SELECT site, sitemap_url, min(ord) AS ord FROM (
        SELECT 'https://' || host AS site, sitemap_url, ord FROM decl
        UNION ALL SELECT site, site || path, 1000000000 + i - 1 FROM (SELECT DISTINCT site FROM sp),
          (SELECT unnest({arr(fv.COMMON_SITEMAP_PATHS)}) AS path, generate_subscripts({arr(fv.COMMON_SITEMAP_PATHS)}, 1) AS i))
      GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY site, sitemap_url"),
    "files": """SELECT 'https://maps.sample.net/' || page_id || '.xml' AS url,
        CASE WHEN page_id % 3 = 0 THEN list_transform([1, 2, 3], lambda k: 'https://maps.sample.net/' || (page_id + k) || '.xml') ELSE []::VARCHAR[] END AS children,
        CASE WHEN page_id % 3 = 0 OR page_id % 11 = 10 THEN []::VARCHAR[]
          ELSE ['https://' || host || '/contact', 'https://' || host || '/p/' || page_id, 'https://' || host || '/about-us?n=' || (page_id % 2)] END AS pages
      FROM sp UNION ALL
      SELECT site || '/sitemap.xml', ['https://maps.sample.net/' || min(page_id) || '.xml', 'https://maps.sample.net/' || max(page_id) || '.xml'], []::VARCHAR[]
      FROM sp GROUP BY site""",
    "markup": "SELECT *, regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs') AS bare FROM sp",
    "texts": f"""SELECT page_id, host, site, url, status, html, bare, array_to_string(list_filter(list_transform(string_split(
        regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', chr(1), 'gs'), '<!--.*?-->', chr(1), 'gs'), '<[^>]*>', chr(1), 'g'), chr(1)),
        lambda x: trim(replace(replace(replace(replace(replace(replace(replace({CLOSED.format(x='x')}, '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'),
          '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(32) || chr(10) || chr(9) || chr(13))), lambda x: x <> ''), ' ') AS text
      FROM markup""",
    "found": f"""SELECT *, CASE WHEN status <> 200 THEN []::VARCHAR[] ELSE list_concat(
        regexp_extract_all(bare, {EMAIL}),
        list_transform(regexp_extract_all(html, 'href="(mailto:[^"?]*)', 1), lambda m: substr(m, 8)),
        regexp_extract_all(regexp_extract(html, '<script type="application/ld.json">(.*?)</script>', 1), {EMAIL}),
        list_transform(regexp_extract_all(html, 'data-cfemail="([A-Fa-f0-9]+)"', 1), lambda h: {decoded('h')}),
        {obfuscated('text', fv.OBFUSCATED_EMAIL_PATTERN)}) END AS raw FROM texts""",
    "sig": f"""SELECT page_id, host, site, url, status, html, text, status = 200 AS fetched,
        list_filter(list_distinct(list_transform(raw, lambda e: lower(e))), lambda e: {valid('e')}) AS emails,
        CASE WHEN status <> 200 THEN []::VARCHAR[] ELSE list_filter(list_distinct(list_transform(
          regexp_extract_all(html, 'href="(mailto:[^"?]*)', 1), lambda m: lower(substr(m, 8)))), lambda e: {valid('e')}) END AS mailto,
        CASE WHEN status <> 200 THEN []::VARCHAR[] ELSE list_distinct(list_concat(
          list_transform(regexp_extract_all(html, 'href="tel:([^"]+)"', 1), lambda t: split_part(t, '?', 1)), regexp_extract_all(text, {q(PHONE)}))) END AS phones,
        CASE WHEN status <> 200 THEN []::VARCHAR[] ELSE list_distinct(regexp_extract_all(html, 'https?://wa[.]me/[0-9+]+')) END AS whatsapp,
        CASE WHEN status <> 200 THEN []::VARCHAR[] ELSE list_distinct(list_filter(list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda h: trim(h)),
          lambda h: regexp_matches(h, {q(PROFILE)}) AND NOT contains(h, 'sharer'))) END AS social,
        {vendor('html')} AS blocked_by,
        status = 200 AND page_id % 12 IN (6, 7) AS form,
        CASE WHEN status <> 200 THEN '' ELSE {TITLE} END AS page_title,
        CASE WHEN status = 200 AND page_id % 12 = 2 THEN 'About ' || host ELSE '' END AS meta_description,
        CASE WHEN status = 200 AND page_id % 12 = 7 THEN 'Shop' ELSE '' END AS og_title
      FROM found""",
    "roll": """SELECT site, host, list_sort(list_distinct(flatten(list(emails)))) AS emails, list_sort(list_distinct(flatten(list(mailto)))) AS mailto,
        list_sort(list_distinct(flatten(list(phones)))) AS phones, list_sort(list_distinct(flatten(list(whatsapp)))) AS whatsapp,
        list_sort(list_distinct(flatten(list(social)))) AS social,
        list_sort(coalesce(list(DISTINCT url) FILTER (len(emails) > 0), []::VARCHAR[])) AS source_pages,
        count(*) FILTER (fetched) AS ok, count(*) FILTER (NOT fetched) AS failed,
        coalesce(arg_min(blocked_by, page_id) FILTER (blocked_by <> ''), '') AS blocked_by, bool_or(form) AS form,
        coalesce(arg_min(page_title, page_id) FILTER (fetched), '') AS page_title,
        coalesce(arg_min(meta_description, page_id) FILTER (fetched), '') AS meta_description,
        coalesce(arg_min(og_title, page_id) FILTER (fetched), '') AS og_title
      FROM sig GROUP BY site, host""",
    "res": """SELECT *, CASE WHEN length(host) % 7 = 0 THEN 'none' WHEN length(host) % 7 = 1 THEN '' ELSE 'sitemap' END AS method,
        len(emails) = 0 AND ok = 0 AND failed > 0 AS fetch_failed,
        CASE WHEN len(emails) > 0 THEN '' WHEN ok = 0 AND failed > 0
          THEN 'pages failed to fetch (0 of ' || failed || ' candidate page(s) returned a response — not a genuine "no email" result)'
          ELSE 'no emails found on checked pages' END AS error FROM roll""",
    "res_open": """SELECT * REPLACE (CASE WHEN len(emails) = 0 AND NOT fetch_failed THEN phones ELSE []::VARCHAR[] END AS phones,
        CASE WHEN len(emails) = 0 AND NOT fetch_failed THEN whatsapp ELSE []::VARCHAR[] END AS whatsapp,
        CASE WHEN len(emails) = 0 AND NOT fetch_failed THEN social ELSE []::VARCHAR[] END AS social) FROM res""",
    "addr": f"""SELECT site, host, email, {role('email')} AS role, {owned('email', 'host')} AS is_own, list_contains(mailto, email) AS from_mailto
      FROM (SELECT site, host, mailto, unnest(emails) AS email FROM res)""",
    "placed": f"""SELECT *, row_number() OVER (PARTITION BY site, is_own ORDER BY {priority('role')}, NOT from_mailto, email) AS n FROM addr""",
    "lists": """SELECT site, coalesce(string_agg(email, '; ' ORDER BY n) FILTER (is_own), '') AS own,
        coalesce(string_agg(email, '; ' ORDER BY n) FILTER (NOT is_own), '') AS other,
        arg_min(email, CASE WHEN is_own THEN n ELSE n + 100000000 END) AS primary_email, arg_min(role, CASE WHEN is_own THEN n ELSE n + 100000000 END) AS primary_role
      FROM placed GROUP BY site""",
    "cat": """SELECT site, CASE WHEN len(emails) > 0 THEN 'email_found' WHEN blocked_by <> '' THEN 'permanently_blocked'
        WHEN method IN ('', 'none') OR fetch_failed THEN 'connection_failed' WHEN len(phones) + len(whatsapp) + len(social) > 0 THEN 'salvage_only'
        WHEN form THEN 'has_contact_form' ELSE 'genuine_no_result' END AS category FROM res_open""",
    "log": f"""SELECT 'https://d' || ((event_id // 3) % 40) || '.sample.net/p/' || (event_id // 3) AS url, 'd' || ((event_id // 3) % 40) || '.sample.net' AS domain,
        CAST(event_id % 3 AS INTEGER) AS attempt, {I.LOG_SQL['status']} AS status, {I.LOG_SQL['retry_after']} AS retry_after, epoch_us(ts) AS us, event_id
      FROM events""",
    "hist": """SELECT date_trunc('hour', ts) AS hour, count(*) AS total, count(*) FILTER (event_type = 'click') AS email_found FROM events GROUP BY 1""",
    "mixed": f"""SELECT doc_id, source || '.com' AS domain, (CASE doc_id % 16 WHEN 0 THEN 'info' WHEN 1 THEN 'sales.team' WHEN 2 THEN 'help'
        WHEN 3 THEN 'press-office' WHEN 4 THEN 'hr' WHEN 5 THEN 'billing' WHEN 6 THEN 'dpo' WHEN 7 THEN 'jane.doe' WHEN 8 THEN 'do-not-reply'
        WHEN 9 THEN 'webmaster' WHEN 10 THEN 'xq7z' WHEN 11 THEN 'alex' WHEN 12 THEN 'josé' WHEN 13 THEN 'Support+eu' WHEN 14 THEN 'j.smith'
        ELSE 'unsubscribe' END) || '@' || (CASE doc_id % 7 WHEN 0 THEN source || '.com' WHEN 1 THEN 'mail.' || source || '.com'
        WHEN 2 THEN 'make' || source || '.io' WHEN 3 THEN source || '-tutors.com' WHEN 4 THEN source || 'corp.net' WHEN 5 THEN 'partner.org'
        ELSE source || '.org' END) AS email FROM documents""",
    "linked": """SELECT page_id, site, host, html, ['/kontakt/' || page_id, '/imprint', 'https://' || host || '/team?x=' || page_id, '/a/b/c', '/blog/x'] AS added FROM sp""",
}

NEEDS = {
    "cu": ["sp"], "scored": ["cu"], "ro": ["sp"], "decl": ["ro"], "seeds": ["decl", "sp"], "files": ["sp"], "markup": ["sp"], "texts": ["markup"],
    "found": ["texts"], "sig": ["found"], "roll": ["sig"], "res": ["roll"], "res_open": ["res"], "addr": ["res"], "placed": ["addr"],
    "lists": ["placed"], "cat": ["res_open"], "linked": ["sp"],
}


def using(names: str, body: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body


def _walk(max_files: int, max_pages: int) -> str:
    """The bounded walk, wave by wave."""
    parts = []
    for w in range(4):
        if w == 0:
            frontier = "SELECT site, sitemap_url, ord, 0 AS f0, 0 AS p0 FROM seeds"
        else:
            before = " UNION ALL ".join(f"SELECT site, sitemap_url, take FROM done{i}" for i in range(w))
            frontier = f"""SELECT c.site, c.sitemap_url, c.ord, s.f0, s.p0 FROM
              (SELECT site, sitemap_url, min(file_no * 10000000000 + i) AS ord FROM (
                 SELECT site, file_no, unnest(children) AS sitemap_url, generate_subscripts(children, 1) AS i FROM done{w - 1}) GROUP BY site, sitemap_url) c
              JOIN (SELECT site, count(*) AS f0, sum(take) AS p0 FROM ({before}) GROUP BY site) s ON c.site = s.site
              WHERE s.f0 < {max_files} AND s.p0 < {max_pages}
                AND NOT EXISTS (SELECT 1 FROM ({before}) b WHERE b.site = c.site AND b.sitemap_url = c.sitemap_url)"""
        parts.append(f"""done{w} AS (SELECT site, sitemap_url, file_no, children, pages, greatest(0, least(n, {max_pages} - p0 - coalesce(sum(n) OVER
              (PARTITION BY site ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take
          FROM (SELECT x.*, f.children, f.pages, coalesce(len(f.pages), 0) AS n FROM
            (SELECT *, f0 + row_number() OVER (PARTITION BY site ORDER BY ord, sitemap_url) AS file_no FROM ({frontier})) x
            LEFT JOIN files f ON f.url = x.sitemap_url WHERE x.file_no <= {max_files}))""")
    every = " UNION ALL ".join(f"SELECT site, file_no, take, pages FROM done{i}" for i in range(4))
    walked = f"""walked AS (SELECT site, file_no, i - 1 AS pos, url FROM (
        SELECT site, file_no, take, unnest(pages) AS url, generate_subscripts(pages, 1) AS i FROM ({every}) WHERE pages IS NOT NULL) WHERE i <= take)"""
    return ",\n".join([*parts, walked])


def _with_walk(max_files: int, max_pages: int, body: str) -> str:
    return using("seeds files", "").rstrip() + ",\n" + _walk(max_files, max_pages) + "\n" + body


LEFTOVERS = """, read AS ({every}), known AS (SELECT site, sitemap_url FROM seeds UNION SELECT site, unnest(children) FROM read)
    SELECT r.site, (SELECT count(*) FROM known k WHERE k.site = r.site AND NOT EXISTS (SELECT 1 FROM read b WHERE b.site = k.site AND b.sitemap_url = k.sitemap_url)) AS files_left,
      sum(coalesce(len(r.pages), 0) - r.take)::BIGINT AS pages_left FROM read r GROUP BY r.site""".format(
    every=" UNION ALL ".join(f"SELECT site, sitemap_url, children, pages, take FROM done{i}" for i in range(4)))


LEVELS = """CASE length(host) % 3
    WHEN 0 THEN [{'allow': 0, 'path': '/de/'}, {'allow': 1, 'path': '/de/1'}]
    WHEN 1 THEN [{'allow': 1, 'path': '/fr/1'}, {'allow': 0, 'path': '/fr/'}, {'allow': 0, 'path': '/en/2'}]
    ELSE [{'allow': 1, 'path': ''}] END"""

FLAT = """SELECT r.site AS input_url, r.host AS domain, coalesce(l.primary_email, '') AS primary_email, coalesce(l.primary_role, '') AS primary_role,
    coalesce(l.own, '') AS own_domain_emails, coalesce(l.other, '') AS other_domain_emails, array_to_string(r.phones, '; ') AS phone,
    array_to_string(r.whatsapp, '; ') AS whatsapp, array_to_string(r.social, '; ') AS social_links, r.method,
    array_to_string(r.source_pages, '; ') AS source_pages, r.error, r.blocked_by, CASE WHEN r.form THEN 'True' ELSE 'False' END AS has_contact_form,
    r.page_title, r.meta_description, r.og_title, '' AS og_description
  FROM res_open r LEFT JOIN lists l ON l.site = r.site"""

HASHED = "sha256('pepper' || email) || '@' || lower(split_part(email, '@', -1))"

ORACLE = {
    "normalize_hosts": """SELECT page_id, base_url, regexp_replace(substr(base_url, 9), '^www[.]', '') AS domain,
        lower(split_part(regexp_replace(substr(base_url, 9), '^www[.]', ''), '.', 1)) AS brand FROM (
        SELECT page_id, 'https://' || CASE page_id % 5 WHEN 2 THEN 'user@' || h || ':8080' WHEN 3 THEN 'www.' || h WHEN 4 THEN '' ELSE h END AS base_url
        FROM (SELECT page_id, split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1) AS h FROM pages))""",
    "unparseable_targets": """SELECT DISTINCT CASE WHEN page_id % 4 = 0 THEN '/p/' || page_id ELSE '' END AS input_url, 'could not parse domain' AS error
        FROM pages WHERE page_id % 4 IN (0, 1)""",
    "url_tokens": using("cu", f"""SELECT page_id, path, len({segments('path')}) AS segments, {joined(tokens('path'))} AS tokens
        FROM (SELECT page_id, {path_of('lower(url)')} AS path FROM cu)"""),
    "rank_contact_urls": using("scored", "SELECT page_id, url, score FROM scored WHERE score IS NOT NULL"),
    "top_candidates": using("scored", """SELECT site, url, rank, score FROM (
        SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, page_id) AS rank FROM scored WHERE score IS NOT NULL) WHERE rank <= 3"""),
    "early_stop_pages": using("sp", """SELECT site, page_id, wave FROM (SELECT a.site, a.page_id, a.wave,
          (SELECT count(*) FROM w b WHERE b.site = a.site AND b.wave < a.wave AND b.page_id % 5 = 0) AS seen,
          (SELECT count(*) FROM w b WHERE b.site = a.site AND b.wave < a.wave) AS checked FROM w a)
        WHERE NOT (seen > 0 AND checked >= 3)""").replace("\nSELECT site, page_id, wave FROM (SELECT", """,
        w AS (SELECT site, page_id, (n - 1) // 2 AS wave FROM (SELECT site, page_id, row_number() OVER (PARTITION BY site ORDER BY page_id) AS n FROM sp) WHERE n <= 20)
        SELECT site, page_id, wave FROM (SELECT"""),
    "reachable_sites": using("sp", "SELECT site, CAST(bool_or(page_id % 3 = 0) AS INTEGER) AS reachable FROM sp GROUP BY site"),
    "footer_links": using("linked", """SELECT page_id, CAST(i - 1 AS BIGINT) AS ord, site || p AS url FROM (
        SELECT page_id, site, unnest(['/kontakt/' || page_id, '/imprint']) AS p, generate_subscripts([1, 2], 1) AS i FROM linked)"""),
    "second_hop_links": using("linked", f"""SELECT page_id, ord, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY depth, i) - 1 AS ord FROM (
        SELECT page_id, url, i, len({segments('path')}) AS depth FROM (
          SELECT page_id, url, min(i) AS i, lower(regexp_extract(url, '^https://[^/]*([^?#]*)', 1)) AS path FROM (
            SELECT page_id, host, site, i, CASE WHEN starts_with(h, 'http') THEN h WHEN h = '#' THEN site ELSE site || h END AS url FROM (
              SELECT page_id, host, site, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM (
                SELECT page_id, host, site, list_concat(regexp_extract_all(regexp_extract(html, '^(.*)<footer>', 1, 's'), 'href="([^"]*)"', 1), added,
                  list_filter(regexp_extract_all(regexp_extract(html, '<footer>(.*)$', 1, 's'), '<a href="([^"]*)"', 1), lambda x: true)) AS hs FROM linked)))
          WHERE (url = site OR starts_with(url, site || '/')) AND url <> site || '/imprint' GROUP BY page_id, url)
        WHERE len({segments('path')}) <= 2 AND NOT list_has_any({tokens('path')}, {arr(fv.NEGATIVE_PATH_WORDS)})
          AND NOT regexp_matches(path, '/[0-9]{{4}}/[0-9]{{1,2}}/'))) WHERE ord < 4"""),
    "robots_rules": using("ro", f"""SELECT host, CAST(i - 1 AS BIGINT) AS rule_ord, r.allow AS allow, r.path AS path FROM (
        SELECT host, unnest({LEVELS}) AS r, generate_subscripts({LEVELS}, 1) AS i FROM ro)"""),
    "robots_allowed": using("ro", f"""SELECT s.page_id, s.url, CASE WHEN r.host IS NULL THEN 1 ELSE coalesce(
          list_filter({LEVELS.replace('host', 's.host')}, lambda x: starts_with(regexp_extract(s.url, '^https://[^/]*(.*)$', 1), x.path))[1].allow, 1) END AS allowed
        FROM sp s LEFT JOIN ro r ON r.host = s.host"""),
    "crawl_delay": using("ro", "SELECT host, CASE WHEN length(host) % 3 = 0 THEN 7.0::DOUBLE END AS crawl_delay FROM ro"),
    "min_intervals": using("ro", "SELECT host, CASE WHEN length(host) % 3 = 0 THEN 7.0::DOUBLE ELSE 0.5::DOUBLE END AS min_interval FROM ro"),
    "declared_sitemaps": using("decl", "SELECT host, ord, sitemap_url FROM decl"),
    "sitemap_candidates": using("seeds", "SELECT site, sitemap_url, ord FROM seeds"),
    "sitemap_parse": using("files", """SELECT url, 'sitemap' AS kind, CAST(generate_subscripts(children, 1) - 1 AS BIGINT) AS ord, unnest(children) AS loc FROM files
        UNION ALL SELECT url, 'page', CAST(generate_subscripts(pages, 1) - 1 AS BIGINT), unnest(pages) FROM files"""),
    "sitemap_walk": _with_walk(WALK_LIMITS["max_files"], WALK_LIMITS["max_pages"], "SELECT site, url, file_no, pos FROM walked"),
    "sitemap_leftovers": _with_walk(50, 20000, "") + LEFTOVERS,
    "sitemap_leftovers_tight": _with_walk(WALK_LIMITS["max_files"], WALK_LIMITS["max_pages"], "") + LEFTOVERS,
    "sitemap_pages": _with_walk(50, 20000, "SELECT DISTINCT site, url FROM walked"),
    "usable_captures": using("sp", """SELECT page_id, CAST(status = 200 AS INTEGER) AS usable,
        CASE WHEN status = 200 THEN length(html) + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END ELSE 0 END AS n_chars FROM sp"""),
    "page_text": "WITH sp AS (SELECT page_id, '' AS host, '' AS site, url, 200 AS status, html FROM pages), markup AS (" + CTES["markup"]
        + "), texts AS (" + CTES["texts"] + ") SELECT page_id, md5(text) AS text_md5, length(text) AS n_chars FROM texts",
    "page_links": """SELECT page_id, CAST(i - 1 AS BIGINT) AS ord, href, 0 AS in_footer FROM (SELECT page_id, unnest(hs) AS href, generate_subscripts(hs, 1) AS i FROM (
        SELECT page_id, list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h: replace(h, '&amp;', '&')) AS hs FROM pages))""",
    "text_emails": f"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, {EMAIL}))) AS email FROM documents",
    "valid_emails": f"""SELECT DISTINCT doc_id, email, CAST({valid('email')} AS INTEGER) AS valid FROM (SELECT doc_id, unnest(list_append(
        regexp_extract_all(text, {EMAIL}), CASE doc_id % 9 WHEN 0 THEN 'banner@3x.webp' WHEN 1 THEN 'noreply@shop.io' WHEN 2 THEN 'a' || doc_id || '@sub.acme.com'
        WHEN 3 THEN 'u00e9@talheim.net' WHEN 4 THEN 'kontor@example.shop' WHEN 5 THEN 'Sales.' || doc_id || '@shop.io' WHEN 6 THEN 'w@laden.net?cc=z'
        WHEN 7 THEN 'pack@3.1.r' || doc_id || '.wasm' ELSE 'not-an-address' END)) AS email FROM documents)""",
    "blocked_domain_rows": """SELECT doc_id, 'c' || doc_id || '@mail.' || source || '-' || (doc_id % 25) || '.sample.org' AS email FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 25 % 3 = 0 AND b.source = d.source AND b.doc_id % 25 = d.doc_id % 25)""",
    "protected_emails": using("sp", f"""SELECT page_id, {decoded("regexp_extract(html, 'data-cfemail=.([A-Fa-f0-9]+)', 1)")} AS email
        FROM sp WHERE contains(html, 'data-cfemail')"""),
    "mailto_emails": using("sp", "SELECT page_id, lower(regexp_extract(html, 'mailto:([^?\"]*)', 1)) AS email FROM sp WHERE contains(html, 'mailto:')"),
    "json_emails": using("sp", f"""SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '<script type="application/ld.json">(.*?)</script>', 1), {EMAIL})) AS email FROM sp"""),
    "markup_emails": using("markup", f"SELECT page_id, unnest(list_distinct(regexp_extract_all(bare, {EMAIL}))) AS email FROM markup"),
    "page_emails": using("sig", "SELECT page_id, unnest(emails) AS email FROM sig"),
    "phones": using("sig", "SELECT page_id, unnest(phones) AS phone FROM sig"),
    "document_phones": f"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, {q(PHONE)}))) AS phone FROM documents",
    "whatsapp_links": using("sp", "SELECT page_id, regexp_extract(html, 'https?://wa[.]me/[0-9+]+') AS link FROM sp WHERE contains(html, '://wa.me/')"),
    "social_links": using("sp", f"""SELECT page_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda h: trim(h)),
        lambda h: regexp_matches(h, {q(PROFILE)}) AND NOT contains(h, 'sharer')))) AS link FROM sp"""),
    "block_signatures": using("sp", f"""SELECT page_id, {vendor('marked')} AS blocked_by FROM (SELECT page_id, html || CASE page_id % 9
        WHEN 0 THEN '<div class="cf-browser-verification">' WHEN 1 THEN '<div id="px-captcha">' WHEN 2 THEN 'Please verify you are a human'
        WHEN 3 THEN 'AkamaiGHost' ELSE '' END AS marked FROM sp)"""),
    "contact_forms": using("sp", """SELECT page_id, CAST(regexp_matches(html, '<form[^>]*contact-form') OR (regexp_matches(html, '<form')
        AND regexp_matches(html, '<input type="email"') AND regexp_matches(html, '<textarea')) AS INTEGER) AS has_contact_form FROM sp"""),
    "page_metadata": using("sp", f"""SELECT page_id, {TITLE} AS page_title,
        trim(regexp_extract(html, '<meta name="(?:D|d)escription" content="([^"]*)"', 1)) AS meta_description,
        trim(regexp_extract(html, '<meta property="og:title" content="([^"]*)"', 1)) AS og_title, '' AS og_description FROM sp"""),
    "own_vs_other": using("mixed", f"SELECT doc_id, email, domain, CAST({owned('email', 'domain')} AS INTEGER) AS is_own FROM mixed"),
    "email_roles": using("mixed", f"SELECT doc_id, email, role, CAST({priority('role')} AS INTEGER) AS priority FROM (SELECT doc_id, email, {role('email')} AS role FROM mixed)"),
    "ranked_emails": using("lists", """SELECT r.site AS input_url, replace(coalesce(l.own, ''), ';', '') AS own, replace(coalesce(l.other, ''), ';', '') AS other
        FROM res r LEFT JOIN lists l ON l.site = r.site"""),
    "primary_email": using("lists", """SELECT r.site AS input_url, coalesce(l.primary_email, '') AS primary_email, coalesce(l.primary_role, '') AS primary_role
        FROM res r LEFT JOIN lists l ON l.site = r.site"""),
    "mx_filtered": using("res", """SELECT r.site AS input_url, array_to_string(list_sort(list_filter(r.emails, lambda e: NOT list_contains(k.bad, split_part(e, '@', 2)))), ' ') AS emails
        FROM res r, (SELECT list(DISTINCT host) AS bad FROM sp WHERE length(host) % 3 = 0) k"""),
    "email_dictionary": using("addr", "SELECT site AS input_url, email, role, CAST(is_own AS INTEGER) AS is_own, CAST(from_mailto AS INTEGER) AS from_mailto FROM addr"),
    "address_pages": using("addr", """SELECT a.site AS input_url, a.email, any_value(a.role) AS role, CAST(any_value(a.is_own) AS INTEGER) AS is_own,
        CAST(any_value(a.from_mailto) AS INTEGER) AS from_mailto, arg_min(s.url, s.page_id) AS source_page, count(DISTINCT s.url) AS n_pages
        FROM addr a JOIN (SELECT site, url, page_id, unnest(emails) AS email FROM sig) s ON s.site = a.site AND s.email = a.email GROUP BY a.site, a.email"""),
    "site_facts": using("cat lists", """SELECT r.site AS input_url, len(r.emails) AS n_emails, coalesce(p.n_own, 0) AS n_own, r.ok AS pages_ok, r.failed AS pages_failed, r.blocked_by,
        CAST(r.form AS INTEGER) AS has_contact_form, coalesce(l.primary_email, '') AS primary_email, c.category, CAST(coalesce(p.low, false) AS INTEGER) AS low_quality
        FROM res r JOIN cat c ON c.site = r.site LEFT JOIN lists l ON l.site = r.site LEFT JOIN (SELECT site, count(*) FILTER (is_own) AS n_own,
          NOT bool_or(is_own) OR max(CASE WHEN is_own AND n = 1 THEN role END) = 'other' AS low FROM placed GROUP BY site) p ON p.site = r.site"""),
    "protected_results": using("placed", f"""SELECT r.site AS input_url, coalesce(string_agg(p.email, ' ' ORDER BY p.email) FILTER (p.role <> 'personal'), '') AS impersonal,
        coalesce(string_agg(p.shown, '; ' ORDER BY p.n) FILTER (p.is_own), '') AS own_domain_emails,
        coalesce(string_agg(p.shown, '; ' ORDER BY p.n) FILTER (NOT p.is_own), '') AS other_domain_emails
        FROM res r LEFT JOIN (SELECT *, CASE WHEN role = 'personal' THEN {HASHED} ELSE email END AS shown FROM placed) p ON p.site = r.site GROUP BY r.site"""),
    "site_rollup": using("res", f"""SELECT site AS input_url, {joined('emails')} AS emails, {joined('mailto')} AS mailto_emails, {joined('phones', '|')} AS phones,
        {joined('whatsapp')} AS whatsapp, {joined('social')} AS social, {joined('source_pages')} AS source_pages, ok AS pages_ok, failed AS pages_failed,
        blocked_by, CAST(form AS INTEGER) AS has_contact_form, page_title, meta_description, og_title, '' AS og_description FROM res"""),
    "merged_passes": using("sig", """SELECT coalesce(a.site, b.site) AS site, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.emails, []), coalesce(b.emails, [])))), ' ') AS emails,
        array_to_string(list_sort(list_distinct(list_concat(coalesce(a.source_pages, []), coalesce(b.source_pages, [])))), ' ') AS source_pages,
        coalesce(a.ok, 0) + coalesce(b.ok, 0) AS pages_ok, coalesce(a.failed, 0) + coalesce(b.failed, 0) AS pages_failed, coalesce(nullif(a.blocked_by, ''), b.blocked_by, '') AS blocked_by,
        CAST(coalesce(a.form, false) OR coalesce(b.form, false) AS INTEGER) AS has_contact_form, coalesce(nullif(a.page_title, ''), b.page_title, '') AS page_title,
        coalesce(nullif(a.meta_description, ''), b.meta_description, '') AS meta_description, coalesce(nullif(a.og_title, ''), b.og_title, '') AS og_title
        FROM even a FULL JOIN odd b ON a.site = b.site""").replace("\nSELECT coalesce(a.site", ",\neven AS (" + CTES["roll"].replace("FROM sig", "FROM sig WHERE page_id % 2 = 0")
        + "),\nodd AS (" + CTES["roll"].replace("FROM sig", "FROM sig WHERE page_id % 2 = 1") + ")\nSELECT coalesce(a.site"),
    "empty_status": using("sp", """SELECT site, CAST(n = 0 AND ok = 0 AND failed > 0 AS INTEGER) AS fetch_failed, CASE WHEN n > 0 THEN '' WHEN ok = 0 AND failed > 0
          THEN 'pages failed to fetch (0 of ' || failed || ' candidate page(s) returned a response — not a genuine "no email" result)'
          ELSE 'no emails found on checked pages' END AS error
        FROM (SELECT site, count(*) FILTER (status = 200) AS ok, count(*) FILTER (status <> 200) AS failed, count(*) FILTER (page_id % 6 = 0) AS n FROM sp GROUP BY site)"""),
    "salvage": using("res_open", f"SELECT site AS input_url, {joined('phones', '|')} AS phones, {joined('whatsapp')} AS whatsapp, {joined('social')} AS social FROM res_open"),
    "result_rows": using("res_open lists", FLAT),
    "categories": using("cat", "SELECT site AS input_url, category FROM cat"),
    "batch_summary": using("cat", "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (category = {q(c)}) AS {c}" for c in fv.CATEGORIES) + " FROM cat"),
    "retry_list": using("res", "SELECT site AS input_url FROM res WHERE (method = 'none' OR fetch_failed) AND blocked_by = ''"),
    "retry_queue": using("res", "SELECT site AS input_url FROM res WHERE (method = 'none' OR fetch_failed) AND blocked_by = '' AND length(host) % 2 <> 0"),
    "low_quality": using("placed", "SELECT site AS input_url FROM placed GROUP BY site HAVING NOT bool_or(is_own) OR max(CASE WHEN is_own AND n = 1 THEN role END) = 'other'"),
    "second_pass_list": using("cat placed", """SELECT site AS input_url, CAST(0 AS BIGINT) AS pass_order FROM cat WHERE category = 'genuine_no_result' UNION ALL
        SELECT site, CAST(1 AS BIGINT) FROM placed GROUP BY site HAVING NOT bool_or(is_own) OR max(CASE WHEN is_own AND n = 1 THEN role END) = 'other'"""),
    "run_counters": using("res", """SELECT count(*) AS done, count(*) FILTER (len(emails) > 0) AS with_email, count(*) FILTER (error <> '') AS errors,
        count(*) / 50.0::DOUBLE AS rate, (10000000 - count(*)) / (count(*) / 50.0::DOUBLE) AS eta_seconds FROM res"""),
    "latest_per_target": """SELECT 'https://s' || conv_id || '.sample.net' AS input_url, md5(arg_max(text, turn)) AS content, arg_max(role, turn) AS role,
        min(conv_id * 1000 + turn) AS first_seq FROM conversations GROUP BY conv_id""",
    "upserted_targets": """SELECT 'https://s' || conv_id || '.sample.net' AS input_url, md5(arg_max(text, turn)) AS content, arg_max(role, turn) AS role,
        min(conv_id * 1000 + turn) AS first_seq FROM conversations GROUP BY conv_id""",
    "upserted_batches": """SELECT 'https://s' || conv_id || '.sample.net' AS input_url, md5(arg_max(text, turn)) AS content, arg_max(role, turn) AS role
        FROM conversations GROUP BY conv_id""",
    "streamed_counters": """SELECT count(*) AS done, count(*) FILTER (event_type = 'click') AS with_email, count(*) FILTER (event_type = 'error') AS errors FROM events""",
    "newest_results": """SELECT event_id, 'https://u' || user_id || '.sample.net' AS input_url, epoch_us(ts) AS at FROM events
        ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC LIMIT 40""",
    "resume_remaining": using("sp", "SELECT DISTINCT site AS input_url FROM sp WHERE site NOT IN (SELECT site FROM sp WHERE page_id % 4 = 1)"),
    "hit_rate_trend": using("hist", """SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS at, total, email_found, round(rate, 9) AS hit_rate,
        round(rate - lag(rate) OVER (ORDER BY hour), 9) AS hit_rate_change FROM (SELECT *, email_found / total AS rate FROM hist ORDER BY hour DESC LIMIT 20)"""),
    "history_lines": using("hist", "SELECT epoch(hour)::BIGINT AS at, total, email_found FROM hist WHERE hour(hour) % 5 <> 3 ORDER BY hour DESC LIMIT 20"),
    "target_lines": """SELECT CASE doc_id % 5 WHEN 2 THEN 'shop' || doc_id || '.io' WHEN 3 THEN 'https://site' || doc_id || '.org/a' ELSE source || '.com' END AS input_url
        FROM documents WHERE doc_id % 5 > 1""",
    "target_positions": """SELECT CASE doc_id % 4 WHEN 2 THEN 'shop' || doc_id || '.io' ELSE source || '.com' END AS input_url, ord
        FROM (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS ord FROM documents) WHERE doc_id % 4 > 1""",
    "results_round_trip": using("res_open lists", f"SELECT input_url, 1 AS done FROM ({FLAT}) UNION ALL SELECT input_url || '/more', 0 FROM ({FLAT})"),
    "given_up_targets": f"""SELECT 'https://u' || user_id || '-' || event_id % 37 || '.sample.net' AS input_url, 'none' AS method, {q(fv.ERROR_GAVE_UP.format(seconds=0))} AS error
        FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'click') = 0""",
    "fetch_outcome": using("log", """SELECT url, attempt, coalesce(status, 0) AS status, CASE WHEN status = 200 THEN 'ok' WHEN (status IS NULL OR status IN (429, 500, 502, 503, 504)) AND attempt < 2
        THEN 'retryable' ELSE 'failed' END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY attempt DESC) AS n FROM log) WHERE n = 1"""),
    "retry_after": using("log", """SELECT event_id, seconds, CASE WHEN seconds IS NOT NULL THEN least(15.0::DOUBLE, seconds) END AS capped FROM (SELECT event_id, round(CASE WHEN regexp_matches(trim(retry_after), '^[0-9]+$')
        THEN CAST(trim(retry_after) AS DOUBLE) WHEN retry_after LIKE 'Wed%' THEN greatest(0.0, (epoch_us(TIMESTAMP '2024-01-03 10:00:00') - us) / 1e6) END, 3) AS seconds
        FROM log WHERE retry_after IS NOT NULL)"""),
    "backoff_audit": using("log", """SELECT url, attempt, round(waited, 6) AS waited, ceiling, CAST(waited > ceiling AS INTEGER) AS excess FROM (
        SELECT b.url, b.attempt, (b.us - a.us) / 1e6 AS waited, 0.5 + CASE WHEN a.status = 429 AND regexp_matches(trim(a.retry_after), '^[0-9]+$')
          THEN least(15.0::DOUBLE, CAST(trim(a.retry_after) AS DOUBLE)) WHEN a.status = 429 AND a.retry_after LIKE 'Wed%'
          THEN least(15.0::DOUBLE, greatest(0.0, (epoch_us(TIMESTAMP '2024-01-03 10:00:00') - a.us) / 1e6)) ELSE least(10.0::DOUBLE, pow(2, a.attempt)) END AS ceiling
        FROM log b JOIN log a ON a.url = b.url AND a.attempt = b.attempt - 1)"""),
    "politeness_audit": using("log", """SELECT event_id, domain, round(gap, 6) AS gap, CAST(coalesce(gap < CASE WHEN length(domain) % 2 = 0 THEN 7.0 ELSE 0.5 END, false) AS INTEGER) AS too_soon
        FROM (SELECT *, (us - lag(us) OVER (PARTITION BY domain ORDER BY us, event_id)) / 1e6 AS gap FROM log)"""),
    "crawl_schedule": using("scored", """SELECT domain, site, url, position, (position - 1) * CASE WHEN length(domain) % 2 = 0 THEN 7.0::DOUBLE ELSE 0.5::DOUBLE END AS start_seconds FROM (
        SELECT domain, site, url, row_number() OVER (PARTITION BY domain ORDER BY rank, site, url) AS position FROM (
          SELECT site, url, rank, regexp_replace(substr(site, 9), '^(www|m|blog)[.]', '') AS domain FROM (
            SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, page_id) AS rank FROM scored WHERE score IS NOT NULL) WHERE rank <= 20))"""),
    "hit_rate_by_window": """SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, count(*) AS done, count(*) FILTER (event_type = 'click') AS with_email,
        count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1""",
    "job_keys": using("sp", "SELECT left(sha1(CAST(sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS VARCHAR) || ',' || CAST(sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)) AS VARCHAR) || ',' || CAST(sum(CAST('0x' || substr(h, 17, 8) AS BIGINT)) AS VARCHAR) || ',' || CAST(sum(CAST('0x' || substr(h, 25, 8) AS BIGINT)) AS VARCHAR) || ',' || CAST(sum(CAST('0x' || substr(h, 33, 8) AS BIGINT)) AS VARCHAR)), 16) AS job_key FROM (SELECT sha1(site) AS h FROM (SELECT DISTINCT site FROM sp))"),
}


def _obfuscated_oracle() -> str:
    from sitesignal.functions.emails import STRICT_OBFUSCATED_PATTERN

    text = """(SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' hello [at] shop' || doc_id || ' [dot] co [dot] uk' WHEN 1 THEN ' that anecdotes'
      WHEN 2 THEN ' Sales AT Acme-' || doc_id || ' DOT com' ELSE ' jane [at] acme.com' END AS text FROM documents)"""
    loose, strict = obfuscated("text", fv.OBFUSCATED_EMAIL_PATTERN), obfuscated("text", STRICT_OBFUSCATED_PATTERN)
    return f"SELECT doc_id, {joined(f'list_distinct({loose})')} AS loose, {joined(f'list_distinct({strict})')} AS strict FROM {text}"


CONTACT = f"site || {I.CONTACT_PATH_SQL}"
TARGETS = "SELECT DISTINCT site, CASE WHEN page_id % 2 = 0 THEN host ELSE site || '/x' END AS input_url FROM sp"


def _named(parts: dict[str, str]) -> str:
    """Flat rows of ``res_open`` and ``lists`` under the names of the targets."""
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in parts.items()) + f"""
      SELECT t.input_url, f.* EXCLUDE (input_url) FROM ({TARGETS}) t JOIN ({FLAT}) f ON f.input_url = t.site"""


def _job_steps() -> dict[str, str]:
    """The whole job over the same inputs: listed pages or homepage and footer link, newest captures, rollup."""
    contact = CONTACT
    step = lambda name: CTES[name].replace("FROM sp", "FROM captured")
    return {
        "sp": CTES["sp"],
        "home": f"""SELECT page_id, host, site, status, replace(html, '<footer>', '<footer><a href="' || CASE WHEN page_id % 2 = 0 THEN {contact}
            ELSE '/team/' || page_id END || '">More</a>') AS html FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS n FROM sp) WHERE n = 1""",
        "captured": f"""SELECT page_id, host, site, url, status, html FROM (
            SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id DESC) AS n FROM (SELECT page_id, host, site, {contact} AS url, status, html FROM sp))
            WHERE n = 1 UNION ALL SELECT page_id, host, site, site, status, html FROM home""",
        "markup": step("markup"), "texts": step("texts"), "found": step("found"),
        "sig": CTES["sig"].replace(valid("e"), valid("e", fv.BLOCKED_DOMAINS)),
        "listed": f"""SELECT site, url, min(c) AS c FROM (SELECT site, c, {contact} AS url FROM (
            SELECT site, page_id % 3 AS c, min(page_id) AS page_id FROM sp WHERE length(host) % 2 = 0 GROUP BY ALL)) GROUP BY site, url""",
        "ranked": f"""SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY score DESC, c) AS rank FROM (
            SELECT site, url, c, {score(path_of('lower(url)'))} AS score FROM listed) WHERE score IS NOT NULL""",
        "plan": f"""SELECT site, url, rank FROM ranked UNION ALL SELECT site, site, 1 FROM home WHERE status = 200 AND site NOT IN (SELECT site FROM ranked)
            UNION ALL SELECT site, {contact}, 2 FROM home WHERE status = 200 AND page_id % 2 = 0 AND site NOT IN (SELECT site FROM ranked)""",
        "checked": "SELECT s.* REPLACE (p.rank AS page_id) FROM plan p JOIN sig s ON s.url = p.url",
        "roll": CTES["roll"].replace("FROM sig", "FROM checked"),
        "res": f"""SELECT h.site, regexp_replace(h.host, '^www[.]', '') AS host, coalesce(emails, []) AS emails, coalesce(mailto, []) AS mailto,
            coalesce(phones, []) AS phones, coalesce(whatsapp, []) AS whatsapp, coalesce(social, []) AS social, coalesce(source_pages, []) AS source_pages,
            CASE WHEN r.site IS NULL THEN 'none' WHEN h.site IN (SELECT site FROM ranked) THEN 'sitemap' ELSE 'homepage-fallback' END AS method,
            CASE WHEN r.site IS NULL THEN {q(fv.ERROR_NO_PAGES)} WHEN len(emails) > 0 THEN '' WHEN ok = 0
              THEN 'pages failed to fetch (0 of ' || failed || ' candidate page(s) returned a response — not a genuine "no email" result)'
              ELSE {q(fv.ERROR_NO_EMAILS)} END AS error, coalesce(len(emails) = 0 AND ok = 0, false) AS fetch_failed,
            CASE WHEN r.site IS NULL THEN {vendor('h.html')} ELSE r.blocked_by END AS blocked_by, coalesce(form, false) AS form,
            coalesce(page_title, '') AS page_title, coalesce(meta_description, '') AS meta_description, coalesce(og_title, '') AS og_title
            FROM home h LEFT JOIN roll r ON r.site = h.site""",
    }


RESULT_STEPS = {name: CTES[name] for name in ("res_open", "addr", "placed", "lists")}


def _rendered_pass() -> str:
    """Weak and empty results of the job, looked at again in the rendered captures of the same pages."""
    later = lambda text: re.sub(r"FROM (markup|texts|found|sig)\b", r"FROM \1_later", text)
    parts = _job_steps()
    parts["res_before"] = parts.pop("res")
    for name in ("res_open", "addr", "placed"):
        parts[name + "_before"] = re.sub(r"FROM (res|addr)\b", r"FROM \1_before", CTES[name])
    parts["cat"] = CTES["cat"].replace("FROM res_open", "FROM res_open_before")
    parts["chosen"] = """SELECT * FROM res_open_before WHERE site IN (SELECT site FROM cat WHERE category = 'genuine_no_result') OR site IN (
        SELECT site FROM placed_before GROUP BY site HAVING NOT bool_or(is_own) OR max(CASE WHEN is_own AND n = 1 THEN role END) = 'other')"""
    parts["shown"] = f"""SELECT page_id, host, site, url, 200 AS status, html || '<p>rendered@' || host || '</p>' AS html FROM (
        SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id DESC) AS n FROM (
          SELECT page_id, host, site, {CONTACT} AS url, html FROM sp WHERE page_id % 3 = 0)) WHERE n = 1"""
    parts["markup_later"] = CTES["markup"].replace("FROM sp", "FROM shown")
    for name in ("texts", "found", "sig"):
        parts[name + "_later"] = later(CTES[name]).replace(valid("e"), valid("e", fv.BLOCKED_DOMAINS))
    parts["looked"] = "SELECT s.* REPLACE (p.rank AS page_id) FROM plan p JOIN sig_later s ON s.url = p.url"
    parts["again"] = CTES["roll"].replace("FROM sig", "FROM looked")
    both = lambda c: f"list_sort(list_distinct(list_concat(c.{c}, coalesce(a.{c}, []))))"
    text = lambda c: f"coalesce(nullif(c.{c}, ''), a.{c}, '')"
    some = f"len({both('emails')}) > 0"
    parts["res"] = f"""SELECT c.site, c.host, {both('emails')} AS emails, {both('mailto')} AS mailto, {both('source_pages')} AS source_pages,
        CASE WHEN {some} THEN c.phones ELSE {both('phones')} END AS phones, CASE WHEN {some} THEN c.whatsapp ELSE {both('whatsapp')} END AS whatsapp,
        CASE WHEN {some} THEN c.social ELSE {both('social')} END AS social, c.method || CASE WHEN {some} THEN '+playwright' ELSE '' END AS method,
        CASE WHEN {some} THEN '' WHEN a.site IS NOT NULL THEN {q(fv.ERROR_NO_EMAILS_RENDERED)} ELSE c.error END AS error,
        {text('blocked_by')} AS blocked_by, c.form OR coalesce(a.form, false) AS form, {text('page_title')} AS page_title,
        {text('meta_description')} AS meta_description, {text('og_title')} AS og_title FROM chosen c LEFT JOIN again a ON a.site = c.site"""
    return _named({**parts, **RESULT_STEPS, "res_open": "SELECT * FROM res"})


ORACLE["obfuscated_emails"] = _obfuscated_oracle()
ORACLE["site_analysis"] = _named({**_job_steps(), **RESULT_STEPS})
ORACLE["rendered_pass"] = _rendered_pass()
ORACLE["streamed_emails"] = ORACLE["page_emails"]
