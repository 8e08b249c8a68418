"""One pass over a page's markup.

This is the only sizeable Python step of the package. It turns markup into
plain fields (visible text, links, forms, title, ...); every rule that decides
what counts as an address, a phone number or a contact form is a native
expression over those fields.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sitesignal import fixed_values as fv

PAGE_SCHEMA = (
    "struct<text:string,"
    "markup_hits:string,"
    "json_hits:string,"
    "anchors:array<struct<href:string,hinted:boolean,in_footer:boolean>>,"
    "has_footer:boolean,"
    "forms:array<struct<marker:string,has_email:boolean,has_textarea:boolean>>,"
    "title:string,"
    "description:string,"
    "og_title:string,"
    "og_description:string,"
    "incomplete:boolean>"
)

_PAGE_TYPE = pa.struct([
    ("text", pa.string()),
    ("markup_hits", pa.string()),
    ("json_hits", pa.string()),
    ("anchors", pa.list_(pa.struct([("href", pa.string()), ("hinted", pa.bool_()), ("in_footer", pa.bool_())]))),
    ("has_footer", pa.bool_()),
    ("forms", pa.list_(pa.struct([
        ("marker", pa.string()), ("has_email", pa.bool_()), ("has_textarea", pa.bool_()),
    ]))),
    ("title", pa.string()),
    ("description", pa.string()),
    ("og_title", pa.string()),
    ("og_description", pa.string()),
    ("incomplete", pa.bool_()),
])

#: characters of pages whose fields are held as Python objects at a time
SLICE_CHARS = 1 << 20

# elements that never have content
_VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
_CODE = frozenset(("script", "style"))
_ASIDE = frozenset(("template", "rt", "rp"))  # kept in the markup, left out of the visible text

_DATA_TYPE = re.compile(fv.DATA_SCRIPT_TYPE_PATTERN, re.IGNORECASE)
_DATA_ID = re.compile(fv.DATA_SCRIPT_ID_PATTERN, re.IGNORECASE)
_EMAIL_TYPE = re.compile(r"^email$", re.IGNORECASE)
_EMAIL_NAME = re.compile(r"email", re.IGNORECASE)
_DESCRIPTION = re.compile(r"^description$", re.IGNORECASE)


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


def _json_strings(body: str):
    """String values of a JSON document that may hold an address."""
    try:
        todo = [json.loads(body)]
    except (ValueError, RecursionError):
        return
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            if "@" in node:
                yield _clean(node)
        elif isinstance(node, dict):
            todo.extend(node.values())
        elif isinstance(node, list):
            todo.extend(node)


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = []  # open elements: (name, kind, index)
        self.opened = {}  # open elements per name
        self.pending = []  # character data since the last markup event
        self.texts = []  # visible strings
        self.lowered = []  # the same strings unstripped and lower-cased, for link texts
        self.offset = 0
        self.run = []  # text between two pieces of kept markup
        self.hits = []  # runs and attributes with an '@'
        self.json = []
        self.code = None  # body parts of a data script being read, or None
        self.in_code = 0
        self.aside = 0
        self.anchors = []  # [href, start, end, in_footer]
        self.forms = []  # [marker, start, end]
        self.ticks = 0
        self.email_ticks = []
        self.textarea_ticks = []
        self.footer = None  # None: not met, True: open, False: closed
        self.title = None
        self.title_open = False
        self.meta = {}

    def updatepos(self, i, j):  # line numbers are not needed
        return j

    # -- strings ----------------------------------------------------------------

    def _end_string(self):
        if not self.pending:
            return
        s = "".join(self.pending)
        self.pending = []
        if self.in_code:
            if self.code is not None:
                self.code.append(s)
            return
        self.run.append(s)
        if not self.aside:
            self._visible(s)

    def _visible(self, s):
        stripped = s.strip()
        if stripped:
            self.texts.append(stripped)
            if self.title_open:
                self.title.append(stripped)
        low = s.lower()
        self.lowered.append(low)
        self.offset += len(low)

    def _end_run(self):
        if self.run:
            s = "".join(self.run)
            self.run = []
            if "@" in s:
                self.hits.append(s)

    def _keep(self, s):
        if "@" in s:
            self.hits.append(s)

    # -- elements ------------------------------------------------------------------

    def _open(self, name, attrs, closed):
        self._end_string()
        at = {}
        for key, value in attrs:
            at[key] = "" if value is None else value
        if name in _CODE:
            self.in_code += 1
            if name == "script" and (_DATA_TYPE.search(at.get("type", "")) or _DATA_ID.search(at.get("id", ""))):
                self.code = []
        elif not self.in_code:
            self._end_run()
            self._keep(name)
            for key, value in at.items():
                self._keep(key)
                self._keep(value)
        kind, index = None, -1
        if name == "a":
            if "href" in at:
                kind, index = "a", len(self.anchors)
                self.anchors.append([at["href"], self.offset, None, self.footer is True])
        elif name == "form":
            marker = " ".join((at.get("id", ""), " ".join(at.get("class", "").split()),
                               at.get("action", ""), at.get("name", "")))
            kind, index = "form", len(self.forms)
            self.forms.append([marker, self.ticks, None])
        elif name == "input":
            if _EMAIL_TYPE.search(at.get("type", "")) or _EMAIL_NAME.search(at.get("name", "")):
                self.email_ticks.append(self.ticks)
                self.ticks += 1
        elif name == "textarea":
            self.textarea_ticks.append(self.ticks)
            self.ticks += 1
        elif name == "footer":
            if self.footer is None:
                self.footer, kind = True, "footer"
        elif name == "title":
            if self.title is None:
                self.title, self.title_open, kind = [], True, "title"
        elif name == "meta":
            if "description" not in self.meta and _DESCRIPTION.search(at.get("name", "")):
                self.meta["description"] = at.get("content", "").strip()
            prop = at.get("property")
            if prop in ("og:title", "og:description") and prop not in self.meta:
                self.meta[prop] = at.get("content", "").strip()
        elif name in _ASIDE:
            self.aside += 1
        self.stack.append((name, kind, index))
        self.opened[name] = self.opened.get(name, 0) + 1
        if closed or name in _VOID:
            self._pop()

    def _pop(self):
        name, kind, index = self.stack.pop()
        self.opened[name] -= 1
        if name in _CODE:
            self.in_code -= 1
            if self.code is not None:
                self.json.extend(_json_strings("".join(self.code)))
                self.code = None
            return
        if not self.in_code:
            self._end_run()
        if name in _ASIDE:
            self.aside -= 1
        if kind == "a":
            self.anchors[index][2] = self.offset
        elif kind == "form":
            self.forms[index][2] = self.ticks
        elif kind == "footer":
            self.footer = False
        elif kind == "title":
            self.title_open = False

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs, False)

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs, True)

    def handle_endtag(self, tag):
        self._end_string()
        if not self.opened.get(tag):
            return
        while self.stack[-1][0] != tag:
            self._pop()
        self._pop()

    def handle_data(self, data):
        self.pending.append(data)

    def _note(self, data):
        self._end_string()
        if not self.in_code:
            self._end_run()
            self._keep(data)

    handle_comment = _note
    handle_decl = _note
    handle_pi = _note

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self._note(data[6:])
            if not self.in_code and not self.aside:
                self._visible(data[6:])
        else:
            self._note(data)

    # -- result -----------------------------------------------------------------------

    def _finish(self):
        self._end_string()
        while self.stack:
            self._pop()
        self._end_run()

    def fields(self, hint):
        self._finish()
        return {
            "text": " ".join(self.texts),
            "markup_hits": "\n".join(self.hits),
            "json_hits": "\n".join(self.json),
            "anchors": self._anchor_fields(hint),
            "has_footer": self.footer is not None,
            "forms": [
                {
                    "marker": marker,
                    "has_email": bisect_left(self.email_ticks, start) < bisect_left(self.email_ticks, end),
                    "has_textarea": bisect_left(self.textarea_ticks, start) < bisect_left(self.textarea_ticks, end),
                }
                for marker, start, end in self.forms
            ],
            "title": "".join(self.title or ()),
            "description": self.meta.get("description", ""),
            "og_title": self.meta.get("og:title", ""),
            "og_description": self.meta.get("og:description", ""),
        }

    def _anchor_fields(self, hint):
        """Links with a flag telling whether a contact word is in the href or the text.

        Link texts are merged into ranges that do not overlap and searched once,
        so nested unclosed links do not repeat each other's text.
        """
        flags = [hint.search(href.lower()) is not None for href, _, _, _ in self.anchors]
        ranges = []
        for (_, start, end, _), found in zip(self.anchors, flags):
            if found or start == end:
                continue
            if ranges and start < ranges[-1][1]:
                ranges[-1][1] = max(ranges[-1][1], end)
            else:
                ranges.append([start, end])
        starts, ends = [], []
        text = "".join(self.lowered) if ranges else ""
        for start, end in ranges:
            for m in hint.finditer(text, start, end):
                starts.append(m.start())
                ends.append(m.end(1))
        for i in range(len(ends) - 2, -1, -1):
            ends[i] = min(ends[i], ends[i + 1])
        out = []
        for (href, start, end, in_footer), found in zip(self.anchors, flags):
            if not found:
                i = bisect_left(starts, start)
                found = i < len(starts) and ends[i] <= end
            out.append({"href": href, "hinted": found, "in_footer": in_footer})
        return out


def scan_page(html: str, hint) -> dict:
    """Fields of one page. A page that the parser gives up on keeps what was read so far and is marked incomplete."""
    page, incomplete = _Page(), False
    try:
        page.feed(html)
        page.close()
    except Exception:  # noqa: BLE001  one hostile page must not end the job
        incomplete = True
    try:
        return {**page.fields(hint), "incomplete": incomplete}
    except Exception:  # noqa: BLE001
        return {**_Page().fields(hint), "incomplete": True}


def hint_pattern(keywords):
    """Finds, at every position, the shortest keyword starting there."""
    words = sorted(set(keywords), key=lambda w: (len(w), w))
    return re.compile("(?=(" + "|".join(re.escape(w) for w in words) + "))")


def scan_array(pages: pa.Array, hint) -> pa.Array:
    """Fields of every page. They take many times the page as Python objects, so they are packed about ``SLICE_CHARS`` of pages at a time."""
    packed, rows, size = [], [], 0
    for page in pages:
        html = page.as_py()
        rows.append(None if html is None else scan_page(html, hint))
        size += len(html or "") + 64
        if size >= SLICE_CHARS:
            packed.append(pa.array(rows, type=_PAGE_TYPE))
            rows, size = [], 0
    packed.append(pa.array(rows, type=_PAGE_TYPE))
    return pa.concat_arrays(packed)


def scan(html: Column | str, keywords=fv.CONTACT_KEYWORDS) -> Column:
    """Struct of page fields (see ``PAGE_SCHEMA``); null for a null page."""
    words = list(keywords)

    @F.arrow_udf(PAGE_SCHEMA)
    def scan_pages(pages: pa.Array) -> pa.Array:
        return scan_array(pages, hint_pattern(words))

    # not to be evaluated a second time where a filter on its result is pushed down
    return scan_pages.asNondeterministic()(F.col(html) if isinstance(html, str) else html)
