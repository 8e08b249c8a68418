"""Main text of a page by two passes of rules over its blocks.

A scan cuts the page into blocks of text. The first pass judges each block by
itself: by the element it stands in (a menu, footer, form, advert or comment
list is never main text), by the share of its text in links, by its length and
by the share of stop words. Stop words speak only where they can: in text of
Latin script, on a page whose long blocks hold as many of them as the languages
of the list do. Elsewhere length and links decide, and a sign of a script
without blanks counts as ``WIDE`` letters. Blocks it cannot tell, short ones
above all, take the label of the nearest judged neighbours in the second pass.
Inside an article, text counts as main text unless a rule speaks against it.

Null and empty pages have no blocks and an empty text. Character references
are decoded once; an element or comment that never ends reaches to the end of
the page; broken tags are text, and so is all behind the last ``>``. The scan
is linear in the page's length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

SHORT_CHARS = 70
LINK_SHARE = 0.4
STOP_HIGH = 0.30
STOP_LOW = 0.15
STOP_KNOWN = 0.24  # of all words in a page's long blocks: its language is one of the list
WIDE = 3

STOP_WORDS = frozenset("""
a about after all also an and any are as at be because been before but by can could did do does down each even for from had has have he
her him his how i if in into is it its like made many may more most my no not now of on one only or other our out over said same see she
should so some such than that the their them then there these they this those through to two up very was we well were what when where
which while who will with would you your
aber alle als am auch auf aus bei bin bis da dann das dass dem den der des die doch du ein eine einem einen einer er es für hat habe haben
ich ihr im ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war wenn werden wie wird wir zu zum zur
au aux avec ce ces cette comme dans de des donc du elle elles en est et eux il ils je la le les leur lui mais mes moi mon ne nous on ou où
par pas plus pour qu que qui sa sans se ses son sont sur ta te tu un une vous
al como con cual de del desde donde el ella ellos en entre era es esta este está fue ha hay la las le lo los mas me mi muy no nos o para
pero por porque que se sin sobre su sus también te tiene todo un una uno y ya yo
""".split())

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup "
                    "time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math select object canvas audio video".split())
_NEVER = frozenset("nav footer aside form button menu dialog head fieldset figcaption label option".split())
_MAIN = frozenset("article main".split())
_OPEN_NAMES = frozenset("article main body html h1 h2 h3 h4 h5 h6".split())
_CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
_ITEMS = frozenset("li dt dd tr td th option".split())

_BAD_NAME = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|side(?:bar\w*)?|menu\w*|nav(?:bar|igation)?|breadcrumbs?|cookies?\w*|consent\w*|"
    r"gdpr|notices?|notification\w*|alerts?|popup\w*|modal\w*|overlay\w*|comments?\w*|disqus\w*|repl(?:y|ies)|respond|share\w*|sharing|social\w*|"
    r"related\w*|recommend\w*|subscri\w*|newsletter\w*|sign(?:up|in)|login|footer\w*|header|masthead|topbar|toolbar|pagination|pager|widget\w*|search\w*|"
    r"hidden|copyright|legal|disclaimer|skip|tags|byline)(?:$|[^a-z])")
_MAIN_NAME = re.compile(r"(?:^|[^a-z])(?:article(?:body|text)?|content|main|post(?:body)?|entry|story)(?:$|[^a-z])")
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_UNSEEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$|/)|display\s*:\s*none|aria-hidden\s*=\s*["']?true|role\s*=\s*["']?(?:banner|contentinfo|complementary|search|form)""", re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")


@dataclass
class Block:
    text: str
    link_chars: int
    barred: bool
    region: int  # number of the article or main element, 0 outside

    @cached_property
    def by_itself(self) -> bool:
        """Not barred, and not mostly links."""
        return not self.barred and self.link_chars <= LINK_SHARE * len(self.text)

    @cached_property
    def latin(self) -> bool:
        return self.text.isascii() or 2 * sum(1 for _ in _UNLIKE_LATIN.finditer(self.text)) <= sum(map(str.isalpha, self.text))

    @cached_property
    def stop_words(self) -> tuple[int, int]:
        """Stop words and words of the text."""
        words = self.text.lower().split()
        return sum(w.strip(_MARKS) in STOP_WORDS for w in words), len(words)


class _Scan:
    """One pass over a page."""

    def __init__(self, html: str):
        self.html, self.blocks = html, []
        self.stack: list[tuple[str, bool, int]] = []  # name, barred, region
        self.names: Counter[str] = Counter()  # of the stack
        self.run: list[str] = []
        self.links = self.link_chars = self.regions = 0

    def state(self) -> tuple[bool, int]:
        return self.stack[-1][1:] if self.stack else (False, 0)

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            barred, region = self.state()
            self.blocks.append(Block(text, self.link_chars, barred, region))
        self.run, self.link_chars = [], 0

    def push(self, name: str, barred: bool, region: int) -> None:
        self.stack.append((name, barred, region))
        self.names[name] += 1

    def pop(self) -> str:
        name = self.stack.pop()[0]
        self.names[name] -= 1
        return name

    def text(self, raw: str) -> None:
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            self.run.append(raw)
            if self.links:
                self.link_chars += len(raw.strip())

    def open(self, name: str, attributes: str) -> None:
        names = " ".join("".join(m) for m in _NAMES.findall(attributes)).lower() if attributes else ""
        marked = name not in _OPEN_NAMES and bool(names and _BAD_NAME.search(names) or attributes and _UNSEEN.search(attributes))
        if name in _INLINE:
            if name == "a":
                self.links = 1
            if marked:
                self.flush()
                self.push(name, True, self.state()[1])
            return
        self.flush()
        while self.stack and self.stack[-1][0] in _CLOSED_BY_BLOCK:
            self.pop()
        if name in _ITEMS and self.stack and self.stack[-1][0] == name:
            self.pop()
        barred, region = self.state()
        barred = barred or marked or name in _NEVER or name == "header" and not region
        if not barred and not region and (name in _MAIN or name in ("div", "section") and names and _MAIN_NAME.search(names)):
            self.regions += 1
            region = self.regions
        self.push(name, barred, region)

    def close(self, name: str) -> None:
        if name == "a":
            self.links = 0
        if name not in _INLINE or self.names[name]:
            self.flush()
        if self.names[name]:
            while self.pop() != name:
                pass

    def read(self) -> list[Block]:
        html, at, tag = self.html, 0, _TAG
        lower = None
        last = html.rfind(">")
        while 0 <= (lt := html.find("<", at)):
            if lt > last and not html.startswith(("<!", "<?"), lt):  # no tag ends any more
                upto = min((p for p in (html.find("<!", lt), html.find("<?", lt)) if p >= 0), default=len(html))
                self.text(html[at:upto])
                at = upto
                continue
            self.text(html[at:lt])
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = end + 3 if end >= 0 else len(html)
                continue
            if html.startswith(("<!", "<?"), lt):
                end = html.find(">", lt)
                at = end + 1 if end >= 0 else len(html)
                continue
            found = tag.match(html, lt)
            if not found and tag is _TAG and html[lt + 1:lt + 2] and (html[lt + 1].isalpha() or html[lt + 1] == "/"):
                found = _LOOSE.match(html, lt)  # a quote that never ends: from here on quotes are not minded
                tag = _LOOSE if found else tag
            if not found:
                self.text("<")
                at = lt + 1
                continue
            slash, name, attributes = found[1], found[2].lower(), found[3]
            at = found.end()
            if slash:
                self.close(name)
            elif name == "br":
                self.run.append(" ")
            elif name in _RAW and not attributes.endswith("/"):
                if name not in _INLINE:
                    self.flush()
                lower = html.lower() if lower is None else lower
                end = lower.find(f"</{name}", at) if len(lower) == len(html) else html.find(f"</{name}", at)
                at = html.find(">", end) + 1 if end >= 0 else len(html)
                at = at or len(html)
            elif name in _VOID:
                if name not in _INLINE and name != "img":
                    self.flush()
            else:
                self.open(name, attributes)
        self.text(html[at:])
        self.flush()
        return self.blocks


def blocks_of(html: str | None) -> list[Block]:
    return _Scan(html).read() if html else []


_MARKS = ".,;:!?\"'()[]«»¿¡"
_UNLIKE_LATIN = re.compile(r"[^\W\d_\u0000-\u024F\u1E00-\u1EFF]")
#: scripts that write no blanks between words
_UNSPACED = re.compile(r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF]")


def language_known(blocks: list[Block]) -> bool:
    """Whether the long Latin blocks of a page hold enough stop words for their share to tell text from lists."""
    counts = [b.stop_words for b in blocks if len(b.text) >= SHORT_CHARS and b.by_itself and b.latin]
    return sum(s for s, _ in counts) >= STOP_KNOWN * sum(n for _, n in counts)


def first_label(block: Block, known: bool = True) -> str:
    """``good``, ``bad``, ``near`` (probably good) or ``short``, from the block alone; ``known``: stop words can tell."""
    size = len(block.text)
    if not block.by_itself:
        return "bad"
    if size < SHORT_CHARS and (block.latin or size + (WIDE - 1) * sum(1 for _ in _UNSPACED.finditer(block.text)) < SHORT_CHARS):
        return "bad" if block.link_chars and not block.region else "short"
    stops, words = block.stop_words
    if stops >= STOP_HIGH * words or not (known and block.latin):
        return "good"
    if stops >= STOP_LOW * words or block.region:
        return "near"
    return "bad"


def main_blocks(blocks: list[Block]) -> list[Block]:
    """Second pass: undecided blocks take the label of the nearest decided ones of their part of the page."""
    known = language_known(blocks)
    labels = [first_label(b, known) for b in blocks]
    # barred blocks inside an article say nothing about the text around them; outside they do
    by_region: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        if not (b.barred and b.region):
            by_region.setdefault(b.region, []).append(i)
    good = set()
    inside = any(r and any(labels[i] != "bad" for i in at) for r, at in by_region.items())
    for region, at in by_region.items():
        edge = "good" if region else "bad"
        after: list[tuple[str, int]] = []
        label, place = edge, len(at)
        for k in range(len(at) - 1, -1, -1):
            after.append((label, place - k))
            if labels[at[k]] in ("good", "bad"):
                label, place = labels[at[k]], k
        after.reverse()
        label, place = edge, -1
        for k, i in enumerate(at):
            own = labels[i]
            if own in ("good", "bad"):
                label, place = own, k
            elif label == after[k][0]:
                own = label
            elif own == "near" or region:
                own = "good"
            else:
                own = label if k - place < after[k][1] else after[k][0] if k - place > after[k][1] else "bad"
            # where the page marks its article, text outside is not the article
            if own == "good" and (region or not inside):
                good.add(i)
    return [b for i, b in enumerate(blocks) if i in good]


def main_text(html: str | None) -> str:
    return " ".join(b.text for b in main_blocks(blocks_of(html)))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` of every page."""
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars long")
