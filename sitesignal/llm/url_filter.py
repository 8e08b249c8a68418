"""URL verdicts from rules, and from segmented host names for all other URLs.

Host labels are cut into words by a unigram Viterbi search over words counted
in the titles and texts of all pages. Host words and path tokens then go into a multinomial
naive Bayes model, trained on the URLs that a rule decides, which judges the
URLs that no rule decides.

Counts cover every word of every page, and none is left out: the substrings of
the distinct runs of letters in host names are joined with the counts, so each
run brings its own small dictionary and no word list goes to one place. Of a
run's substrings only those of up to ``HEAD`` letters, and those as long as some
word with the same first ``HEAD`` letters, are formed: their number grows with
the run's length, not with its square. Features
are hashed into ``BUCKETS`` counters, a model of fixed size that is broadcast.

A null URL or one without ``://`` has an empty host and path, no rule, and is
judged on the prior alone. Ties between rules cannot happen, since the rule
texts differ; a score of exactly 0 allows. If no URL has a rule, all are
allowed. Repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import inf, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesignal.session import stage

BUCKETS = 1 << 16
HEAD = 4

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def page_words(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``(word, n)``: lower-cased letter runs of titles and texts over all pages.

    Tags, scripts, styles and comments are left out; what never closes reaches to the end of the page.
    """
    text = F.regexp_replace(F.coalesce(pages[html_col], F.lit("")), r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^<>]*+>|&#?\w++;", " ")
    found = pages.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class Segmenter:
    """Most likely split of a name into known words; unknown letters cost as much as a rare word each."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``total`` is that of all counts, if ``counts`` holds only those that can occur."""
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: log(total / n) for w, n in counts.items()}
        self.unknown = log(total * 10.0)
        self.sizes = sorted({1, *map(len, counts)}, reverse=True)

    def split(self, name: str) -> tuple[str, ...]:
        best, back = [0.0] + [inf] * len(name), [0] * (len(name) + 1)
        for end in range(1, len(name) + 1):
            for size in self.sizes:
                start = end - size
                if start < 0:
                    continue
                cost = self.cost.get(name[start:end])
                if cost is None:
                    if size > 1:
                        continue
                    cost = self.unknown
                if best[start] + cost < best[end]:
                    best[end], back[end] = best[start] + cost, start
        out, end = [], len(name)
        while end:
            out.append(name[back[end]:end])
            end = back[end]
        return tuple(reversed(out))


def _runs(text: str) -> list[str]:
    """Runs of letters or of digits; a run of digits is only ``#`` and its length."""
    out, run = [], ""
    for c in text + " ":
        kind = 1 if c.isdigit() else 2 if c.isalpha() else 0
        if run and kind != (1 if run[-1].isdigit() else 2):
            out.append(f"#{len(run)}" if run[-1].isdigit() else run)
            run = ""
        if kind:
            run += c
    return out


def features(host_words: list[str], path: str) -> list[int]:
    """Feature counters that a URL's host words and path tokens fall into."""
    found = [f"h:{w}" for w in host_words] + [f"p:{w}" for w in _runs(path.lower())]
    return [crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in found]


def _host_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(h, i, run) for h in batch["host"].to_pylist() for i, run in enumerate(_runs(h))]
        yield pa.RecordBatch.from_pylist([{"host": h, "at": i, "run": run} for h, i, run in rows], pa.schema(
            [("host", pa.string()), ("at", pa.int32()), ("run", pa.string())]))


def host_segments(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """``(host, words)`` of distinct hosts: the most likely split of each run of letters, by the counts of all words."""
    known = stage(counts, "page-words")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()["total"]
    lengths = known.filter(F.length("word") > HEAD).groupBy(F.substring("word", 1, HEAD).alias("head")).agg(
        F.sort_array(F.collect_set(F.length("word"))).alias("lengths"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, run in zip(batch["rid"].to_pylist(), batch["run"].to_pylist()):
                own: dict[str, list[int]] = {}
                for at in range(len(run) - HEAD):
                    own.setdefault(run[at:at + HEAD], []).append(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rid] * len(own), pa.int64()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.list_(pa.int32()))],
                    ["rid", "head", "places"])

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, run, long in zip(*(batch[c].to_pylist() for c in ("rid", "run", "long"))):
                every = range(len(run))
                for places, sizes in [(every, range(1, HEAD + 1)), *((at["places"], at["lengths"]) for at in long or [])]:
                    for size in sizes:
                        own = sorted({run[i:i + size] for i in places if i + size <= len(run)})
                        yield pa.RecordBatch.from_arrays([pa.array([rid] * len(own), pa.int64()), pa.array(own, pa.string())], ["rid", "word"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [Segmenter({r["word"]: r["n"] for r in own or []}, total).split(run)
                   for run, own in zip(batch["run"].to_pylist(), batch["found"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["run"], pa.array(out, pa.list_(pa.string()))], ["run", "words"])

    of_host = stage(hosts.select("host").distinct().mapInArrow(_host_runs, "host string, at int, run string"), "host-runs")
    runs = of_host.select("run").filter("NOT startswith(run, '#')").distinct()
    runs = stage(runs.select(F.monotonically_increasing_id().alias("rid"), "run"), "letter-runs")
    long = runs.mapInArrow(heads, "rid long, head string, places array<int>").join(lengths, "head").groupBy("rid").agg(
        F.collect_list(F.struct("places", "lengths")).alias("long"))
    parts = runs.join(long, "rid", "left").select("rid", "run", "long").mapInArrow(substrings, "rid long, word string")
    found = parts.join(known, "word").groupBy("rid").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    words = runs.join(found, "rid", "left").mapInArrow(split, "run string, words array<string>")
    whole = of_host.join(words, "run", "left").select("host", "at", F.coalesce("words", F.array("run")).alias("words"))
    whole = whole.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("all"))
    return whole.select("host", F.flatten("all.words").alias("words"))


def train(urls: DataFrame) -> np.ndarray:
    """Log-odds of block against allow per feature, and the prior's at the end, from rows with ``words, path, ruled``."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for words, path, ruled in zip(*(c.to_pylist() for c in batch.columns)):
                which = int(ruled == "block")
                rows[which] += 1
                np.add.at(seen[which], features(words, path), 1)
        for which in (0, 1):
            used = np.append(np.flatnonzero(seen[which]), BUCKETS)
            n = np.append(seen[which], rows[which])[used]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), which)), pa.array(used), pa.array(n)], ["which", "feature", "n"])

    ruled = urls.filter("ruled IS NOT NULL").select("words", "path", "ruled")
    sums = ruled.mapInArrow(tally, "which long, feature long, n long").groupBy("which", "feature").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((2, BUCKETS + 1))
    for r in sums:
        table[r["which"], r["feature"]] = r["n"]
    words, rows = table[:, :-1] + 0.5, table[:, -1]
    odds = np.log(words[1] / words[1].sum()) - np.log(words[0] / words[0].sum())
    if not rows.all():  # one class or none: nothing to tell apart
        return np.append(np.zeros(BUCKETS), 0.0 if not rows[1] else 1.0)
    return np.append(odds, np.log(rows[1]) - np.log(rows[0]))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """``(id, host, path, rule, verdict, score)``; ``score`` is the model's log-odds of block, null where a rule decides."""
    url = pages[url_col].cast("string")
    split = pages.select(pages[id_col].alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    split = split.withColumn("rule", rule).withColumn("ruled", ruled)
    segments = host_segments(split, page_words(pages, html_col))
    split = stage(split.join(segments, "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>"))), "urls")
    model = train(split)
    kind = split.schema["id"].dataType.simpleString()
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [None if ruled else float(model[features(words, path)].sum() + model[-1])
                      for words, path, ruled in zip(*(batch[c].to_pylist() for c in ("words", "path", "ruled")))]
            verdict = [r or ("block" if s > 0 else "allow") for r, s in zip(batch["ruled"].to_pylist(), scores)]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["host"], batch["path"], batch["rule"], pa.array(verdict, pa.string()), pa.array(scores, pa.float64())],
                ["id", "host", "path", "rule", "verdict", "score"])

    return split.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string, score double")
