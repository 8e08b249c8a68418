"""Spelling variants of frequent words, by a dictionary of trie-node pairs.

All words are numbered into two tries, one of the words and one of the words
read backwards. A word is then two rows of integers: the nodes of its
beginnings and those of its endings. The pair of the beginning before a place
and the ending behind it names the word without that place; the pair of the
beginning before a place and the ending from it on names the word itself. Two
words that share a pair of the first kind differ by a replaced character there,
and a pair of the first kind that is one of the second kind of another word is
an inserted or deleted one. Pairs are exact: no word needs to be compared.

A trie is numbered by sorting: words in range order share the nodes of their
common beginning with the word before them and get new numbers for the rest.
The first word of a range takes shared nodes from the ranges before it, which
one row per range (its first word, its last word and that word's nodes) tells.
The work on a word is linear in its length.

No pair has more words than the alphabet has characters, and one more, so no
group of the join is large whatever the data. Only sums and the largest
neighbour leave a group.

Null and empty texts have no words. A null id counts as an empty one where ids
are looked at. Of two equal characters in a row it makes no difference which
one is taken out; such a pair of words counts once. Ties go to the smaller word
in code-point order. An empty table gives an empty result. Columns of the input
other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesignal.llm.text import list_column, lists
from sitesignal.session import stage

RUN = "[A-Za-zÀ-ÿ]"
MIN_LENGTH = 7
MIN_COUNT = 2
#: a word is a variant of a neighbour that is so many times as frequent
RATIO = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: bits of a node's number within its range
NODE_BITS = 40
#: what a pair stands for: its word without a place, the same where that place does not repeat the one before it, the whole word
SKIP, SKIP_FIRST, WHOLE = 0, 1, 2


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int | None = None,
            min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of all texts. With ``drop_every``, one in so many runs, chosen by id and run, loses a character first."""
    runs = docs.select(docs[id_col].cast("string").alias("id"), F.explode(F.regexp_extract_all(
        F.coalesce(docs[text_col], F.lit("")), F.lit(f"{RUN}{{{min_length},}}"), F.lit(0))).alias("run"))
    word = F.translate("run", UPPER, LOWER)
    rows = runs.select("id", word.alias("word"))
    if drop_every:
        h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        rows = rows.withColumn("h", h).withColumn("at", (F.col("h") % F.length("word")).cast("int"))
        shorter = F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)"))
        rows = rows.withColumn("word", F.when(F.col("h") % drop_every == 0, shorter).otherwise(F.col("word"))).filter(F.length("word") >= min_length)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def common(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def trie_nodes(words: list[str], first: int, before: tuple[str, list[int]] = ("", [])) -> tuple[list[int], tuple[str, list[int]], int]:
    """Nodes of all beginnings of sorted words one after another, the last word with its nodes, and the next free number."""
    last, stack = before
    flat: list[int] = []
    for word in words:
        shared = common(last, word)
        grown = len(word) - shared
        stack = stack[:shared] + list(range(first, first + grown))
        first += grown
        flat += stack
        last = word
    return flat, (last, stack), first


def _numbered(column: str, out: str):
    """Adds the nodes of the column, in which each task has a sorted range of distinct words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[str, list[int]] = ("", [])
        free = TaskContext.get().partitionId() << NODE_BITS
        for batch in batches:
            words = batch[column].to_pylist()
            flat, before, free = trie_nodes(words, free, before)
            offsets = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns, list_column(np.array(flat, np.int64), offsets, pa.int64())], [*batch.schema.names, out])

    return run


def _by_range(words: DataFrame, column: str, out: str) -> DataFrame:
    """Words sorted by a column, with the nodes of that column's trie; a written table."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in words.schema.fields)}, {out} array<long>"
    return stage(words.repartitionByRange(column).sortWithinPartitions(column).mapInArrow(_numbered(column, out), schema), f"trie-{out}")


def _shared_nodes(numbered: DataFrame, column: str, nodes: str) -> dict[int, list[int]]:
    """For each range, the numbers that the first nodes made there have in ranges before it: one row per range reaches the driver."""
    own = F.element_at(nodes, -1)
    ranges = numbered.groupBy(F.shiftright(own, NODE_BITS).alias("part")).agg(
        F.min_by(column, own).alias("first"), F.max_by(column, own).alias("last"), F.max_by(nodes, own).alias("stack")).collect()
    shared: dict[int, list[int]] = {}
    last, stack = "", []
    for r in sorted(ranges, key=lambda r: r["part"]):
        known = stack[:common(last, r["first"])]
        base = r["part"] << NODE_BITS
        # the first word of a range made its nodes in order, from the range's first number on
        last, stack = r["last"], [known[x - base] if x - base < len(known) else x for x in r["stack"]]
        if known:
            shared[r["part"]] = known
    return shared


class _Same:
    """Numbers of nodes made twice, to the first number."""

    def __init__(self, shared: dict[int, list[int]]):
        parts = sorted(shared)
        self.counts = np.zeros((parts[-1] if parts else 0) + 1, np.int64)
        self.counts[parts] = [len(shared[p]) for p in parts]
        self.starts = np.cumsum(self.counts) - self.counts
        self.first = np.array([x for p in parts for x in shared[p]] or [0], np.int64)

    def __call__(self, nodes: np.ndarray) -> np.ndarray:
        part = nodes >> NODE_BITS
        place = nodes - (part << NODE_BITS)
        known = part < len(self.counts)
        part = np.where(known, part, 0)
        again = known & (place < self.counts[part])
        return np.where(again, self.first[np.where(again, self.starts[part] + place, 0)], nodes)


def node_pairs(begin: np.ndarray, end: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of words whose nodes lie between the offsets: owner, beginning, ending, kind. The empty beginning and ending are node -1."""
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(begin)) - offsets[owner]
    length = size[owner]
    at = lambda nodes, n: np.where(n > 0, nodes[np.maximum(offsets[owner] + n - 1, 0)], -1)
    before, behind, here = at(begin, place), at(end, length - place - 1), at(end, length - place)
    fresh = (place == 0) | (letters != np.roll(letters, 1))
    whole_end = offsets[1:] - 1  # the pair of the whole word and the empty ending
    last = size > 0
    return (np.concatenate([owner, owner, np.flatnonzero(last)]),
            np.concatenate([before, before, begin[whole_end[last]]]),
            np.concatenate([behind, here, np.full(int(last.sum()), -1)]),
            np.concatenate([np.where(fresh, SKIP_FIRST, SKIP), np.full(len(owner), WHOLE), np.full(int(last.sum()), WHOLE)]))


def _pairs(words: DataFrame, begin: dict[int, list[int]], end: dict[int, list[int]]) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast((begin, end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same_begin, same_end = map(_Same, shared.value)
        for batch in batches:
            first, offsets = lists(batch["begins"])
            last, _ = lists(batch["ends"])
            letters = np.frombuffer("".join(batch["word"].to_pylist()).encode("utf-32-le"), "<u4")
            own = first[offsets[1:] - 1]
            owner, p, s, kind = node_pairs(same_begin(first), same_end(last), offsets, letters)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[owner]), pa.array(batch["n"].to_numpy()[owner]), pa.array(p), pa.array(s), pa.array(kind.astype(np.int32))],
                ["id", "n", "p", "s", "kind"])

    return words.mapInArrow(run, "id long, n long, p long, s long, kind int")


def near_words(words: DataFrame, begin: dict[int, list[int]], end: dict[int, list[int]]) -> DataFrame:
    """``(id, n_near, best)`` of words with neighbours: how many, and ``(n, -id)`` of the one with the largest n among those above its own."""
    group = Window.partitionBy("p", "s")
    key = F.struct("n", (-F.col("id")).alias("by"))
    skips, firsts, whole = F.col("kind") < WHOLE, F.col("kind") == SKIP_FIRST, F.col("kind") == WHOLE
    count = lambda which: F.sum(which.cast("int")).over(group)
    top = lambda which: F.max(F.when(which, key)).over(group)
    seen = _pairs(words, begin, end).select(
        "id", "n", "kind", F.count(F.lit(1)).over(group).alias("all"), count(skips).alias("skips"), count(firsts).alias("firsts"),
        top(skips).alias("top_skip"), top(firsts).alias("top_first"), top(whole).alias("top_whole")).filter("all > 1")
    has_whole = F.col("top_whole").isNotNull()
    near = F.when(whole, F.col("firsts")).otherwise(F.col("skips") - 1 + (firsts & has_whole).cast("int"))
    best = F.when(whole, F.col("top_first")).otherwise(F.greatest("top_skip", F.when(firsts, F.col("top_whole"))))
    # the largest of a group has no larger neighbour there; a smaller one is no form of it
    best = F.when(best["n"] > F.col("n"), best)
    return seen.select("id", near.cast("long").alias("n_near"), best.alias("best")).filter("n_near > 0").groupBy("id").agg(
        F.sum("n_near").alias("n_near"), F.max("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``(id, root)`` of words with a form, following forms to the last; each round doubles the steps.

    A form is ``RATIO`` times as frequent as its word, so there are as many steps as the largest count has digits at most.
    """
    roots = stage(forms.select("id", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while True:
        on = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        roots = stage(roots.join(on, "root", "left").select(
            "id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if roots.filter("moved").isEmpty():
            return roots.select("id", "root")


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of a table of distinct words with counts ``(word, n)``."""
    if ratio < 2:
        raise ValueError("a form must be more frequent than its variant")
    written = stage(counts.select("word", "n"), "spelling-words")
    forward = _by_range(written, "word", "begins")
    both = _by_range(forward.withColumn("back", F.reverse("word")), "back", "ends")
    near = near_words(both, _shared_nodes(forward, "word", "begins"), _shared_nodes(both, "back", "ends"))
    words = forward.select(F.element_at("begins", -1).alias("id"), "word", "n")
    form = F.col("best.n") >= ratio * F.col("n")
    known = stage(words.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(form, F.col("best.n")).alias("form_n"), F.when(form, -F.col("best.by")).alias("form")), "spelling-near")
    with_form = known.filter("form IS NOT NULL")
    names = known.select("id", "word")
    named = with_form.select("id", "form").join(_roots(with_form), "id")
    named = named.join(names.select(F.col("id").alias("form"), F.col("word").alias("form_word")), "form")
    named = named.join(names.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "form_word", "root_word")
    return known.join(named, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
