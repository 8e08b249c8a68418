"""Quality rules: counts per text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed character trigrams are counted: one over the
trusted documents, one over the whole corpus. A document's score is the mean,
over its trigrams, of the log of trusted against raw probability. Both counts
get the same pseudo-count, ``ALPHA`` of the trusted trigrams per counter, so a
trigram too rare to tell scores about 0, and the same corpus several times over
gets the same scores. A document stays if it passes the base rules and
its score is at least ``THRESHOLD``, the same for every document.

Counts cover all rows; only the table of ``BUCKETS`` ratios has a fixed size.

A null or empty text has no words and fails. Texts of fewer than three
characters have no trigram and score 0. Repeated rows count and score alike.
Labels may repeat an id: it is trusted if all its labels say so. A null id has
no label. Without trusted rows every score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.llm.text import code_points, maybe_wanted, packed, pieces_of, returning, unpacked
from sitesignal.session import stage

BUCKETS = 1 << 16
#: pseudo-count of each counter, as a share of the trusted trigrams per counter
ALPHA = 0.2
THRESHOLD = -0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: trusted ids that are broadcast at most, 64 MB in memory
BROADCAST_IDS = 1_000_000
#: rows that are Python objects at once
SLICE_ROWS = 500

_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_SYMBOL = np.isin(np.arange(128), [ord(c) for c in SYMBOLS])


def trigrams(points: np.ndarray) -> np.ndarray:
    """Counter of each run of three characters."""
    if len(points) < 3:
        return np.zeros(0, np.int64)
    a, b, c = points[:-2] * np.uint32(0x9E3779B1), points[1:-1] * np.uint32(0x85EBCA77), points[2:] * np.uint32(0xC2B2AE3D)
    mixed = a ^ (b + (a >> np.uint32(15))) ^ (c + (b >> np.uint32(13)))
    mixed *= np.uint32(0x27D4EB2F)
    return (mixed >> np.uint32(16)).astype(np.int64)


def repeated_words(words: list[str]) -> int:
    """Words that lie in a run of three words found at least twice."""
    if len(words) < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    _, pair = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)
    _, run, times = np.unique(pair * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = times[run] > 1
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift:len(words) - 2 + shift] |= twice
    return int(inside.sum())


def base_counts(text: str, points: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = _WORDS(text)
    symbols = int(_SYMBOL[points[points < 128]].sum())
    lines = [line for line in text.split("\n") if _WORDS(line)] if "\n" in text else []
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated_words(words)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``l_id`` of rows that all labels call good."""
    good = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").alias("q"))
    return good.filter("q = 1").select("l_id")


def trusted_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``(text, trusted, raw)``: every text once with ``raw``, and every trusted one once with ``trusted``, in the same row or another.

    Up to ``broadcast_ids`` trusted ids are broadcast and mark the texts where
    they are read. Beyond that the texts are read a second time: a bit filter of
    fixed size lets few but the trusted ones out of the scan, and only what it
    lets out is shuffled to meet its label.
    """
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    good = stage(trusted_ids(labels), "quality-trusted")
    yes, no = F.lit(True), F.lit(False)
    if good.limit(broadcast_ids + 1).count() <= broadcast_ids:
        marked = rows.join(F.broadcast(good.withColumn("good", yes)), F.col("id") == F.col("l_id"), "left")
        return marked.select("text", F.coalesce("good", no).alias("trusted"), yes.alias("raw"))
    near = maybe_wanted(rows, good, "l_id", "id").join(good, F.col("id") == F.col("l_id"), "left_semi")
    return rows.select("text", no.alias("trusted"), yes.alias("raw")).unionByName(near.select("text", yes.alias("trusted"), no.alias("raw")))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in pieces_of(batches, SLICE_ROWS):
        for text, raw, trusted in zip(batch["text"].to_pylist(), batch["raw"].to_pylist(), batch["trusted"].to_pylist()):
            own = np.bincount(trigrams(code_points(text)), minlength=BUCKETS)
            for which, of in enumerate((raw, trusted)):
                if of:
                    counts[which] += own
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(c[used]) for c in counts)], ["feature", "raw", "trusted"])


def ratios(rows: DataFrame) -> np.ndarray:
    """Log of trusted against raw probability per counter, from ``(text, trusted)`` and maybe ``raw``; at most ``BUCKETS`` rows reach the driver."""
    rows = rows.select("text", "trusted", "raw" if "raw" in rows.columns else F.lit(True).alias("raw"))
    sums = rows.mapInArrow(returning(_tally), "feature long, raw long, trusted long").groupBy("feature").agg(
        F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).collect()
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums:
        raw[r["feature"]], trusted[r["feature"]] = r["raw"], r["trusted"]
    if not trusted.sum():
        return np.zeros(BUCKETS, np.float32)
    expected = raw * (trusted.sum() / raw.sum())
    pseudo = ALPHA * trusted.sum() / BUCKETS
    return np.log((trusted + pseudo) / (expected + pseudo)).astype(np.float32)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(rows: DataFrame, table: np.ndarray, threshold: float = THRESHOLD, text_col: str | None = None) -> DataFrame:
    """``rows`` must hold ``text``, or a struct ``row`` with the column ``text_col``, which is then sent to Python once; the other
    columns pass through, beside the counts, ``base_failed``, ``kept`` and ``score``."""
    others = [f for f in rows.schema.fields if f.name != "text"]
    inside = None if text_col is None else rows.schema["row"].dataType.names.index(text_col)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in pieces_of(batches, SLICE_ROWS):
            counts, scores = [], []
            for text in (batch["text"] if inside is None else pc.struct_field(batch["row"], inside)).to_pylist():
                points = code_points(text or "")
                counts.append(base_counts(text or "", points))
                found = trigrams(points)
                scores.append(float(table[found].mean(dtype=np.float64)) if len(found) else 0.0)
            columns = np.array(counts, np.int64).reshape(-1, len(_COUNTS)).T
            failed = (columns[0] < MIN_WORDS) | (100 * columns[4] > MAX_REPEAT_PERCENT * columns[0])
            score = np.array(scores)
            yield pa.RecordBatch.from_arrays(
                [*(batch[f.name] for f in others), *map(pa.array, columns), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)],
                [*(f.name for f in others), *_COUNTS, "base_failed", "kept", "score"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in others), *(f"{c} long" for c in _COUNTS),
                        "base_failed boolean", "kept boolean", "score double"])
    return rows.mapInArrow(returning(run), schema)


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    table = ratios(trusted_rows(docs, labels, id_col, text_col))
    return judge(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), table, threshold)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that stay, all columns as they were."""
    table = ratios(trusted_rows(docs, labels, id_col, text_col))
    plain = text_col in docs.columns
    judged = judge(packed(docs) if plain else packed(docs, text=docs[text_col]), table, threshold, text_col if plain else None)
    return unpacked(judged.filter("kept"), docs)
