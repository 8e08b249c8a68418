"""Resampling towards a target distribution by importance weights over hashed word runs.

The texts of a batch are joined with a sentinel that no word holds, one regex
pass finds all words, and a binary search in the documents' offsets says whose
they are. A run of words is a feature only where its first and last word have
the same document, so runs over a sentinel are masked before anything is
counted. A run's hash continues that of its words less the last one; all runs of
a batch are hashed together, a byte of each at a time.

Counts cover every row of both tables: each task sums its own buckets and sends
those, so what is shuffled depends on the tasks and buckets, never on the words.
Weights need the counts, so the texts are read a second time instead of being
kept. Draws are ranked by a range sort of narrow rows; a rank is the place in
its range plus the sizes of the ranges before it.

Null and empty texts have no features, weight 0, and are never drawn. A null id
is drawn with the key of an empty one and comes after equal scores with an id;
repeated rows are drawn each for itself, in an order of their own. With no
target rows all gains follow from the pseudo-counts alone. An empty table gives
an empty result. Columns of the input other than id and text are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesignal.llm.text import packed, unpacked
from sitesignal.session import stage

BUCKETS = 10_000
RUN = 3
PERCENT = 5
MIN_WORDS = 20
SEED = 42

SENTINEL = b"\0"
#: text bytes that are joined at a time; a longer text is a batch of its own
BATCH_BYTES = 1 << 21
#: words of more bytes are hashed one by one
LONG_WORD = 64
#: of text in UTF-8 whose A-Z are lower case: digits, letters, and all bytes of other characters
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(_POLYNOMIAL), value >> 1).astype(np.uint32)
    return value


_CRC = _crc_table()


def _with_byte(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _CRC[(state ^ np.uint32(byte) if isinstance(byte, int) else state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8))


class Joined:
    """Words of several texts in one stretch of bytes, with the text each belongs to."""

    def __init__(self, texts: list[bytes]):
        self.raw = SENTINEL.join(texts).lower()
        self.data = np.frombuffer(self.raw, np.uint8)
        spans = np.fromiter(chain.from_iterable(m.span() for m in _WORDS.finditer(self.raw)), np.int64).reshape(-1, 2)
        self.start, self.size = spans[:, 0], spans[:, 1] - spans[:, 0]
        ends = np.cumsum([len(t) + len(SENTINEL) for t in texts])
        self.text = np.searchsorted(ends, self.start, side="right")
        self.by_size = np.argsort(-self.size, kind="stable")

    def _append(self, state: np.ndarray, words: np.ndarray) -> np.ndarray:
        """States of the hash after these words, which come by falling size; ``state`` is in their order."""
        start, size = self.start[words], self.size[words]
        out = state.copy()
        long = int(np.searchsorted(-size, -LONG_WORD))
        for i in range(long):
            whole = self.raw[start[i]:start[i] + size[i]]
            out[i] = zlib.crc32(whole, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        start, size = start[long:], size[long:]
        rest = out[long:]
        for k in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -k))  # words of more than k bytes
            rest[:n] = _with_byte(rest[:n], self.data[start[:n] + k])
        return out

    def features(self, run: int = RUN, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each number of words in a run: the text and the bucket of every such run."""
        state = np.full(len(self.start), 0xFFFFFFFF, np.uint32)  # of the run that ends at each word
        last = self.by_size
        for n in range(run):
            if n:
                last = last[last >= n]
                last = last[self.text[last] == self.text[last - n]]
                grown = self._append(_with_byte(state[last - 1], 0x20), last)
            else:
                grown = self._append(state[last], last)
            state = state.copy()
            state[last] = grown
            yield self.text[last], ((grown ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64)


def _joined(column: pa.Array) -> Iterator[tuple[int, int, Joined]]:
    """Stretches of a column of texts, each with its first row and the row after its last."""
    texts = pc.fill_null(column, "").cast(pa.binary()).to_pylist()
    at, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BATCH_BYTES:
            yield at, i, Joined(texts[at:i])
            at, size = i, 0
        size += len(text) + 1
    if texts:
        yield at, len(texts), Joined(texts[at:])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, joined in _joined(batch["text"]):
            for _, buckets in joined.features():
                counts += np.bincount(buckets, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features per bucket over the column ``text`` of all rows; ``BUCKETS`` sums reach the driver, whatever the input."""
    sums = texts.select("text").mapInArrow(_tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS, np.int64)
    for r in sums:
        counts[r["bucket"]] = r["n"]
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: 1000 times the log of target against raw probability, rounded down."""
    raw_all, target_all = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * raw_all / ((s + 1.0) * target_all))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weighted(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """``rows`` must hold ``text``; the other columns pass through, beside ``n_words``, ``n_features`` and ``weight``."""
    others = [f for f in rows.schema.fields if f.name != "text"]
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.astype(np.float64)  # sums of whole numbers are exact
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for at, to, joined in _joined(batch["text"]):
                for n, (text, buckets) in enumerate(joined.features()):
                    found = np.bincount(text, minlength=to - at)
                    if not n:
                        out[0, at:to] = found
                    out[1, at:to] += found
                    out[2, at:to] += np.bincount(text, weights=gain[buckets], minlength=to - at).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in others), *map(pa.array, out)],
                                             [*(f.name for f in others), "n_words", "n_features", "weight"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "n_words long, n_features long, weight long"])
    return rows.mapInArrow(run, schema)


def noise(id_column: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel draw that depends on the seed and the id alone, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``scored`` must be a written table of ``rid, id, n_words, score, ...``; adds ``rank``, null where a row is not drawn."""
    spark = scored.sparkSession
    able = scored.filter(F.col("n_words") >= min_words)
    quota = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("rid").asc()]
    # the number of a row in its task's sorted range, made in the task that sorts it
    placed = stage(able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "resample-order")
    part = F.shiftright("place", 33)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row per range
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "part long, before long")
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= quota, rank))
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*rest.columns).unionByName(rest)


def _scored(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_col: str, seed: int) -> DataFrame:
    texts = docs.select(docs[text_col].alias("text"))
    table = gains(bucket_counts(texts), bucket_counts(target.select(target[target_col].alias("text"))))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    return stage(weighted(rows, table).withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "resample-scores")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
              percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``(id, n_features, weight, score, rank)``, one row per row of ``docs``; ``rank`` is null where a row is not drawn."""
    return ranked(_scored(docs, target, id_col, text_col, target_col, seed), percent, min_words).select("id", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
         percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` whole, all columns as they were. Of repeated ids as many rows stay as were drawn, those of the same text alike."""
    texts = packed(docs, id=docs[id_col], sha=F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))
    whole = stage(texts.withColumn("rid", F.monotonically_increasing_id()), "resample-rows")
    inner = whole.select("rid", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").alias("text"))
    table = gains(bucket_counts(inner), bucket_counts(target.select(target[target_col].alias("text"))))
    scored = stage(weighted(inner, table).withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "resample-scores")
    picked = ranked(scored, percent, min_words).filter("rank IS NOT NULL").select("rid")
    return unpacked(whole.join(picked, "rid", "left_semi"), docs)
