"""Words, whitespace and row helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesignal.session import stage

SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def squeezed(text: Column) -> Column:
    """The text with every run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def word_hashes(text: Column) -> Column:
    """64-bit hash of each word, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def packed(docs: DataFrame, **needed: Column) -> DataFrame:
    """The whole row as one struct ``row`` beside the named columns, so that no column of the input can clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in needed.items()])


def unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit words that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each list, with their offsets.

    A list with some words, but fewer than ``size``, has one run: all of it.
    """
    n = len(hashes)
    h = hashes.astype(np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(n, np.uint64)
    for i in range(size):
        shifted = np.zeros(n, np.uint64)
        if i < n:
            shifted[: n - i] = h[i:]
        rolled = mix64(rolled + step) ^ shifted
    rolled = mix64(rolled)
    lengths = np.diff(offsets)
    counts = np.maximum(lengths - size + 1, 0)
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    counts[short] = 1
    out_offsets = np.concatenate([[0], np.cumsum(counts)])
    take = np.repeat(offsets[:-1] - out_offsets[:-1], counts) + np.arange(out_offsets[-1])
    out = rolled[take]
    for i in short:  # the rolled value would reach into the next list
        value = np.zeros(1, np.uint64)
        for w in h[offsets[i]:offsets[i + 1]]:
            value = mix64(value + step) ^ w
        out[out_offsets[i]] = mix64(value + np.uint64(lengths[i]))[0]
    return out, out_offsets


def run_hashes(hashes: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hashes, as ``windows`` has them, of the runs of ``size`` words that start there."""
    h = hashes.astype(np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(len(start), np.uint64)
    for i in range(size):
        rolled = mix64(rolled + step) ^ h[start + i]
    return mix64(rolled)


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def return_memory() -> None:
    """Give what this worker has freed back to the system; it may live on, idle or in other steps, beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it, and alone needs it
        trim(0)


def returning(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The step, with its freed memory given back when a task ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            return_memory()

    return run


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _bit_matched(rows: DataFrame, wanted: DataFrame, wanted_key: str, key: str, inside: bool) -> DataFrame:
    count = wanted.count()
    bits = int(min(25, max(12, np.ceil(np.log2(8 * max(1, count))))))

    def place(column: str) -> Column:
        return F.shiftrightunsigned(F.xxhash64(column), 64 - bits)

    filters = wanted.select(place(wanted_key).alias("p")).groupBy(F.shiftright("p", 6).alias("filter_row")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("filter_bits"))
    own = rows.withColumn("filter_place", place(key)).withColumn("filter_row", F.shiftright("filter_place", 6))
    is_set = F.expr("shiftright(filter_bits, cast(filter_place & 63 AS int)) & 1 = 1")
    met = own.join(F.broadcast(filters), "filter_row", "inner" if inside else "left")
    return met.filter(is_set if inside else ~F.coalesce(is_set, F.lit(False))).drop("filter_row", "filter_bits", "filter_place")


def maybe_wanted(rows: DataFrame, wanted: DataFrame, wanted_key: str, key: str) -> DataFrame:
    """``rows`` without most whose key no row of ``wanted`` has, before a join that decides exactly.

    The keys' hashes are kept as one bit each, eight bits for every wanted row,
    as long as that gives at most ``2 ** 25`` bits: half a million rows of 64
    bits, which are broadcast. Of what is not wanted, an eighth passes, and more
    beyond four million wanted rows.
    """
    return _bit_matched(rows, wanted, wanted_key, key, True)


def surely_unwanted(rows: DataFrame, wanted: DataFrame, wanted_key: str, key: str) -> DataFrame:
    """The rows that ``maybe_wanted`` leaves out: no row of ``wanted`` has their key."""
    return _bit_matched(rows, wanted, wanted_key, key, False)


def kept_rows(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows that ``groups``, ``(id, sha, kept)`` per row, does not keep; all columns as they were.

    Only rows whose id may be among the dropped ones are shuffled. Where the
    row that stays is repeated, one of its equal rows stays.
    """
    marks = groups.groupBy("id", "sha").agg(F.max("kept").alias("again"), F.min("kept").alias("all_kept"))
    dropped = stage(marks.filter("NOT all_kept").select(F.col("id").alias("d_id"), F.col("sha").alias("d_sha"), "again"), "dropped-rows")
    whole = packed(docs, id=docs[id_col], text=docs[text_col])
    stay = surely_unwanted(whole, dropped, "d_id", "id").select("row")
    asked = maybe_wanted(whole, dropped, "d_id", "id").select("row", "id", F.sha2(squeezed(F.col("text")), 256).alias("sha"))
    same = F.col("id").eqNullSafe(F.col("d_id")) & (F.col("sha") == F.col("d_sha"))
    left = stay.unionByName(asked.join(dropped, same, "left_anti").select("row"))
    again = dropped.filter("again")
    if not again.isEmpty():
        left = left.unionByName(asked.join(again, same, "left_semi").dropDuplicates(["id", "sha"]).select("row"))
    return unpacked(left, docs)
