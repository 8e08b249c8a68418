"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Every block of rows sends, to the owner of each fingerprint range, its sorted
distinct fingerprints as Golomb-coded gaps. An owner answers each block with
one bit per fingerprint: seen elsewhere or not. Only rows whose bit is set are
suspects; their texts are shuffled and grouped by their bytes. A bit filter over
their hashes keeps seven in eight of all other texts in the scan.

Fingerprints are as short as the exchange allows (10 bits more than the row
count needs), so about one row in a thousand is a suspect without a partner;
the bytes decide, never the fingerprint.

Null texts count as empty, so nulls and empty texts are one group. Of equal
texts the smallest id stays, nulls last; of repeated rows with that id, one.
An empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitesignal.llm.text import kept_rows, maybe_wanted, squeezed
from sitesignal.session import stage

BLOCK_ROWS = 16384
OWNER_ROWS = 1 << 21
SPARE_BITS = 10
HASH_BITS = 60
SALTS = 16


def golomb_encode(values: np.ndarray, span: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct integers in ``[0, span)`` as a parameter, unary quotients and fixed-width rests of their gaps."""
    gaps = np.diff(values, prepend=0)
    k = max(0, int(np.log2(max(1.0, span / max(1, len(values)) * np.log(2)))))
    ends = np.cumsum((gaps >> k) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    rests = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rests.ravel()).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, rests: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    low = np.unpackbits(np.frombuffer(rests, np.uint8))[: n * k].reshape(n, k).astype(np.int64)
    return np.cumsum((quotients.astype(np.int64) << k) + low @ (np.int64(1) << np.arange(k, dtype=np.int64)))


_MESSAGE = "owner int, n int, k int, unary binary, rests binary"


def _blocks(narrow: DataFrame, bits: int, owner_bits: int) -> DataFrame:
    """One row per block: its rows in fingerprint order, and its messages to the owners."""
    span, shift = 1 << (bits - owner_bits), bits - owner_bits
    message = pa.list_(pa.struct([("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("unary", pa.binary()), ("rests", pa.binary())]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        count = 0

        def block(table: pa.Table) -> pa.RecordBatch:
            fp = table["fp"].to_numpy() >> (HASH_BITS - bits)
            order = np.argsort(fp, kind="stable")
            table, fp = table.take(pa.array(order)), fp[order]
            sent = []
            distinct = np.unique(fp)
            owners = distinct >> shift
            starts = np.flatnonzero(np.diff(owners, prepend=-1))
            for part in np.split(distinct, starts[1:]):
                owner = int(part[0] >> shift)
                k, unary, rests = golomb_encode(part - owner * span, span)
                sent.append({"owner": owner, "n": len(part), "k": k, "unary": unary, "rests": rests})
            whole = [pa.array([table[c].combine_chunks().to_pylist()], pa.list_(table.schema.field(c).type)) for c in ("rid", "id", "sha")]
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), *whole, pa.array([fp.tolist()], pa.list_(pa.int64())), pa.array([sent], message)],
                ["block", "rid", "id", "sha", "fp", "sent"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                held.append(batch.slice(at, BLOCK_ROWS))
                count += held[-1].num_rows
                if count >= BLOCK_ROWS:
                    yield block(pa.Table.from_batches(held))
                    held, count, number = [], 0, number + 1
        if count:
            yield block(pa.Table.from_batches(held))

    kind = narrow.schema["id"].dataType
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("rid", T.ArrayType(T.LongType())), T.StructField("id", T.ArrayType(kind)),
        T.StructField("sha", T.ArrayType(T.StringType())), T.StructField("fp", T.ArrayType(T.LongType())),
        T.StructField("sent", T.ArrayType(T._parse_datatype_string(_MESSAGE)))])
    return narrow.mapInArrow(encode, schema)


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    """An owner's answer to each block: which of the fingerprints it sent other blocks sent too."""
    sent = [golomb_decode(m.n, m.k, m.unary, m.rests) for m in messages.itertuples()]
    seen, times = np.unique(np.concatenate(sent), return_counts=True)
    shared = seen[times > 1]
    bitmaps = [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in sent]
    return pd.DataFrame({"block": messages["block"], "owner": messages["owner"], "n": messages["n"], "bitmap": bitmaps})


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block again, each with its own suspicion: a partner in its block or, by the bitmaps, in another."""
    for batch in batches:
        for i in range(batch.num_rows):
            rid, ids, sha = (batch[c][i].values for c in ("rid", "id", "sha"))
            fp = batch["fp"][i].values.to_numpy()
            distinct, inverse, times = np.unique(fp, return_inverse=True, return_counts=True)
            answers = sorted(batch["answers"][i].as_py(), key=lambda a: a["owner"])
            bits = np.concatenate([np.unpackbits(np.frombuffer(a["bitmap"], np.uint8))[: a["n"]] for a in answers])
            suspect = (bits.astype(bool) | (times > 1))[inverse]
            yield pa.RecordBatch.from_arrays([rid, ids, sha, pa.array(suspect)], ["rid", "id", "sha", "suspect"])


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(rid, id, sha, suspect)`` per row; rows that are not suspects have no equal."""
    sha = F.sha2(squeezed(docs[text_col]), 256)
    narrow = stage(docs.select(
        F.monotonically_increasing_id().alias("rid"), docs[id_col].alias("id"), sha.alias("sha")).withColumn(
        "fp", F.conv(F.substring("sha", 1, HASH_BITS // 4), 16, 10).cast("long")), "dedup-hashes")
    rows = max(1, narrow.count())
    owner_bits = max(5, int(np.ceil(np.log2(rows / OWNER_ROWS))))
    bits = min(HASH_BITS, max(owner_bits + 8, int(np.ceil(np.log2(rows))) + SPARE_BITS))
    blocks = stage(_blocks(narrow, bits, owner_bits), "dedup-blocks")
    answers = blocks.select("block", F.inline("sent")).groupBy("owner").applyInPandas(
        _answer, "block long, owner int, n int, bitmap binary")
    received = answers.groupBy("block").agg(F.collect_list(F.struct("owner", "n", "bitmap")).alias("answers"))
    kind = narrow.schema["id"].dataType.simpleString()
    return stage(blocks.drop("sent").join(received, "block").mapInArrow(
        _marked, f"rid long, id {kind}, sha string, suspect boolean"), "dedup-suspects")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, keep_id, group_size, kept, sha)``, one row per row of ``docs``."""
    rows = fingerprinted(docs, id_col, text_col)
    suspects = rows.filter("suspect")
    wanted = stage(suspects.select(F.col("sha").alias("w_sha")).distinct(), "suspect-hashes")
    # what is no suspect and passes the filter has a group of its own that no suspect meets
    texts = docs.select(squeezed(docs[text_col]).alias("body")).select(F.sha2("body", 256).alias("sha"), "body")
    equal = maybe_wanted(texts, wanted, "w_sha", "sha").groupBy("sha", "body").agg(F.count(F.lit(1)).alias("group_size")).select("sha", "group_size")
    first = suspects.groupBy("sha").agg(F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("first"))
    links = first.join(equal, "sha").select(
        "sha", "group_size", F.col("first.id").alias("keep_id"), F.col("first.rid").alias("keep_rid"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = suspects.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    linked = salted.join(links, ["sha", "salt"]).select(
        "id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "sha")
    alone = rows.filter("NOT suspect").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return alone.unionByName(linked)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    return kept_rows(docs, exact_groups(docs, id_col, text_col).select("id", "sha", "kept"), id_col, text_col)
