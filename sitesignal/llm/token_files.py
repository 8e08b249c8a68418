"""Token ids in files that find a document's boundaries by Elias-Fano select.

A shard is one binary image: header, document ids, Elias-Fano coded ends of
the documents, and the concatenated 16- or 32-bit token ids. The ends are a
rising sequence: each is cut into fixed-width low bits and a unary coded high
part with one bit per document, about ``2 + log2(ids per document)`` bits in
all, where an offset table takes 64. A sample of the positions of every 256th
one lets ``select`` find any end without reading the others.

Shards are written as binary cells of a Parquet table: Spark's committer then
makes them appear whole or not at all, on any store, however often an executor
is lost. Documents are in ascending id order within and across shards, nulls
first. A shard holds at most ``SHARD_IDS`` ids (more only if one document
does), so memory does not grow with the data.

A null text is empty; an empty document holds the end id only. Repeated ids
stay, next to each other, in order of their text's hash. An empty table gives
no shard. Very long texts are encoded chunk by chunk.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAGIC = b"EFTK"
SAMPLE = 256
SHARD_IDS = 1 << 20
MEMO = 600_000


class EliasFano:
    """A rising sequence of integers below ``bound`` with random access."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.width, self.low, self.high, self.sample = n, width, low, high, sample

    @classmethod
    def of(cls, values: np.ndarray, bound: int) -> EliasFano:
        n = len(values)
        width = max(0, int(np.log2(max(1, bound // max(1, n)))))
        low = np.packbits(((values[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> width) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, width, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The ``i``-th value: jump to the sample before it, then count ones."""
        at = int(self.sample[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        current = int(self.high[byte]) & (0xFF << (at % 8)) & 0xFF
        while (ones := current.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            current = int(self.high[byte])
        for _ in range(left):
            current &= current - 1
        position = byte * 8 + (current & -current).bit_length() - 1
        first = i * self.width
        low = 0
        for b in range(self.width):
            low |= ((int(self.low[(first + b) // 8]) >> ((first + b) % 8)) & 1) << b
        return ((position - i) << self.width) | low

    def all(self) -> np.ndarray:
        """Every value at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width).astype(np.int64)
        return ((ones - np.arange(self.n)) << self.width) + bits @ (np.int64(1) << np.arange(self.width, dtype=np.int64))


def write_shard(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids)
    ends = EliasFano.of(np.cumsum([len(x) for x in ids]), len(flat) + 1)
    kind = "<u2" if flat.max(initial=0) < 1 << 16 else "<u4"
    nulls = sum(d is None for d in doc_ids)
    head = struct.pack("<4sBBxxQQQQQ", MAGIC, ends.width, int(kind[-1]), len(ids), len(flat), nulls, len(ends.low), len(ends.high))
    numbers = np.array([d for d in doc_ids if d is not None], "<i8")
    return b"".join([head, numbers.tobytes(), ends.low.tobytes(), ends.high.tobytes(), ends.sample.astype("<u4").tobytes(), flat.astype(kind).tobytes()])


class Shard:
    """A shard image opened for reading."""

    HEAD = struct.calcsize("<4sBBxxQQQQQ")

    def __init__(self, image: bytes):
        magic, width, size, self.n_docs, self.n_ids, nulls, n_low, n_high = struct.unpack_from("<4sBBxxQQQQQ", image)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = self.HEAD

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(image, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids = [None] * nulls + part("<i8", self.n_docs - nulls).tolist()
        low, high, sample = part("u1", n_low), part("u1", n_high), part("<u4", -(-self.n_docs // SAMPLE))
        self.ends = EliasFano(self.n_docs, width, low, high, sample)
        self.ids = part(f"<u{size}", self.n_ids)

    def document(self, i: int) -> np.ndarray:
        """Ids of the ``i``-th document, found by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends.all()])


class _Encoder:
    """Encodes whole texts by the tokenizer file and remembers the ids of what it has seen.

    The file's tokenizer brings text to its composed form, lower-cases it and
    encodes runs of letters, single digits and runs of signs on their own;
    white space only parts them. A text of Latin-1 characters is composed
    already, so it is cut into such runs here and each run goes to the model
    alone. Any other text is cut at blanks only, and the tokenizer encodes its
    chunks. A text that holds an added token of the file (``<|endoftext|>``) goes
    to the tokenizer whole, which gives that token's id. The memory has two generations: what a full old one held is
    forgotten unless it was met again.
    """

    RUN = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[\x00-\x08\x0e-\x1f!-/:-@[-`{-\x84\x86-\x9f¡-©«-±´¶-¸»¿×÷]+")
    CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
    BEYOND_LATIN_1 = re.compile("[^\x00-\xff]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: in any case, since a token may be looked for in the lower-cased text
        self.added = re.compile("|".join(re.escape(x.content) for x in added), re.IGNORECASE) if added else re.compile("(?!)")
        self.model = self.tokenizer.model
        signs = ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_signs = {c: signs.pre_tokenize_str(chr(c))[0][0] for c in range(256)}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, parts: set[str]) -> None:
        if len(self.young) > MEMO:
            self.young, self.old = {}, self.young
        new = parts.difference(self.young)
        self.young.update({x: self.old[x] for x in new.intersection(self.old)})
        other = []
        for x in new.difference(self.old):
            if self.RUN.fullmatch(x):
                self.young[x] = array("I", [t.id for t in self.model.tokenize(x.translate(self.byte_signs))]).tobytes()
            else:
                other.append(x)
        for at in range(0, len(other), 4096):
            some = other[at:at + 4096]
            self.young.update(zip(some, [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if self.added.search(t)]
        encoded = self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)
        split = [self.CHUNK.findall(t) if self.BEYOND_LATIN_1.search(t) else self.RUN.findall(t.lower()) for t in texts]
        for i in whole:
            split[i] = []
        self.learn(set().union(*split))
        out = [np.frombuffer(b"".join(map(self.young.__getitem__, parts)), np.uint32) for parts in split]
        for i, e in zip(whole, encoded):
            out[i] = np.array(e.ids, np.uint32)
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> _Encoder:
    """One encoder per worker process, kept from task to task."""
    return _Encoder(path)


def word_tokenizer(path: str) -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """Makes, on a worker, an encoder of whole texts by the tokenizer file."""
    return partial(_encoder, path)


def encoded_shards(docs: DataFrame, make: Callable, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                   shard_ids: int = SHARD_IDS) -> DataFrame:
    """``(first_id, last_id, part, at, n_docs, n_ids, image)``, one row per shard, ids in order within and across shards."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, encode = TaskContext.get().partitionId(), 0, make()
        names, held, count = [], [], 0

        def image() -> pa.RecordBatch:
            numbers = [x for x in names if x is not None]
            return pa.RecordBatch.from_pylist([{
                "first_id": numbers[0] if numbers and len(numbers) == len(names) else None, "last_id": numbers[-1] if numbers else None,
                "part": part, "at": at, "n_docs": len(names), "n_ids": count, "image": write_shard(names, held)}], schema)

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                for name, ids in zip(some["id"].to_pylist(), encode(some["text"].to_pylist())):
                    if count and count + len(ids) + 1 > shard_ids:
                        yield image()
                        names, held, count, at = [], [], 0, at + 1
                    names.append(name)
                    held.append(np.append(ids, np.uint32(end_id)))
                    count += len(ids) + 1
        if names:
            yield image()

    schema = pa.schema([("first_id", pa.int64()), ("last_id", pa.int64()), ("part", pa.int32()), ("at", pa.int32()), ("n_docs", pa.int64()),
                        ("n_ids", pa.int64()), ("image", pa.binary())])
    return rows.mapInArrow(shards, "first_id long, last_id long, part int, at int, n_docs long, n_ids long, image binary")


def read_documents(shards: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from written shards; ``start`` counts all ids before the document.

    Shards of one range partition add up first, then partitions, so no window
    is longer than the shards of a partition or the number of partitions.
    """
    sizes = shards.select("part", "at", "n_ids")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(upto(Window.orderBy("part"))), F.lit(0)).alias("part_start"))
    starts = sizes.withColumn("in_part", F.coalesce(F.sum("n_ids").over(upto(Window.partitionBy("part").orderBy("at"))), F.lit(0)))
    starts = starts.join(parts, "part").select("part", "at", (F.col("in_part") + F.col("part_start")).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, base = Shard(batch["image"][i].as_py()), batch["base"][i].as_py()
                starts = shard.starts()
                sums = [crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "at", "image").join(starts, ["part", "at"]).select("image", "base").mapInArrow(
        documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
