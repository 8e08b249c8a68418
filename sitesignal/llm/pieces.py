"""N-best piece segmentations: forward Viterbi, then backward A* search.

The lattice of a text holds every piece of the vocabulary that matches
somewhere, and the bytes of characters that no piece covers. The forward pass
gives the best score of every prefix. A search from the end uses it as its
estimate of what is still missing; being exact, it makes the search pop
complete segmentations in order of their score and visit nothing else.

No piece reaches over a blank, so the lattice of a text falls apart into
words. The forward pass runs over all new words of a batch at once, a matrix
per word length, and also gives each word's loss: how much its score falls
when it leaves its best path. The N best segmentations of a text differ from
its best one in the N - 1 words of least loss at most, so the backward search
is run for those words alone, and their N best combine to the text's.

What a worker remembers of words is bounded in bytes and emptied when full, and
so are the matrices of the forward pass; a worker keeps it from task to task
where texts are digested, and empties it at the end of a task where rows go on.

A null or empty text has one segmentation, the empty one, with score 0. White
space is kept as it is; decoding gives back the text exactly. Segmentations of
equal score come in a fixed order. Texts are read whole; a very long run
without blanks is one lattice, whose paths share their ends in memory. Repeated
rows are encoded alike, and an empty table gives an empty result. Columns of the
input named ``scores`` or ``segmentations`` are replaced by the new ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, count
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitesignal.llm.text import list_column, return_memory

BLANK = "▁"
UNUSED_SCORE = -1e8
BYTE_PENALTY = 10.0
N_BEST = 8
#: what an encoder remembers at most: words with their best ids, and searched words with their segmentations
WORD_BYTES, SEARCH_BYTES = 96 << 20, 64 << 20
#: of a remembered word or id tuple beside its characters and ids
ENTRY_BYTES = 240
#: characters of texts that are encoded at a time
BATCH_CHARS = 1 << 20
#: values that a forward pass holds per table
CELLS = 1 << 20
#: the part of all these bounds where the rows go on to other steps, whose memory the executor holds as well
ROWS_SHARE = 0.25
#: words of more characters, or with a blank of their own, are solved one by one
LONGEST = 32
HASH_BASE = 0x9E3779B97F4A7C15
SLOT_BASE = 0xD6E8FEB86659FD93
SLOT_BITS = 20

Segmentation = tuple[float, tuple[int, ...]]
#: of many words: best scores, losses, numbers of ids, and all ids
Forward = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Pieces:
    """Vocabulary of a sentence-piece model file: pieces with scores, and byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[str | bytes] = []
        self.score: dict[str, tuple[int, float]] = {}
        self.byte_id = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
                continue
            self.text.append(piece)
            if not (model.is_control(i) or model.is_unknown(i)) and model.get_score(i) > UNUSED_SCORE:
                self.score[piece] = (i, model.get_score(i))
        least = min((s for _, s in self.score.values()), default=0.0)
        blank = model.piece_to_id(BLANK)
        if BLANK not in self.score and not model.is_unknown(blank):  # the lone blank may be marked unused, but spaces need it
            self.score[BLANK] = (blank, least)
        self.byte_score = least - BYTE_PENALTY
        #: every beginning of a piece, so that a search along a text knows when to stop
        self.begins = {p[:n] for p in self.score for n in range(1, len(p) + 1)}
        spelled = [p if type(p) is bytes else p.replace(BLANK, " ").encode("utf-8") for p in self.text]
        self.sizes = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.longest = max(map(len, self.score))
        known = sorted((self._hash(p), *self.score[p]) for p in self.score if BLANK not in p[1:])
        self.hashes = np.array([k for k, _, _ in known], np.uint64)
        self.ids = np.array([i for _, i, _ in known], np.int64)
        self.scores = np.array([v for _, _, v in known], np.float64)
        #: place of a piece in the sorted hashes, by the top bits of its hash; -1 where no piece is, -2 where several are
        slots = (self.hashes * np.uint64(SLOT_BASE) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.slots[slots] = np.arange(len(slots))
        used, times = np.unique(slots, return_counts=True)
        self.slots[used[times > 1]] = -2

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * HASH_BASE + ord(c)) % (1 << 64)
        return h

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes among the pieces' hashes; one past the last for no piece."""
        at = self.slots[h * np.uint64(SLOT_BASE) >> np.uint64(64 - SLOT_BITS)]
        several = np.flatnonzero(at == -2)
        at[several] = np.minimum(np.searchsorted(self.hashes, h[several]), len(self.hashes) - 1)
        return np.where((at >= 0) & (self.hashes[at] == h), at, len(self.hashes))

    def forward(self, words: list[str]) -> Forward:
        """Of words of one length, none with a blank of its own, each after a blank.

        Rows are places in the word and columns are words.
        """
        size, count = len(words[0]) + 1, len(words)
        columns = np.arange(count)
        points = np.array([BLANK + w for w in words], f"<U{size}").view(np.uint32).reshape(count, size).T.astype(np.uint64)
        scores, ids = np.append(self.scores, -np.inf), np.append(self.ids, 0)
        best = np.full((size + 1, count), -np.inf)
        best[0] = 0.0
        loss = np.full_like(best, np.inf)
        length, taken = np.zeros(best.shape, np.int64), np.zeros(best.shape, np.int64)
        values, found = [], []
        h = np.zeros_like(points)
        for n in range(1, min(size, self.longest) + 1):
            h = h[: size - n + 1] * np.uint64(HASH_BASE) + points[n - 1:]
            at = self._find(h.ravel()).reshape(h.shape)
            value, number = scores[at], ids[at]
            if n == 1:
                raw = at == len(self.hashes)
                width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
                value, number = np.where(raw, self.byte_score * width, value), np.where(raw, -1 - points.astype(np.int64), number)
            values.append(value)
            found.append(number)
        for end in range(1, size + 1):
            top, second = best[end], np.full(count, -np.inf)
            for n in range(1, min(end, len(found)) + 1):
                value = best[end - n] + values[n - 1][end - n]
                better = value > top
                np.maximum(second, np.minimum(value, top), out=second)
                np.maximum(value, top, out=top)
                length[end][better], taken[end][better] = n, found[n - 1][end - n][better]
            loss[end] = top - second
        place, least, path = np.full(count, size), np.full(count, np.inf), []
        while place.any():
            least = np.minimum(least, np.where(place > 0, loss[place, columns], np.inf))
            path.append(np.where(place > 0, taken[place, columns], 0))
            place = place - length[place, columns]
        steps = np.stack(path[::-1], axis=1).astype(np.int32)
        used = steps != 0
        sizes, flat = used.sum(axis=1), steps[used]
        if (flat < 0).any():
            flat, width = self._spelled(flat)
            sizes = np.bincount(np.repeat(np.arange(count), sizes), width, count).astype(np.int64)
        return best[size], least, sizes, flat

    def _spelled(self, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes in place of the characters that no piece covers, and how many ids stand for each step."""
        raw = steps < 0
        point = np.where(raw, -1 - steps, 0)
        width = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        out, point, of = np.repeat(steps, width), np.repeat(point, width), np.repeat(width, width)
        left = np.repeat(np.cumsum(width), width) - 1 - np.arange(len(out))
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[of]
        byte = np.where(left == of - 1, lead | point >> 6 * left, 0x80 | point >> 6 * left & 0x3F)
        negative = out < 0
        out[negative] = np.array(self.byte_id)[byte[negative]]
        return out, width

    def edges(self, segment: str, blank: bool) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end, the pieces that end there: start, score, ids. A piece with a blank fits only the blank before the segment."""
        score, begins, size = self.score, self.begins, len(segment)
        out: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
        for start in range(size):
            own = segment[start]
            covered = False
            if own != BLANK or blank and not start:
                for end in range(start + 1, size + 1):
                    part = segment[start:end]
                    if part not in begins:
                        break
                    if part in score and BLANK not in part[1:]:
                        found, value = score[part]
                        out[end].append((start, value, (found,)))
                        covered = covered or end == start + 1
            if not covered:
                raw = own.encode("utf-8", "surrogatepass")
                out[start + 1].append((start, self.byte_score * len(raw), tuple(self.byte_id[b] for b in raw)))
        return out

    def nbest(self, segment: str, n: int, blank: bool = False) -> list[Segmentation]:
        """The ``n`` best segmentations, best first; of equal ones, that which was nearer to its start comes first."""
        edges = self.edges(segment, blank)
        best = [0.0] + [-inf] * len(segment)
        for end in range(1, len(segment) + 1):
            best[end] = max(best[start] + value for start, value, _ in edges[end])
        order = count()
        # a path is its first piece and the path after it, so all paths together take a link per step
        heap: list[tuple] = [(-best[-1], len(segment), next(order), 0.0, None)]
        out: list[Segmentation] = []
        while heap and len(out) < n:
            _, at, _, gained, path = heappop(heap)
            if not at:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((gained, tuple(ids)))
                continue
            for start, value, found in edges[at]:
                heappush(heap, (-(best[start] + gained + value), start, next(order), gained + value, (found, path)))
        return out

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of lists of ids: bytes and blanks put back, less the blank before the first word."""
        size = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.spelling[np.repeat(self.starts[ids] - ends[:-1], size) + np.arange(ends[-1])]
        of_text = ends[offsets]
        used = np.diff(of_text) > 0
        keep = np.ones(len(data), bool)
        keep[of_text[:-1][used]] = False
        out = np.concatenate([[0], np.cumsum(np.diff(of_text) - used)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(out) - 1, pa.py_buffer(out), pa.py_buffer(data[keep]))

    def decode(self, ids: list[int]) -> str:
        return self.texts(np.array(ids, np.int64), np.array([0, len(ids)]))[0].as_py()


def best_sums(parts: list[list[Segmentation]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best choices of one segmentation per part: total score and the choices."""
    chosen: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for own in parts:  # the i-th choice with the k-th of a part has (i + 1) * (k + 1) - 1 others before it
        chosen = sorted((loss - own[k][0], taken + (k,)) for i, (loss, taken) in enumerate(chosen) for k in range(min(len(own), n // (i + 1))))[:n]
    return [(-loss, taken) for loss, taken in chosen]


class Column:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.size = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data[:self.size], np.empty(max(end, self.size // 2), self.data.dtype)])
        self.data[self.size:end] = values
        self.size = end

    def all(self) -> np.ndarray:
        return self.data[:self.size]


class Encoder:
    """Texts to their N best segmentations, with memories of words that are emptied when full."""

    def __init__(self, pieces: Pieces, n: int, share: float = 1.0):
        self.pieces, self.n, self.share = pieces, n, share
        self.forget()

    def forget(self) -> None:
        self._forget()
        self._forget_searched()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.score, self.loss, self.size, self.flat = (Column(kind) for kind in (np.float64, np.float64, np.int64, np.int32))
        self.characters = 0

    def _forget_searched(self) -> None:
        self.searched: dict[str, list[Segmentation]] = {}
        self.searched_bytes = 0

    def remembered(self) -> int:
        """Bytes of the words remembered."""
        return ENTRY_BYTES * len(self.row) + 4 * (self.characters + self.flat.size)

    def _add(self, words: list[str], found: Forward) -> None:
        for column, values in zip((self.score, self.loss, self.size, self.flat), found):
            column.add(values)
        self.row.update(zip(words, range(len(self.row), len(self.row) + len(words))))
        self.characters += sum(map(len, words))

    def learn(self, texts: list[list[str]]) -> None:
        """Forward pass over the words that are new."""
        if self.remembered() > self.share * WORD_BYTES:
            self._forget()
        by_size: dict[int, list[str]] = {}
        for w in set().union(*texts).difference(self.row):
            if len(w) <= LONGEST and BLANK not in w and "\0" not in w:
                by_size.setdefault(len(w), []).append(w)
            else:
                found = self.search(w, max(2, self.n))
                gap = found[0][0] - found[1][0] if len(found) > 1 else inf
                self._add([w], (np.array([found[0][0]]), np.array([gap]), np.array([len(found[0][1])]), np.array(found[0][1], np.int32)))
        for size, same in by_size.items():
            step = max(1, int(self.share * CELLS) // ((size + 1) * min(size + 1, self.pieces.longest)))
            for at in range(0, len(same), step):
                part = same[at:at + step]
                self._add(part, self.pieces.forward(part))
        self.starts = np.cumsum(self.size.all()) - self.size.all()

    def search(self, word: str, n: int) -> list[Segmentation]:
        found = self.searched.get(word)
        if found is None:
            found = self.pieces.nbest(BLANK + word, n, True)
            cost = 4 * len(word) + sum(ENTRY_BYTES + 8 * len(ids) for _, ids in found)
            if self.searched_bytes + cost > self.share * SEARCH_BYTES:
                self._forget_searched()
            self.searched[word] = found
            self.searched_bytes += cost
        return found

    def encode(self, texts: list[str | None]) -> list[list[tuple[float, np.ndarray]]]:
        """The segmentations of each text, best first."""
        return list(self.each(texts))

    def each(self, texts: list[str | None]) -> Iterator[list[tuple[float, np.ndarray]]]:
        split = [t.split(" ") if t else [] for t in texts]
        self.learn(split)
        rows = np.fromiter(map(self.row.__getitem__, chain.from_iterable(split)), np.int64)
        sizes, scores, losses = self.size.all()[rows], self.score.all()[rows], self.loss.all()[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat.all()[np.repeat(self.starts[rows] - ends[:-1], sizes) + np.arange(ends[-1])]
        at = 0
        for words in split:
            to = at + len(words)
            yield self._best(words, scores[at:to], losses[at:to], ends[at:to + 1], ids) if words else [(0.0, np.zeros(0, np.int32))]
            at = to

    def _best(self, words: list[str], scores: np.ndarray, losses: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> list[tuple[float, np.ndarray]]:
        """Segmentations of one text from its words; ``ends`` says where the best ids of each lie."""
        others = self.n - 1
        if not others:
            return [(float(scores.sum()), ids[ends[0]:ends[-1]])]
        open_ = np.argpartition(losses, others - 1)[:others] if others < len(losses) else np.arange(len(losses))
        if others < len(losses):  # of equal losses, the words that come first
            least = losses[open_].max()
            below = np.flatnonzero(losses < least)
            open_ = np.concatenate([below, np.flatnonzero(losses == least)[:others - len(below)]])
        open_ = sorted(i for i in open_.tolist() if losses[i] < inf)
        rest = float(scores.sum() - scores[open_].sum())
        found, out = [self.search(words[i], self.n) for i in open_], []
        for score, taken in best_sums(found, self.n):
            parts, at = [], int(ends[0])
            for i, own, k in zip(open_, found, taken):
                if k:
                    parts += [ids[at:ends[i]], np.array(own[k][1], np.int32)]
                    at = int(ends[i + 1])
            out.append((rest + score, np.concatenate([*parts, ids[at:ends[-1]]])))
        return out


@lru_cache(maxsize=1)
def _encoder(path: str, n: int, share: float = 1.0) -> Encoder:
    return Encoder(Pieces(path), n, share)


def _slices(column: pa.Array, share: float = 1.0) -> Iterator[tuple[int, int, list[str | None]]]:
    """Texts of a column, about ``BATCH_CHARS`` at a time; no others are Python objects meanwhile."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < len(ends):
        to = min(len(ends), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + share * BATCH_CHARS)) + 1)
        yield at, to, column.slice(at, to - at).to_pylist()
        at = to


def encoded(docs: DataFrame, path: str, n: int = N_BEST, text_col: str = "text") -> DataFrame:
    """Adds ``scores``, best first, and ``segmentations``, the ids of each, to the rows. ``path`` is the model file, there on every executor."""
    names = {"scores", "segmentations"} & set(docs.columns)
    rows = docs.drop(*names) if names - {text_col} else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, n, ROWS_SHARE)
        try:
            for whole in batches:
                for at, to, texts in _slices(whole[text_col], ROWS_SHARE):
                    found = encoder.encode(texts)
                    flat = [ids for best in found for _, ids in best]
                    per_text = np.concatenate([[0], np.cumsum([len(best) for best in found])])
                    ids = list_column(np.concatenate([np.zeros(0, np.int32), *flat]), np.concatenate([[0], np.cumsum([len(x) for x in flat])]), pa.int32())
                    scores = list_column(np.array([s for best in found for s, _ in best], np.float64), per_text, pa.float64())
                    nested = pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), ids)
                    yield pa.RecordBatch.from_arrays([*whole.slice(at, to - at).columns, scores, nested], [*whole.schema.names, "scores", "segmentations"])
        finally:  # the worker lives on, idle or in other steps of its job
            encoder.forget()
            return_memory()

    schema = T.StructType([*rows.schema.fields, T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("segmentations", T.ArrayType(T.ArrayType(T.IntegerType())))])
    return rows.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: number of pieces of the best segmentation, scores of all and crc32 of the ids of each (as 32-bit
    little-endian integers), best first, and whether decoding every one of them gives the text."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, n)
        for whole in batches:
            for at, to, texts in _slices(whole["text"]):
                sizes, scores, hashes, same = [], [], [], []
                for text, best in zip(texts, encoder.each(texts)):
                    sizes.append(len(best[0][1]))
                    scores.append([s for s, _ in best])
                    hashes.append([zlib.crc32(ids.astype("<i4", copy=False)) for _, ids in best])
                    ends = np.cumsum([0, *(len(ids) for _, ids in best)])
                    back = encoder.pieces.texts(np.concatenate([ids for _, ids in best]), ends)
                    same.append(set(back.to_pylist()) == {text or ""})
                yield pa.RecordBatch.from_arrays(
                    [whole["id"].slice(at, to - at), pa.array(sizes, pa.int64()), pa.array(scores, pa.list_(pa.float64())),
                     pa.array(hashes, pa.list_(pa.int64())), pa.array(same, pa.bool_())],
                    ["id", "n_pieces", "scores", "ids_crc32", "round_trip"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_pieces long, scores array<double>, ids_crc32 array<long>, round_trip boolean")
