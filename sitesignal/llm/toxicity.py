"""Toxicity of a text: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned first: words, and beginnings of words, that are surely
more widespread among toxic texts than among others. The features of a text are
the densities of its hits (plain, weighted, by beginnings, and hidden behind
signs and digits), how near they are to a second person, and rates of capitals,
punctuation and disguise that need no label. Trees of fixed depth are fitted to
them by Newton steps on the logistic loss; isotonic regression then turns their
sum into a probability.

The classifier is fitted on at most ``FIT_ROWS`` labelled rows, those with the
smallest hash of their id, so its cost does not grow with the table. A row meets
a lexicon, and for calibration also trees, that were learned without its own
fold. Only the rows' ids are sorted and broadcast; texts of other rows are never
shuffled. Every document is scored in a single pass.

An id with several labels is toxic if one of them says so; one with several
texts is learned from its smallest text. Null labels, ids and texts are not
learned from. If nothing can be learned, or one class is missing, every score is
the share of toxic rows (0 without rows). Null and empty texts get the score of
a text without words. Repeated rows score alike; an empty table gives an empty
result. Columns of the input other than id and text never enter a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesignal.session import stage

#: bound of the labelled rows that the classifier is fitted on
FIT_ROWS = 20_000
FOLDS = 4
#: a lexicon entry occurs in so many toxic texts, and its log odds are so many standard errors above the least
LEAST_TEXTS = 4
ERRORS = 2.5
LEAST_ODDS = 0.5
#: letters of the beginnings that are entries as well
BEGINNINGS = (4, 6)
NEAR = 5
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes vosotros tú ti".split())

TREES, DEPTH, RATE, BINS, RIDGE = 80, 3, 0.15, 64, 2.0
#: a split leaves so many rows, or this share of them, on both sides
LEAST_ROWS, LEAST_SHARE = 4, 0.004

_WORD = re.compile(r"\w+")
#: begins where a word does and never gives back, so that it is linear in any text
_HIDDEN = re.compile(r"(?<![^\W_])[^\W_]++(?:[@$!*._|-]++[^\W_]++)++")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_SIGN_LETTERS = str.maketrans("01345@$!|", "oieasasii", "789*._-2 6")
#: task memory of lexicon look-ups and of counts, in entries of a word's size
MEMORY = 200_000

FEATURES = ("log_words", "weighted_density", "hit_density", "log_hits", "distinct_hits", "beginning_density_4", "beginning_density_6", "largest_weight",
            "hits_near_second_person", "second_person_density", "capitals", "capital_words", "exclamations", "questions", "signs", "hidden_rate",
            "hidden_hits", "stretched", "most_of_one_beginning")


def clear(word: str) -> str:
    """A disguised word with letters in place of signs and digits, and without what was put between them."""
    return word.translate(_SIGN_LETTERS)


def terms(word: str) -> list[str]:
    """Entries a word may hit: itself, and its beginnings, marked by a star."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


class Features:
    """Dense features of texts, given a lexicon of weights."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.memory: dict[str, tuple[float, ...]] = {}

    def _weights(self, word: str) -> tuple[float, ...]:
        found = self.memory.get(word)
        if found is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            own = self.lexicon.get
            found = (own(word, 0.0), *(own(f"{word[:n]}*", 0.0) if len(word) > n else 0.0 for n in BEGINNINGS))
            if len(word) <= 64:
                self.memory[word] = found
        return found

    def of(self, text: str | None) -> list[float]:
        text = text or ""
        low = text.lower()
        words = _WORD.findall(low)
        size, n = max(1, len(words)), max(1, len(text))
        total, hits, distinct, largest, by_size = 0.0, 0, 0, 0.0, [0] * len(BEGINNINGS)
        most: Counter[str] = Counter()
        toxic: set[str] = set()
        hidden = hidden_hits = 0
        for word, times in Counter(words).items():
            weights = self._weights(word)
            top = max(weights)
            if top > 0:
                total += top * times
                largest = max(largest, top)
                if weights[0] > 0:
                    hits, distinct = hits + times, distinct + 1
                toxic.add(word)
                for k, w in enumerate(weights[1:]):
                    if w > 0:
                        by_size[k] += times
                        most[word[:BEGINNINGS[k]]] += times
            elif not word.isalpha() and not word.isdigit():
                hidden += times
                hidden_hits += times * (self._weights(clear(word))[0] > 0)
        for word in _HIDDEN.findall(low):
            hidden += 1
            hidden_hits += self._weights(clear(word))[0] > 0
        second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = 0
        if second and toxic:
            at = np.array([i for i, w in enumerate(words) if w in toxic])
            places = np.array(second)
            after = np.searchsorted(places, at)
            gap = np.minimum(np.abs(places[np.minimum(after, len(places) - 1)] - at), np.abs(places[np.maximum(after - 1, 0)] - at))
            near = int((gap <= NEAR).sum())
        capitals = sum(1 for a, b in zip(text, low) if a != b) if len(text) == len(low) else sum(map(str.isupper, text))
        shouted = sum(1 for w in _WORD.findall(text) if len(w) > 1 and w.isupper()) if capitals > 1 else 0
        signs = sum(text.count(c) for c in "#*$%&@|<>")
        return [float(np.log1p(len(words))), total / size, hits / size, float(np.log1p(hits + hidden_hits)), float(distinct), by_size[0] / size, by_size[1] / size,
                largest, near / max(1, sum(by_size) + hits), len(second) / size, capitals / n, shouted / size, text.count("!") / size, text.count("?") / size,
                signs / size, hidden / size, hidden_hits / size, len(_STRETCHED.findall(low)) / size, max(most.values(), default=0) / size]


@dataclass
class Trees:
    """Boosted trees of one depth: a feature and a limit per inner node, a value per leaf."""

    base: float
    feature: list[np.ndarray] = field(default_factory=list)
    limit: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - len(feature)]
        return out


def boosted(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees by Newton steps on the logistic loss, splits searched over histograms of all features at once."""
    n, width = x.shape
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    model = Trees(float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    cell = binned + np.arange(width) * BINS
    margin, least = np.full(n, model.base), max(LEAST_ROWS, int(LEAST_SHARE * n))
    inner = (1 << DEPTH) - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, limit, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, nodes = (1 << depth) - 1, 1 << depth
            at = ((node - first)[:, None] * (width * BINS) + cell).ravel()
            sums = [np.bincount(at, w, nodes * width * BINS).reshape(nodes, width, BINS).cumsum(axis=2) for w in (np.repeat(g, width), np.repeat(h, width), None)]
            left, all_ = sums, [s[:, :, -1:] for s in sums]
            gain = left[0] ** 2 / (left[1] + RIDGE) + (all_[0] - left[0]) ** 2 / (all_[1] - left[1] + RIDGE) - all_[0] ** 2 / (all_[1] + RIDGE)
            gain[(left[2] < least) | (all_[2] - left[2] < least)] = 0.0
            gain = gain[:, :, :-1].reshape(nodes, -1)
            best = gain.argmax(axis=1)
            for k in range(nodes):
                f, b = divmod(int(best[k]), BINS - 1)
                if gain[k, best[k]] > 1e-6 and b < len(edges[f]):
                    feature[first + k], limit[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        margin += value[leaf]
        model.feature.append(feature)
        model.limit.append(limit)
        model.leaf.append(value)
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: mean margin and share of positives of each block, both rising."""
    place, of = np.unique(margin, return_inverse=True)
    blocks: list[list[float]] = []  # rows, positives, sum of margins
    for m, n, k in zip(place, np.bincount(of), np.bincount(of, y)):
        blocks.append([float(n), float(k), float(m * n)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    n, k, m = np.array(blocks).T
    return m / n, k / n


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    knots: np.ndarray
    shares: np.ndarray

    def score(self, texts: list[str | None], features: Features) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if not self.trees.leaf:
            return np.full(len(texts), self.shares[0])
        return np.interp(self.trees.margin(np.array([features.of(t) for t in texts])), self.knots, self.shares)


def chosen_rows(docs: DataFrame, labels: DataFrame, learnable: Column, fit_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``(id, toxic, fold, text)`` of the labelled rows to learn from; ``learnable`` is a condition on the column ``id``."""
    own = labels.select(labels[id_col].alias("id"), labels[label_col].alias("toxic")).filter("id IS NOT NULL AND toxic IS NOT NULL").filter(learnable)
    own = own.groupBy("id").agg((F.max("toxic") > 0).alias("toxic")).withColumn("h", F.xxhash64("id"))
    own = stage(own, "toxic-labels")
    known = own.count()
    if known > 2 * fit_rows:  # hashes are even enough that twice the rows hold the smallest ones; then those are sorted out
        limit = int(2 * fit_rows / known * 2.0**64) - 2**63
        own = own.filter(F.col("h") < limit)
    sample = own.orderBy("h", "id").limit(fit_rows)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).filter("text IS NOT NULL")
    joined = texts.join(F.broadcast(sample), "id")
    return joined.groupBy("id", "toxic", "h").agg(F.min("text").alias("text")).select(
        "id", "toxic", F.pmod(F.shiftright("h", 7), F.lit(FOLDS)).cast("int").alias("fold"), "text")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, Counter[str]] = {}

    def table() -> pa.RecordBatch:
        rows = [(t, g, n) for g, counts in held.items() for t, n in counts.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
                                           pa.array([r[2] for r in rows], pa.int64())], ["term", "part", "n"])

    for batch in batches:
        for text, fold, toxic in zip(batch["text"].to_pylist(), batch["fold"].to_pylist(), batch["toxic"].to_pylist()):
            held.setdefault(2 * fold + toxic, Counter()).update({t for w in set(_WORD.findall(text.lower())) for t in terms(w)})
            if sum(map(len, held.values())) > MEMORY:
                yield table()
    yield table()


def term_counts(rows: DataFrame) -> list[tuple[str, np.ndarray]]:
    """Terms surely more widespread in toxic rows, with the texts of each fold and class that hold them."""
    parts = [F.sum(F.when(F.col("part") == p, F.col("n")).otherwise(0)).alias(f"p{p}") for p in range(2 * FOLDS)]
    total = rows.agg(*[F.sum((F.col("toxic") == F.lit(bool(c))).cast("long")).alias(f"c{c}") for c in (0, 1)]).first()
    clean, toxic = total["c0"] or 0, total["c1"] or 0
    counts = rows.mapInArrow(_tally, "term string, part int, n long").groupBy("term").agg(*parts)
    with_term = [sum((F.col(f"p{2 * f + c}") for f in range(1, FOLDS)), F.col(f"p{c}")) for c in (0, 1)]
    counts = counts.withColumn("b", with_term[0]).withColumn("a", with_term[1]).filter(F.col("a") >= LEAST_TEXTS)
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    found = counts.filter(odds - ERRORS * error > LEAST_ODDS).orderBy("term")
    return [(r["term"], np.array([r[f"p{p}"] for p in range(2 * FOLDS)], np.float64).reshape(FOLDS, 2)) for r in found.collect()]


def _weights(counts: list[tuple[str, np.ndarray]], rows: np.ndarray, without: int | None = None) -> dict[str, float]:
    """Log odds of each term, one fold left out; those below the least are left out as well."""
    use = np.arange(FOLDS) != (-1 if without is None else without)
    clean, toxic = rows[use].sum(axis=0)
    out = {}
    for term, n in counts:
        b, a = n[use].sum(axis=0)
        w = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
        if a >= LEAST_TEXTS // 2 and w - ERRORS / 2 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) > LEAST_ODDS:
            out[term] = float(w)
    return out


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    """The driver gets lexicon entries and one short row of features per sampled text, never a text."""
    rows = stage(chosen_rows(docs, labels, learnable, fit_rows, id_col, text_col, label_col), "toxic-sample")
    sizes = np.zeros((FOLDS, 2))
    for r in rows.groupBy("fold", "toxic").count().collect():
        sizes[r["fold"], int(r["toxic"])] = r["count"]
    share = float(sizes[:, 1].sum() / max(1.0, sizes.sum()))
    nothing = Model({}, Trees(0.0), np.zeros(1), np.array([share]))
    if share in (0.0, 1.0):
        return nothing
    counts = term_counts(rows)
    by_fold = [_weights(counts, sizes, f) for f in range(FOLDS)]
    shared = rows.sparkSession.sparkContext.broadcast(by_fold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = [Features(lexicon) for lexicon in shared.value]
        for batch in batches:
            found = [features[f].of(t) for t, f in zip(batch["text"].to_pylist(), batch["fold"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["id"].cast(pa.string()), batch["fold"], batch["toxic"], pa.array(found, pa.list_(pa.float64()))],
                                             ["id", "fold", "toxic", "x"])

    sample = sorted(rows.mapInArrow(run, "id string, fold int, toxic boolean, x array<double>").collect())
    x = np.array([r["x"] for r in sample])
    y, fold = np.array([r["toxic"] for r in sample], np.float64), np.array([r["fold"] for r in sample])
    margin, known = np.zeros(len(y)), np.zeros(len(y), bool)
    for f in range(FOLDS):
        rest, own = fold != f, fold == f
        if own.any() and 0 < y[rest].sum() < rest.sum():
            margin[own], known[own] = boosted(x[rest], y[rest]).margin(x[own]), True
    if not known.any():
        return nothing
    knots, shares = isotonic(margin[known], y[known])
    return Model(_weights(counts, sizes), boosted(x, y), knots, shares)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` and ``predicted`` to rows with ``text``; the text itself goes."""
    others = [f for f in rows.schema.fields if f.name != "text"]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        features = Features(model.lexicon)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                score = model.score(batch["text"].to_pylist(), features)
                yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in others), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                                                 [*(f.name for f in others), "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "score double, predicted int"])
    return rows.mapInArrow(run, schema)
