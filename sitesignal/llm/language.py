"""Language of a text by its nearest centroid.

A text becomes a vector of hashed letter bigrams and trigrams, damped counts
weighted by inverse document frequency and scaled to length 1. Each language
has several centroids, found by spherical k-means; the centroid at the
smallest cosine distance names the language. A text farther from its centroid
than nearly all texts of that language are is rejected: clusters fitted on the
rest of the sample see every ``HOLD_OUT``-th of its texts, and ``REJECT_RATE`` of
those would be rejected.

Document frequencies cover all training rows. The clusters are fitted on at
most ``FIT_ROWS`` different texts of each language, those with the smallest hash.
The hashes are chosen first, in salted parts, and only their texts are fetched.

A null text, or one without a letter, is ``und`` with score 0, and so is every
text if nothing was learned. Null languages and null texts are never learned
from. Ties go to the language that sorts first. Repeated rows score alike; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesignal.llm.text import code_points, list_column

FEATURES = 4096
FIT_ROWS = 800
CLUSTERS = 4
ROUNDS = 12
HOLD_OUT = 4
REJECT_RATE = 0.01
SALTS = 32
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_counts(text: str | None) -> np.ndarray | None:
    """Counters of letter bigrams and trigrams, words set apart by one blank; null if there is no letter."""
    points = code_points((text or "").lower())
    letter = _letters()[points]
    if not letter.any():
        return None
    before = np.concatenate([[True], letter[:-1]])
    kept = letter | before
    line = np.concatenate([[32], np.where(letter, points, 32)[kept], [32]]).astype(np.uint32)
    two = line[:-1] * np.uint32(0x9E3779B1) + line[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0x27D4EB2F) ^ line[2:] * np.uint32(0xC2B2AE3D)
    both = np.concatenate([two ^ (two >> np.uint32(15)), three ^ (three >> np.uint32(13))]) * np.uint32(0x165667B1)
    return np.bincount(both >> np.uint32(20), minlength=FEATURES)


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    centres: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts).astype(np.float32) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine to its nearest centroid, and whether that is too far."""
        names, score, far = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        counts = [(i, c) for i, t in enumerate(texts) if (c := letter_counts(t)) is not None]
        if not counts or not len(self.centres):
            return names, score, far
        cosine = self.vectors(np.stack([c for _, c in counts])) @ self.centres.T
        best = cosine.argmax(axis=1)
        at = np.array([i for i, _ in counts])
        score[at] = np.clip(cosine[np.arange(len(at)), best], 0, 1)
        far[at] = score[at] < self.least[best]
        for i, b in zip(at, best):
            names[i] = self.languages[self.owner[b]]
        return names, score, far


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from the mean and the points farthest from all centres so far."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        nearest = np.max(x @ np.array(centres).T, axis=1)
        centres.append(x[int(nearest.argmin())])
    c = np.array(centres)
    for _ in range(ROUNDS):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows = np.zeros(FEATURES + 1, np.int64), 0
    for batch in batches:
        for text in batch["text"].to_pylist():
            if (counts := letter_counts(text)) is not None:
                seen[:-1] += counts > 0
                rows += 1
    seen[-1] = rows
    used = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["feature", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(lang, c) for lang, t in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()) if (c := letter_counts(t)) is not None]
        at = [np.flatnonzero(c) for _, c in found]
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in at])])
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang for lang, _ in found], pa.string()), list_column(np.concatenate([np.zeros(0, np.int64), *at]), offsets, pa.int32()),
             list_column(np.concatenate([np.zeros(0, np.int64), *(c[a] for (_, c), a in zip(found, at))]), offsets, pa.int32())],
            ["lang", "feature", "n"])


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, clusters: int = CLUSTERS) -> Centroids:
    """Learn from rows with ``text`` and ``lang``. The driver gets ``FEATURES`` counts and ``fit_rows`` sparse vectors per language."""
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    total = rows.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(FEATURES + 1)
    for r in total:
        seen[r["feature"]] = r["n"]
    idf = (np.log((seen[-1] + 1) / (seen[:-1] + 1)) + 1).astype(np.float32)
    hashes = rows.select("lang", F.xxhash64("text").alias("h")).distinct().withColumn("salt", F.pmod("h", F.lit(SALTS)))
    for parts in (["lang", "salt"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*parts).orderBy("h"))
        hashes = hashes.withColumn("place", place).filter(F.col("place") <= fit_rows).drop("place")
    last = hashes.groupBy("lang").agg(F.max("h").alias("last"))
    # a row per language, of which the model, broadcast later on, holds some thousand numbers each
    near = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(last), "lang").filter("h <= last")
    chosen = near.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "h", "text")
    sample: dict[str, list[np.ndarray]] = {}
    for r in chosen.orderBy("lang", "h").mapInArrow(_sampled, "lang string, feature array<int>, n array<int>").toLocalIterator():
        counts = np.zeros(FEATURES, np.float32)
        counts[r["feature"]] = r["n"]
        sample.setdefault(r["lang"], []).append(counts)
    model = Centroids(sorted(sample), idf, np.zeros((0, FEATURES), np.float32), np.zeros(0, int), np.zeros(0))
    centres, owner, least = [], [], []
    for i, lang in enumerate(model.languages):
        x = model.vectors(np.stack(sample[lang]))
        held = np.arange(len(x)) % HOLD_OUT == HOLD_OUT - 1
        limit = float(np.quantile((x[held] @ _clusters(x[~held], clusters).T).max(axis=1), REJECT_RATE)) if held.any() else 0.0
        for c in _clusters(x, clusters):
            centres.append(c)
            owner.append(i)
            least.append(limit)
    if centres:
        model.centres, model.owner, model.least = np.stack(centres).astype(np.float32), np.array(owner), np.array(least)
    return model


def predicted(rows: DataFrame, model: Centroids) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``rejected`` to rows with ``text``; the text itself goes."""
    others = [f for f in rows.schema.fields if f.name != "text"]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                names, score, far = shared.value.predict(batch["text"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(batch[f.name] for f in others), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(far)],
                    [*(f.name for f in others), "lang_pred", "score", "rejected"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in others]
    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double, rejected boolean"]))
