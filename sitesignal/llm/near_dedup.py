"""Near duplicates by DartMinHash signatures, banded joins and exact similarity.

Every element of a weighted set owns a region as wide as its weight, into which
darts fall at rate 1 at ranks drawn from hashes alone. A set throws only the
darts of rank up to about ``k ln k + 2 k`` over its total weight, which is
enough to hit each of ``k`` coordinates; the earliest dart at a coordinate is
its signature. Two sets agree at a coordinate with their weighted Jaccard
similarity as probability, and a set of n elements costs n + k log k steps, not
n * k.

Equal texts are one node. Nodes that share a band are paired with the band's
most central node, the one that shares most bands with others; pairs that pass
a loose bound on signatures are checked on their whole sets of ``WORDS``-word
shingles, and those of similarity ``SIMILARITY`` or more are linked. Then every
band that still holds several classes compares its nodes across classes, tile
against tile inside a task, so that no link between two different texts of one
band is lost because neither is close to the central node, and only links ever
become rows. Classes are the connected components.

A text of fewer than ``WORDS`` words is one shingle. Texts without words are
equal to each other only if they are the same white space. Null counts as
empty. The smallest id of a class stays, nulls last; of repeated rows with
that id, one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.llm.components import components
from sitesignal.llm.text import kept_rows, list_column, lists, maybe_wanted, mix64, pieces_of, returning, squeezed, windows, word_hashes
from sitesignal.session import stage

WORDS = 5
SIMILARITY = 0.8
BANDS = 26
ROWS = 6
#: about five standard deviations of the estimate below the similarity
ESTIMATE = 0.64
TILE = 512

_STEP = np.uint64(0x9E3779B97F4A7C15)


def unique_lists(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each list, how often each stands there, and offsets."""
    found = [np.unique(values[a:b], return_counts=True) for a, b in zip(offsets[:-1], offsets[1:])]
    empty = np.zeros(0, values.dtype)
    return (np.concatenate([empty, *(v for v, _ in found)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)]),
            np.concatenate([[0], np.cumsum([len(v) for v, _ in found], dtype=np.int64)]))


def _cells(elements: np.ndarray, weights: np.ndarray | None, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Regions cut into cells of width 1; the last cell of an element may be narrower."""
    if weights is None:
        return elements, owner, None
    whole = np.ceil(weights).astype(np.int64)
    first = np.repeat(np.cumsum(whole) - whole, whole)
    cell = np.arange(whole.sum()) - first
    width = np.minimum(1.0, np.repeat(weights, whole) - cell)
    return mix64(np.repeat(elements, whole) + cell.astype(np.uint64) * _STEP), np.repeat(owner, whole), width


def dart_signatures(elements: np.ndarray, offsets: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """A row of ``k`` 64-bit values per set; the elements of a set are distinct and no set is empty."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    total = np.diff(offsets).astype(np.float64) if weights is None else np.bincount(owner, weights, n)
    reach = (k * np.log(k) + 2 * k) / total
    out = np.zeros((n, k), np.uint64)
    cells, cell_owner, width = _cells(elements, weights, owner)
    todo = np.arange(n)
    while len(todo):
        mine = np.isin(cell_owner, todo)
        keys, sets = cells[mine], cell_owner[mine]
        wide = None if width is None else width[mine]
        rank = np.zeros(len(keys))
        first = np.full(n * k, np.inf)
        value = out.reshape(-1)
        throw = 0
        while len(keys):
            throw += 1
            h = mix64(keys + np.uint64(throw * int(_STEP) % (1 << 64)))
            rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            inside = rank <= reach[sets]
            keys, sets, rank, h = keys[inside], sets[inside], rank[inside], h[inside]
            dart = mix64(h ^ np.uint64(0xD6E8FEB86659FD93))
            at, when = sets * k + (dart % np.uint64(k)).astype(np.int64), rank
            if wide is not None:
                wide = wide[inside]
                hit = (mix64(dart) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < wide
                at, when, dart = at[hit], when[hit], dart[hit]
            np.minimum.at(first, at, when)
            best = first[at] == when
            value[at[best]] = dart[best]
        missed = np.isinf(first.reshape(n, k)[todo]).any(axis=1)
        todo = todo[missed]
        reach[todo] *= 2
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches, 1000):
        elements, _, offsets = unique_lists(*windows(*lists(batch["words"]), WORDS))
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        bands, signature = np.zeros((0, BANDS), np.int64), [None] * len(sizes)
        if len(full):
            darts = dart_signatures(elements, np.concatenate([[0], np.cumsum(sizes[full])]), BANDS * ROWS)
            by_band = darts.reshape(len(full), BANDS, ROWS)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(full), BANDS))
            for r in range(ROWS):
                key = mix64(key + _STEP) ^ by_band[:, :, r]
            bands = mix64(key).view(np.int64)
            short = darts.astype(np.uint16)
            for i, row in zip(full, short):
                signature[i] = row.tobytes()
        band_offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))])
        yield pa.RecordBatch.from_arrays(
            [batch["rid"], batch["id"], batch["sha"], pa.array(sizes), list_column(bands.ravel(), band_offsets, pa.int64()), pa.array(signature, pa.binary())],
            ["rid", "id", "sha", "n_shingles", "bands", "signature"])


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs[id_col].alias("id"), F.sha2(squeezed(docs[text_col]), 256).alias("sha"),
                       word_hashes(docs[text_col]).alias("words"))
    kind = rows.schema["id"].dataType.simpleString()
    return stage(rows.mapInArrow(returning(_sketch), f"rid long, id {kind}, sha string, n_shingles long, bands array<long>, signature binary"), "sketches")


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, BANDS * ROWS) for c in ("s_a", "s_b"))
        close = (left == right).mean(axis=1) >= ESTIMATE
        yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(close)), batch["b"].filter(pa.array(close))], ["a", "b"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches, 1000):
        elements, _, offsets = unique_lists(*windows(*lists(batch["words"]), WORDS))
        yield pa.RecordBatch.from_arrays([batch["rid"], list_column(elements.view(np.int64), offsets, pa.int64())], ["rid", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (left, at), (right, to) = lists(batch["x_a"]), lists(batch["x_b"])
        value = np.zeros(batch.num_rows)
        for i in range(batch.num_rows):
            a, b = left[at[i]:at[i + 1]], right[to[i]:to[i + 1]]
            both = len(np.intersect1d(a, b, assume_unique=True))
            value[i] = both / (len(a) + len(b) - both)
        close = pa.array(value >= SIMILARITY)
        yield pa.RecordBatch.from_arrays([batch["a"].filter(close), batch["b"].filter(close)], ["a", "b"])


def _sided(pairs: DataFrame, table: DataFrame, value: str, name: str) -> DataFrame:
    """``pairs`` with the value of both nodes."""
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("rid").alias(side), F.col(value).alias(f"{name}_{side}")), side)
    return pairs.select("a", "b", f"{name}_a", f"{name}_b")


def _shingles_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(rid, shingles)`` of the wanted nodes; only their texts are read again."""
    wanted = wanted.join(nodes.select("rid", "id", "sha"), "rid").select("rid", F.col("id").alias("w_id"), F.col("sha").alias("w_sha"))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("sha", F.sha2(squeezed(F.col("text")), 256))
    texts = maybe_wanted(texts, wanted, "w_sha", "sha").join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("sha") == F.col("w_sha")))
    texts = texts.select("rid", "text").dropDuplicates(["rid"]).select("rid", word_hashes(F.col("text")).alias("words"))
    return stage(texts.mapInArrow(returning(_shingle_sets), "rid long, shingles array<long>"), "shingles")


def linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose shingle sets are similar."""
    near = stage(_sided(pairs, nodes, "signature", "s").mapInArrow(returning(_estimated), "a long, b long"), "near-pairs")
    if near.isEmpty():
        return near
    sets = _shingles_of(near.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), nodes, docs, id_col, text_col)
    return stage(_sided(near, sets, "shingles", "x").mapInArrow(returning(_similar), "a long, b long"), "near-links")


def _tile_links(table: pa.Table) -> pa.Table:
    """Pairs of classes that a link between the two sides of a tile joins. Pairs that links found before have joined are not tested."""
    root, size, side = (table[c].to_numpy() for c in ("root", "n_shingles", "side"))
    (shingles, at) = lists(table["shingles"].combine_chunks())
    signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)
    inside = bool((side == 2).any())
    left = np.flatnonzero(side == 2) if inside else np.flatnonzero(side == 0)
    right = left if inside else np.flatnonzero(side == 1)
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for i in left:
        open_ = right[(root[right] != root[i]) & (np.minimum(size[right], size[i]) >= SIMILARITY * np.maximum(size[right], size[i]))]
        if inside:
            open_ = open_[open_ > i]
        if not len(open_):
            continue
        agree = (signature[open_] == signature[i]).mean(axis=1)
        order = np.argsort(-agree, kind="stable")
        for j in open_[order[agree[order] >= ESTIMATE]]:
            if top(int(root[i])) == top(int(root[j])):
                continue
            a, b = shingles[at[i]:at[i + 1]], shingles[at[j]:at[j + 1]]
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both >= SIMILARITY * (len(a) + len(b) - both):
                parent[top(int(root[i]))] = top(int(root[j]))
                out.append((int(root[i]), int(root[j])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def linked_across(members: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """Classes ``(a, b)`` to join, since nodes of theirs share a band and are similar; null if no band holds several classes.

    A band is dealt into tiles of about ``TILE`` nodes, and each pair of tiles
    is one group, so no task holds more than two tiles of a band at once. The
    nodes of the band's largest class have tiles of their own, which meet the
    tiles of the other nodes and not each other.
    """
    rooted = members.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    sizes = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n")).filter("most.n < n").select(
        "band", F.col("most.root").alias("main"), F.ceil((F.col("n") - F.col("most.n")) / TILE).cast("int").alias("few"),
        F.ceil(F.col("most.n") / TILE).cast("int").alias("many"))
    open_ = stage(rooted.select("band", "rid", "root").join(mixed, "band"), "open-bands")
    if open_.isEmpty():
        return None
    sets = _shingles_of(open_.select("rid").distinct(), nodes, docs, id_col, text_col)
    whole = sets.join(nodes.select("rid", "n_shingles", "signature"), "rid")
    in_main = F.col("root") == F.col("main")
    dealt = open_.withColumn("tile", F.when(in_main, F.col("few") + F.pmod(F.xxhash64("rid"), F.col("many"))).otherwise(
        F.pmod(F.xxhash64("rid"), F.col("few"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("few") - 1 + F.when(in_main, 0).otherwise(F.col("many"))))).select(
        "band", "rid", "root", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"),
        F.when(F.col("tile") == F.col("other"), 2).when(F.col("tile") < F.col("other"), 0).otherwise(1).alias("side"))
    return stage(dealt.join(whole, "rid").groupBy("band", "lo", "hi").applyInArrow(_tile_links, "a long, b long").distinct(), "links-across")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, class_id, class_size, kept, sha)``, one row per row of ``docs``."""
    rows = sketches(docs, id_col, text_col)
    first = rows.groupBy("sha").agg(F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("first")).select("sha", F.col("first.rid").alias("head"))
    nodes = stage(rows.join(first.select(F.col("head").alias("rid")), "rid", "left_semi"), "nodes")
    banded = nodes.select("rid", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stage(banded.join(shared, "band"), "bands")
    central = members.join(members.groupBy("rid").agg(F.sum("n").alias("met")), "rid")
    leads = central.groupBy("band").agg(F.min(F.struct(-F.col("met"), "rid")).alias("lead")).select("band", F.col("lead.rid").alias("lead"))
    tested = members.join(leads, "band").filter("rid <> lead").select(F.col("rid").alias("a"), F.col("lead").alias("b")).distinct()
    links = linked(tested, nodes, docs, id_col, text_col)
    roots = components(links)
    more = linked_across(members, roots, nodes, docs, id_col, text_col)
    if more is not None and not more.isEmpty():
        joined = components(more).select(F.col("node").alias("root"), F.col("root").alias("above"))
        known = roots.unionByName(joined.select(F.col("root").alias("node"), "root")).distinct()
        roots = known.join(joined, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    heads = first.join(roots.select(F.col("node").alias("head"), "root"), "head", "left").select("sha", F.coalesce("root", "head").alias("root"))
    rooted = stage(rows.select("rid", "id", "sha").join(heads, "sha"), "classes")
    stays = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("first"), F.count(F.lit(1)).alias("class_size"))
    stays = stays.select("root", F.col("first.id").alias("class_id"), F.col("first.rid").alias("stay"), "class_size")
    return rooted.join(stays, "root").select("id", "class_id", "class_size", (F.col("rid") == F.col("stay")).alias("kept"), "sha")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, all columns as they were."""
    return kept_rows(docs, near_classes(docs, id_col, text_col).select("id", "sha", "kept"), id_col, text_col)
