"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.session import stage

SALTS = 8
CHUNK = 1 << 20


def _to_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with the least neighbour of ``u``; the salt keeps the edges of one hub in many tasks."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, ["u", "salt"]).drop("salt")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task, ``CHUNK`` at a time, as stars around the least node of what they join; at most one link per node."""
    held: list[pa.RecordBatch] = []
    count = 0

    def stars() -> pa.RecordBatch:
        a, b = (np.concatenate([batch[c].to_numpy() for batch in held]) for c in ("a", "b"))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        left, right = at[:len(a)], at[len(a):]
        root = np.arange(len(nodes))
        while len(apart := np.flatnonzero(root[left] != root[right])):
            left, right = left[apart], right[apart]
            np.minimum.at(root, np.maximum(root[left], root[right]), np.minimum(root[left], root[right]))
            while (root != root[root]).any():
                root = root[root]
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["u", "v"])

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= CHUNK:
            yield stars()
            held, count = [], 0
    if held:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; the root is the least node of its component.

    Each round first moves every larger neighbour of a node to the node's least
    neighbour, then every smaller one; both are sums over edges, however many
    a node has. Before the first round, each task reduces its own links to
    stars. Every round is a table in the shared folder. The links between
    two rounds are equal when the work is done, which takes a number of rounds
    that grows with the logarithm of the longest path.
    """
    current = stage(edges.filter("a <> b").select("a", "b").mapInArrow(_forest, "u long, v long").distinct(), "links")
    known = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _to_least(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = _to_least(large, smallest).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stage(moved.unionByName(smallest.withColumnRenamed("m", "v")).distinct(), "links")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == known:
            break
        known = state
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
