"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a queue of its documents in a fixed shuffled order, offered
``repeats`` times over. A copy's virtual finish time is the number of its
source's words up to and with it, divided by the source's target. All copies
are put in order of finish time and taken from the front until the total
budget is spent, so every source is served in step with its target.

Cumulative sums never run over a whole queue in one task: a queue is cut into
fixed slices of the shuffle order, slices are summed first, and rows add up
within their slice. The global cut is found the same way, by two rounds of
4096 ranges of finish time, so that only a sliver of rows is ever sorted
against each other.

A null text has size 0; documents of size 0 are never taken. A null source is
a source of its own. Repeated rows and ties are ordered by hash, id and size,
so reruns take the same documents. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesignal.llm.text import packed, word_count

SLICE_DIGITS = 3
RANGES = 4096
REPEATS = 2


def source_targets(sources: DataFrame, share: float, repeats: int = REPEATS) -> DataFrame:
    """Adds ``target`` to rows with ``source``, ``weight`` and ``source_size``, one per source.

    ``share`` of all words is dealt out by weight; no source is to give more
    than ``repeats`` times its size, and what is over goes to the others by
    weight. Sources are filled in the order of the weight at which they are
    full, which is the fixed point of dealing the excess again and again. The
    table has a row per source and is a mixing plan, not data.
    """
    limit = F.lit(repeats) * F.col("source_size")
    full_at = limit / F.col("weight")
    before = Window.orderBy("full_at", "source").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("full_at", "source").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ordered = sources.withColumn("full_at", full_at.cast("double")).withColumn("limit", limit.cast("double"))
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ordered = ordered.withColumn("level", level).withColumn("full", F.col("full_at") <= F.col("level"))
    # past the first source that does not fill, the level stays that source's level
    ordered = ordered.withColumn("rate", F.min(F.when(~F.col("full"), F.struct("full_at", "source", "level"))).over(everything)["level"])
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("rate") * F.col("weight"))
    return ordered.select(*sources.columns, F.coalesce(target, F.lit(0.0)).alias("target"))


def ranked_weights(sizes: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """``(source, source_size)`` with weights that repeat in code point order of the source, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in cycle]), (place % len(cycle) + 1).cast("int")))


def _shuffle_key(ident: Column) -> Column:
    return F.md5(F.coalesce(ident.cast("string"), F.lit("")))


def _cut(copies: DataFrame, share: float) -> DataFrame:
    """``copies`` with ``taken``: whether the copy lies within the budget in finish order.

    Range tables have at most 2 * RANGES rows and are broadcast.
    """
    place = F.least(F.col("finish"), F.lit(2.0)) * RANGES
    copies = copies.withColumn("r1", F.floor(place)).withColumn("r2", F.floor((place - F.floor(place)) * RANGES))
    upto = lambda *keys: Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = copies.groupBy("r1").agg(F.sum("size").alias("n"), F.sum(F.when(F.col("epoch") == 0, F.col("size"))).alias("once"))
    first = first.withColumn("end1", F.sum("n").over(upto("r1"))).withColumn(
        "budget", F.floor(F.lit(share) * F.sum("once").over(Window.partitionBy())))
    first = first.select("r1", (F.col("end1") - F.col("n")).alias("start1"), "end1", "budget")
    known = copies.join(F.broadcast(first), "r1")
    open1 = (F.col("start1") < F.col("budget")) & (F.col("end1") > F.col("budget"))
    second = known.filter(open1).groupBy("r1", "r2").agg(F.sum("size").alias("n"), F.min("start1").alias("s"))
    second = second.withColumn("end2", F.col("s") + F.sum("n").over(upto("r1", "r2"))).select(
        "r1", "r2", (F.col("end2") - F.col("n")).alias("start2"), "end2")
    known = known.join(F.broadcast(second), ["r1", "r2"], "left")
    start, end = F.coalesce("start2", "start1"), F.coalesce("end2", "end1")
    split = known.withColumn("inside", end <= F.col("budget")).withColumn("open", (start < F.col("budget")) & (end > F.col("budget")))
    rows = Window.partitionBy("r1", "r2").orderBy("finish", "queue", "key", "id", "size", "epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = split.filter("open").withColumn("inside", F.coalesce("start2", "start1") + F.sum("size").over(rows) <= F.col("budget"))
    kept = split.filter("NOT open").unionByName(last)
    return kept.select(*[c for c in copies.columns if c not in ("r1", "r2")], F.col("inside").alias("taken"))


def mix(docs: DataFrame, weights=ranked_weights, share: float = 1.5, id_col: str = "doc_id", source_col: str = "source",
        text_col: str = "text", repeats: int = REPEATS, keep_row: bool = False) -> DataFrame:
    """Every copy offered, ``repeats`` per document: ``(id, queue, size, source_size, target, epoch, finish, taken)``.

    ``weights`` adds ``weight`` to rows with ``source`` and ``source_size``.
    ``row`` holds the whole input row if ``keep_row`` is set.
    """
    source = docs[source_col].cast("string")
    queue = F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))
    rows = packed(docs, id=docs[id_col], queue=queue, size=word_count(docs[text_col]), key=_shuffle_key(docs[id_col]))
    rows = (rows if keep_row else rows.drop("row")).withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    slices = rows.groupBy("queue", "slice").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("queue").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("queue", "slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    sizes = slices.groupBy("queue").agg(F.sum("n").alias("source_size")).withColumn(
        "source", F.when(F.col("queue") != "0", F.expr("substring(queue, 2)")))
    plan = source_targets(weights(sizes), share, repeats).select("queue", "source_size", "target")
    offsets = offsets.join(plan, "queue")
    within = Window.partitionBy("queue", "slice").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = rows.withColumn("upto", F.sum("size").over(within)).join(offsets, ["queue", "slice"])
    queued = queued.withColumn("upto", F.col("upto") + F.col("before")).drop("before", "slice")
    copies = queued.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    copies = copies.withColumn("finish", F.when(
        F.col("target") > 0, (F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("target")).otherwise(F.lit(0.0)))
    return _cut(copies, share)


def allocation(docs: DataFrame, **options) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes of it.
    """
    cut = mix(docs, **options)
    rows = cut.groupBy("id", "queue", "key", "size", "upto").agg(
        F.min("source_size").alias("source_size"), F.min("target").alias("target"),
        F.sum(F.when(F.col("taken"), F.col("size")).otherwise(F.lit(0))).alias("taken"),
        F.sum(F.when(F.col("epoch") == 0, 1).otherwise(0)).cast("int").alias("n"))
    # only repeated rows of size 0 share all of these columns
    return rows.withColumn("n", F.explode(F.array_repeat(F.lit(1), F.col("n")))).drop("n", "upto", "key")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, all columns as they were."""
    taken = mix(docs, keep_row=True, **options).filter(F.col("taken") & (F.col("size") > 0))
    return taken.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
