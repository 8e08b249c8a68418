"""Per-key windows that never put one whole key into one task.

A single site or domain may hold a large share of all rows, so every window
here either works on a salted or time-sliced part of a key, or on a few
summary rows of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesignal.session import stage


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key in the given order, numbered from 1.

    Spark limits each key to ``k`` rows in every task before the shuffle
    (WindowGroupLimit, for ``k`` up to 1000), so the window sees at most ``k``
    rows of a key per task of the input. ``order`` must be a total order.
    """
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` per key; partial aggregation handles hot keys."""
    rest = [c for c in df.columns if c not in keys and c != order]
    if not rest:
        return df.groupBy(*keys).agg(F.min(order).alias(order))
    picked = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_first"))
    return picked.select(*keys, F.col(f"_first.{order}").alias(order), *[F.col(f"_first.{c}").alias(c) for c in rest])


def join_by_load(rows: DataFrame, lookup: DataFrame, on: str, shares: int = 256) -> DataFrame:
    """Left join of ``rows`` with the one row ``lookup`` has per key, whatever share of the rows a key has.

    Keys are counted first. A key with more than one part in ``shares`` of all
    rows is hot; there are fewer than ``shares`` of them, which bounds the
    table that is broadcast. The rows of a hot key are dealt by their hash over
    as many copies of its lookup row as it has parts. A null key finds nothing.
    ``lookup`` has no column of ``rows`` but the key.
    """
    loads = rows.groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    total = loads.agg(F.sum("_n")).scalar()
    hot = loads.filter(F.col("_n") * shares > total).select(
        F.col(on).alias("_hot"), F.ceil(F.col("_n") * shares / total).cast("int").alias("_copies"))
    hot = F.broadcast(stage(hot, "hot-keys"))  # both sides must see the same counts, also when a task is run again
    copies = F.coalesce("_copies", F.lit(1))
    dealt = rows.join(hot, rows[on].eqNullSafe(hot["_hot"]), "left").withColumn(
        "_part", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), copies).cast("int")).drop("_hot", "_copies")
    spare = lookup.join(hot, lookup[on] == hot["_hot"], "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_hot", "_copies")
    return dealt.join(spare, [on, "_part"], "left").drop("_part")


def previous_in_time(df: DataFrame, keys: list[str], ts: str, order: list[str], values: list[str],
                     slice_seconds: int = 600, prefix: str = "prev_") -> DataFrame:
    """Adds the previous row's ``values`` within each key, ordered by ``ts`` then ``order``.

    Rows are sorted within slices of time; the first row of a slice takes the
    last row of the slice before, found over one summary row per slice.
    """
    sliced = df.withColumn("_slice", F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / slice_seconds))
    fields = list(dict.fromkeys([ts, *order, *values]))
    in_slice = Window.partitionBy(*keys, "_slice").orderBy(ts, *order)
    local = sliced.withColumn("_prev", F.lag(F.struct(*fields)).over(in_slice))
    tails = sliced.groupBy(*keys, "_slice").agg(F.max(F.struct(*fields)).alias("_tail"))
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    carried = tails.select(*keys, "_slice", F.lag("_tail").over(by_slice).alias("_carry"))
    out = local.join(carried, [*keys, "_slice"], "left").withColumn("_prev", F.coalesce("_prev", "_carry"))
    for v in values:
        out = out.withColumn(prefix + v, F.col(f"_prev.{v}"))
    return out.drop("_prev", "_carry", "_slice")


def position_in_key(df: DataFrame, keys: list[str], order: list[str], ties: list[str] | None = None, position: str = "position") -> DataFrame:
    """Row number per key by ``order``, then ``ties``; equal rows come in any order among themselves.

    All rows are sorted into ranges of (key, order), so a hot key lies in many
    of them. A row's number over the whole table is its place in its range plus
    the sizes of the ranges before, and its position is that less the number of
    the key's first row. The counts joined back are one row per key and range,
    so no join has more rows of a key than a range holds.
    """
    by = [*keys, *order, *(ties or [])]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id())
    placed = stage(placed, "positions").withColumn("_part", F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy(*keys, "_part").agg(F.min("_place").alias("_least"), F.count(F.lit(1)).alias("_n"))
    sizes = counts.groupBy("_part").agg(F.sum("_n").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    starts = counts.join(F.broadcast(sizes), "_part").withColumn("_start", F.min(F.col("_before") + F.col("_least")).over(Window.partitionBy(*keys)))
    offset = starts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_part", (F.col("_before") - F.col("_start")).alias("_offset"))
    same = [placed[k].eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return placed.join(offset.withColumnRenamed("_part", "_of"), (placed["_part"] == F.col("_of")) & _all(same)).withColumn(
        position, F.col("_place") + F.col("_offset") + 1).select(*df.columns, position)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
