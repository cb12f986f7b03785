"""Row numbers over a whole table without gathering it in one task.

A range sort by the order, then a number within each partition, then the partitions' counts summed up: the only thing that
one task sees is a row per partition. The sorted rows are stored before they are counted, so that a lost executor can't give rows of equal order other numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..core import ORD, Table, grouping
from .stored import stored

#: Bits below the partition number in ``monotonically_increasing_id``.
WITHIN = (1 << 33) - 1


def numbered(t: Table, field: str) -> Table:
    """``t`` with 0-based consecutive numbers in row order, sorted by it."""
    t = t.ordered()
    placed = stored(t.frame.repartitionByRange(ORD).sortWithinPartitions(ORD).withColumn("__at", F.monotonically_increasing_id()))
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit(WITHIN))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # a row per partition
    return Table(out.withColumn(field, within + F.col("__before")).drop("__part", "__before", "__at"))


#: Rows of a block for windows over a whole table.
BLOCK = 100_000


def largest(t: Table, keys: list[str]) -> int:
    """Rows of the most frequent key."""
    return t.frame.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(grouping(t, keys))]).count().agg(F.max("count")).first()[0] or 0


def by_key(t: Table, keys: list[str]) -> Table:
    """``t`` in the order of its keys, and of its rows within each."""
    return Table(t.frame.withColumn(ORD, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(grouping(t, keys))], F.col(ORD).alias("o"))))


def segments(t: Table, keys: list[str]) -> tuple[DataFrame, list[Column], bool]:
    """Rows with what to partition windows by so that no task gets more than ``BLOCK`` rows of a key, and whether keys are in several parts.

    A key of up to ``BLOCK`` rows is one part. If any has more, all rows are numbered by key and order, and each block of numbers holds parts of its keys;
    ``carried`` then brings to each part what the parts before it have. ``__part`` numbers a key's parts.
    """
    by = [F.col(f"__k{i}") for i in range(len(keys))]
    named = [k.alias(f"__k{i}") for i, k in enumerate(grouping(t, keys))]
    if keys and largest(t, keys) <= BLOCK:
        return t.frame.select("*", *named, F.lit(0).cast("long").alias("__part")), by, False
    n = numbered(by_key(t, keys) if keys else t, "__row").frame
    frame = n.withColumn(ORD, F.col(f"{ORD}.o")) if keys else n
    return frame.select("*", *named, F.floor(F.col("__row") / BLOCK).alias("__part")).drop("__row"), by, True


def carried(frame: DataFrame, by: list[Column], parts: dict[str, Column], over: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``frame`` with what aggregates of each part give for all parts of its key before it: ``over`` names the aggregate of the parts' aggregates."""
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each BLOCK rows of the key
    found = frame.groupBy(*by, "__part").agg(*[c.alias(n) for n, c in parts.items()])
    sums = found.select(*[k.alias(f"__b{i}") for i, k in enumerate(by)], F.col("__part").alias("__at"), *[over[n](F.col(n)).over(before).alias(n) for n in parts])
    same = reduce(Column.__and__, [k.eqNullSafe(F.col(f"__b{i}")) for i, k in enumerate(by)], F.col("__part") == F.col("__at"))
    return frame.join(sums, same).drop("__at", *[f"__b{i}" for i in range(len(by))])


def near(t: Table, keys: list[str]) -> tuple[DataFrame, WindowSpec]:
    """Rows that see their neighbours, of their own key: a frame with ``__own`` for rows that are no copies, and a window."""
    if keys and largest(t, keys) <= BLOCK:
        return t.frame.withColumn("__own", F.lit(True)), Window.partitionBy(*grouping(t, keys)).orderBy(ORD)
    if not keys:
        return with_neighbours(t)
    frame, _ = with_neighbours(by_key(t, keys))
    return frame.withColumn(ORD, F.col(f"{ORD}.o")), Window.partitionBy("__block", *grouping(t, keys)).orderBy("__row")


def with_neighbours(t: Table) -> tuple[DataFrame, WindowSpec]:
    """The rows in blocks by order, each with the rows before and after it: a frame with ``__own`` for the block's own rows, and a window."""
    n = numbered(t, "__row").frame
    block = lambda k: F.floor((F.col("__row") + k) / BLOCK)
    blocks = F.explode(F.array_distinct(F.array(block(0), block(-1), block(1))))
    return n.withColumn("__block", blocks).withColumn("__own", F.col("__block") == block(0)), Window.partitionBy("__block").orderBy("__row")
