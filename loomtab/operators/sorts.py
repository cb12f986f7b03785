"""Sorts, slices and fills: operators on row order."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..core import ORD, Table, as_table, col, grouping, method, resolve_all, sorting
from ..plans.numbering import carried, numbered, segments


@method
@sorting
def sort(t: Table, key: Any = None, reverse: bool = False) -> Table:
    """Rows by key, null first (last with ``reverse``), numbers before all else; rows of equal keys keep their order."""
    t = as_table(t)
    keys = grouping(t, resolve_all(t, key))
    tie = [F.col(ORD)] if t.has_order else []
    df = t.frame.orderBy(*[k.desc_nulls_last() if reverse else k.asc_nulls_first() for k in keys], *tie)
    if reverse:
        rank = [F.monotonically_increasing_id()]
        return Table(df.drop(ORD).withColumn(ORD, F.struct(*rank)))
    return Table(df.withColumn(ORD, F.struct(*[k.alias(f"k{i}") for i, k in enumerate([*keys, *tie])])))


@method
@sorting
def mergesort(*tables: Table, key: Any = None, reverse: bool = False) -> Table:
    """Tables of any headers united and sorted."""
    from .setops import cat

    return sort(cat(*tables), key, reverse)


@method
def issorted(t: Table, key: Any = None, reverse: bool = False, strict: bool = False) -> bool:
    """Whether rows are in order of a key; ``strict`` forbids ties. A table without rows is sorted."""
    t = numbered(as_table(t), "__row")
    keys = F.struct(*grouping(t, [c for c in resolve_all(t, key) if c != "__row"]))
    part = t.frame.select(keys.alias("k"), "__row")
    # each row next to its predecessor through an equi join on the number, not a window over the whole table
    before = part.select(F.col("k").alias("b"), (F.col("__row") + 1).alias("__row"))
    bad = (F.col("k") > F.col("b")) if reverse else (F.col("k") < F.col("b"))
    return part.join(before, "__row").where(bad | (F.col("k") == F.col("b")) if strict else bad).limit(1).count() == 0


def _limited(t: Table, n: int, last: bool) -> Table:
    t = t.ordered()
    df = t.frame.orderBy(F.col(ORD).desc() if last else F.col(ORD)).limit(n)
    return Table(df)


@method
def head(t: Table, n: int = 5) -> Table:
    """The first rows."""
    return _limited(as_table(t), n, False)


@method
def tail(t: Table, n: int = 5) -> Table:
    """The last rows."""
    return _limited(as_table(t), n, True)


@method
def rowslice(t: Table, *args: int | None) -> Table:
    """Rows ``stop``, ``start, stop`` or ``start, stop, step``, as ``islice`` has them."""
    s = slice(*args) if args else slice(None)
    start, stop, step = s.start or 0, s.stop, s.step or 1
    t = as_table(t)
    if step == 1 and stop is not None:
        t = t.ordered()
        return Table(t.frame.orderBy(ORD).limit(stop).orderBy(ORD).offset(start) if start else t.frame.orderBy(ORD).limit(stop))
    n = numbered(t, "__row")
    test = (F.col("__row") >= start) & ((F.col("__row") - start) % step == 0)
    return Table(n.frame.where(test & (F.col("__row") < stop) if stop is not None else test).drop("__row"))


# --- fills ----------------------------------------------------------------------------------------------------------


def _gap(c: Column, missing: Any) -> Column:
    return c if missing is None else F.nullif(c, F.lit(missing))


@method
def filldown(t: Table, *fields: Any, missing: Any = None, by: Any = None) -> Table:
    """Carries the last value down over missing ones, within groups of ``by`` where given.

    A group of any size runs in two passes: within its parts, and with the last values of the parts before. A stream needs ``by`` (or ``streaming.stateful.running``).
    """
    t = as_table(t)
    names = resolve_all(t, fields) if fields else t.columns
    if t.frame.isStreaming:
        from ..streaming.stateful import filled

        return filled(t, names, missing, resolve_all(t, by) if by is not None else [])
    t = t.ordered()
    frame, by_, several = segments(t, resolve_all(t, by) if by is not None else [])
    value = {c: _gap(col(c), missing) for c in names}
    if several:
        lasts = {f"__l{i}": F.max_by(value[c], F.when(value[c].isNotNull(), F.col(ORD))) for i, c in enumerate(names)}
        frame = carried(frame, by_, lasts, dict.fromkeys(lasts, lambda c: F.last(c, ignorenulls=True)))
    w = Window.partitionBy(*by_, "__part").orderBy(ORD).rowsBetween(Window.unboundedPreceding, 0)
    here = {c: F.coalesce(F.last(value[c], ignorenulls=True).over(w), *([F.col(f"__l{i}")] if several else []), col(c)).alias(c) for i, c in enumerate(names)}
    return Table(frame.select(*[here.get(c, col(c)) for c in t.columns], ORD))


def _across(t: Any, missing: Any, back: bool) -> Table:
    t = as_table(t)
    names = t.columns[::-1] if back else t.columns
    out = {}
    for i, c in enumerate(names):
        kind = t.frame.schema[c].dataType.simpleString()
        near = [_gap(col(n), missing) if t.frame.schema[n].dataType.simpleString() == kind else _gap(col(n), missing).try_cast(kind) for n in names[i::-1]]
        out[c] = F.coalesce(*near, *([F.lit(missing)] if missing is not None else [])).alias(c)
    return t.keep(*[out[c] for c in t.columns])


@method
def fillright(t: Table, missing: Any = None) -> Table:
    """Missing cells take the nearest value to their left."""
    return _across(t, missing, False)


@method
def fillleft(t: Table, missing: Any = None) -> Table:
    """Missing cells take the nearest value to their right."""
    return _across(t, missing, True)


@method
def rowgroupby(t: Table, key: Any, value: Any = None) -> Table:
    """Runs of adjacent rows with equal keys: ``key, rows`` in order, ``rows`` an array of structs or of one field's values."""
    t = as_table(t).ordered()
    keys = resolve_all(t, key)
    n = numbered(t, "__row")
    k = F.struct(*map(col, keys)).alias("k")
    part = n.frame.select(k, "__row", (F.struct(*[col(c) for c in t.columns]) if value is None else col(resolve_all(t, value)[0])).alias("v"))
    before = part.select(F.col("k").alias("b"), (F.col("__row") + 1).alias("__row"))
    marked = part.join(before, "__row", "left").withColumn("new", F.col("b").isNull() | ~F.col("k").eqNullSafe(F.col("b")))
    w = Window.partitionBy("k").orderBy("__row")
    run = marked.withColumn("start", F.last(F.when(F.col("new"), F.col("__row")), ignorenulls=True).over(w))
    rows = run.groupBy("k", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("__row", "v"))), lambda x: x["v"]).alias("rows"))
    return Table(rows.select((F.col("k")[keys[0]] if len(keys) == 1 else F.col("k")).alias("key"), "rows", F.struct("start").alias(ORD)))

