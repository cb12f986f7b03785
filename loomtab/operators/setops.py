"""Unions, multiset operations and deduplication. Null equals null; values of unlike types are never cast to each other (``plans.mixed``)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import ORD, Table, as_table, col, grouping, kind, method, resolve, resolve_all, sorting
from ..plans import mixed
from .joins import first_rows


def _placed(each: list[Table], names: list[str], of: Callable[[Table, int, str], str | None], missing: Any) -> list[Table]:
    """Tables under one header; a field has one type, found over all tables and the value for missing fields."""
    types: dict[str, T.DataType] = {}
    found = [[of(t, i, n) for i, n in enumerate(names)] for t in each]
    for i, n in enumerate(names):
        own = [kind(t, f[i]) if f[i] is not None else mixed.literal_type(missing) for t, f in zip(each, found, strict=True)]
        types[n] = mixed.common(own)
    gap = mixed.literal_type(missing)
    return [
        t.keep(*[(mixed.as_type(col(f[i]), kind(t, f[i]), types[n]) if f[i] is not None else mixed.as_type(F.lit(missing), gap, types[n])).alias(n) for i, n in enumerate(names)])
        for t, f in zip(each, found, strict=True)
    ]


def _united(each: list[Table]) -> Table:
    """Tables of one header, one after the other; in order if all are."""
    if all(t.has_order for t in each) and len({t.frame.schema[ORD].dataType.simpleString() for t in each}) == 1:
        parts = [t.frame.withColumn(ORD, F.struct(F.lit(k).alias("t"), F.col(ORD).alias("o"))) for k, t in enumerate(each)]
    else:
        parts = [t.df for t in each]
    return Table(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


@method
def cat(*tables: Table, missing: Any = None, header: Any = None) -> Table:
    """Union by field name; further fields go to the end, absent ones are missing; ``header`` restricts."""
    each = [as_table(t) for t in tables]
    names = list(dict.fromkeys(c for t in each for c in t.columns)) if header is None else list(header)
    return _united(_placed(each, names, lambda t, i, n: n if n in t.columns else None, missing))


@method
def stack(*tables: Table, missing: Any = None, trim: bool = True, pad: bool = True) -> Table:
    """Union by position under the first header; wider tables are trimmed, narrower ones padded."""
    del trim, pad
    each = [as_table(t) for t in tables]
    names = each[0].columns
    return _united(_placed(each, names, lambda t, i, n: t.columns[i] if i < len(t.columns) else None, missing))


def _plain(a: Table, b: Table) -> bool:
    """Whether Spark's own set operations compare the rows of both by value."""
    return all(mixed.alike(kind(a, x), kind(b, y)) and kind(a, x) != mixed.VARIANT for x, y in zip(a.columns, b.columns, strict=True))


def _matched(a: Table, b: Table, strict: bool, keep: bool) -> Table:
    """Rows of ``a`` with or without a counterpart in ``b``, in order of ``a``: each row's number among its equals against b's count."""
    pairs = [mixed.sides(col(x), kind(a, x), col(y), kind(b, y)) for x, y in zip(a.columns, b.columns, strict=True)]
    mine, theirs = [x.alias(f"__a{i}") for i, (x, _) in enumerate(pairs)], [y.alias(f"__b{i}") for i, (_, y) in enumerate(pairs)]
    counts = b.frame.groupBy(*theirs).agg(F.count(F.lit(1)).alias("__n"))
    keyed = a.frame.select("*", *mine)
    same = reduce(lambda x, y: x & y, [F.col(f"__a{i}").eqNullSafe(F.col(f"__b{i}")) for i in range(len(pairs))])
    if strict:
        return Table(keyed.join(counts, same, "left_semi" if keep else "left_anti").select(*map(col, a.frame.columns)))
    w = Window.partitionBy(*[f"__a{i}" for i in range(len(pairs))]).orderBy(ORD)
    both = keyed.withColumn("__k", F.row_number().over(w)).join(counts, same, "left")
    n = F.coalesce("__n", F.lit(0))
    return Table(both.where(F.col("__k") <= n if keep else F.col("__k") > n).select(*map(col, a.columns), ORD))


@method
@sorting
def complement(a: Table, b: Table, strict: bool = False) -> Table:
    """Rows of ``a`` less those of ``b``, as multisets; ``strict`` removes every copy."""
    a, b = as_table(a), as_table(b)
    if strict or a.has_order or not _plain(a, b):
        return _matched(a if strict else a.ordered(), b, strict, False)
    return Table(a.df.exceptAll(b.df))


@method
@sorting
def recordcomplement(a: Table, b: Table, strict: bool = False) -> Table:
    """As ``complement``, fields paired by name."""
    from .columns import cut

    a = as_table(a)
    return complement(a, cut(b, *a.columns), strict)


@method
@sorting
def diff(a: Table, b: Table, strict: bool = False) -> tuple[Table, Table]:
    """Rows added and rows removed."""
    return complement(b, a, strict), complement(a, b, strict)


@method
@sorting
def recorddiff(a: Table, b: Table, strict: bool = False) -> tuple[Table, Table]:
    return recordcomplement(b, a, strict), recordcomplement(a, b, strict)


@method
@sorting
def intersection(a: Table, b: Table) -> Table:
    """Rows in both, as often as in the one that has fewer."""
    a, b = as_table(a), as_table(b)
    return _matched(a.ordered(), b, False, True) if a.has_order or not _plain(a, b) else Table(a.df.intersectAll(b.df))


@method
def hashcomplement(a: Table, b: Table, strict: bool = False) -> Table:
    return complement(a, b, strict)


@method
def hashintersection(a: Table, b: Table) -> Table:
    return intersection(a, b)


# --- deduplication --------------------------------------------------------------------------------------------------


def _by_count(t: Any, key: Any, test: str) -> Table:
    t = as_table(t)
    w = Window.partitionBy(*grouping(t, resolve_all(t, key)))
    return Table(t.frame.withColumn("__n", F.count(F.lit(1)).over(w)).where(test).drop("__n"))


@method
@sorting
def duplicates(t: Table, key: Any = None) -> Table:
    """Rows whose key comes more than once."""
    return _by_count(t, key, "__n > 1")


@method
@sorting
def unique(t: Table, key: Any = None) -> Table:
    """Rows whose key comes once."""
    return _by_count(t, key, "__n = 1")


@method
@sorting
def distinct(t: Table, key: Any = None, count: str | None = None) -> Table:
    """The first row of each key, or of equal rows; ``count`` names a field for how many there are."""
    t = as_table(t)
    if any(kind(t, c) == mixed.VARIANT for c in t.columns):
        return _distinct_mixed(t, resolve_all(t, key), count)
    if key is None and count is None:
        return Table(t.frame.groupBy(*map(col, t.columns)).agg(F.min(ORD).alias(ORD))) if t.has_order else Table(t.df.distinct())
    keys = resolve_all(t, key)
    if count is None:
        return first_rows(t, keys)
    if key is None:
        order = [F.min(ORD).alias(ORD)] if t.has_order else []
        return Table(t.frame.groupBy(*map(col, keys)).agg(F.count(F.lit(1)).alias(count), *order))
    t = t.ordered()
    rows = F.min_by(F.struct(*[col(c) for c in t.columns]), F.col(ORD)).alias("r")
    return Table(t.frame.groupBy(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(rows, F.count(F.lit(1)).alias(count), F.min(ORD).alias(ORD)).select("r.*", count, ORD))


def _distinct_mixed(t: Table, keys: list[str], count: str | None) -> Table:
    """``distinct`` where fields hold unlike types: by keys that compare them."""
    t = t.ordered()
    rows = F.min_by(F.struct(*[col(c) for c in t.columns]), F.col(ORD)).alias("r")
    found = t.frame.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(grouping(t, keys))]).agg(rows, F.count(F.lit(1)).alias("__n"), F.min(ORD).alias(ORD))
    return Table(found.select("r.*", *([F.col("__n").alias(count)] if count is not None else []), ORD))


@method
@sorting
def conflicts(t: Table, key: Any, missing: Any = None, include: Any = None, exclude: Any = None) -> Table:
    """Rows of one key that differ from their neighbour in a field that both have.

    A row is there if it differs from the one before it, or if the next one differs from it and no earlier pair of the key does.
    """
    t = as_table(t).ordered()
    keys = resolve_all(t, key)
    fields = resolve_all(t, include) if include is not None else [c for c in t.columns if c not in keys and c not in (resolve_all(t, exclude) if exclude is not None else [])]
    w = Window.partitionBy(*map(col, keys)).orderBy(ORD)
    value = {c: col(c) if missing is None else F.nullif(col(c), F.lit(missing)) for c in fields}
    differs = reduce(lambda a, b: a | b, [F.coalesce(value[c] != F.lag(value[c]).over(w), F.lit(False)) for c in fields], F.lit(False))
    marked = t.frame.withColumn("__d", differs)
    earlier = F.coalesce(F.bool_or("__d").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    following = F.coalesce(F.lead("__d").over(w), F.lit(False))
    return Table(marked.withColumn("__keep", F.col("__d") | (following & ~earlier)).where("__keep").drop("__keep", "__d"))


@method
def isunique(t: Table, field: str | int) -> bool:
    """Whether no value comes twice."""
    t = as_table(t)
    return t.frame.groupBy(*grouping(t, [resolve(t, field)])).count().where("count > 1").limit(1).count() == 0
