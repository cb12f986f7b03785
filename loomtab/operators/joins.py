"""Equi joins. Null keys match null keys; a side's key columns are one in the result. Keys of unlike types are compared as they are, never cast (``plans.mixed``).

Strategies are Catalyst's. The hash variants ask for a shuffled hash join, which has no size bound to break; a side is broadcast only
where Spark's own size estimate allows it.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import ORD, Table, as_table, col, grouping, kind, method, resolve_all, unique_names, sorting
from ..errors import ArgumentError
from ..plans import mixed
from ..plans.numbering import numbered


def join_keys(left: Table, right: Table, key: Any, lkey: Any, rkey: Any) -> tuple[list[str], list[str]]:
    """Key fields of both sides: given, or those in common."""
    if key is not None:
        return resolve_all(left, key), resolve_all(right, key)
    if lkey is not None and rkey is not None:
        lk, rk = resolve_all(left, lkey), resolve_all(right, rkey)
        if len(lk) != len(rk):
            raise ArgumentError("keys of different length")
        return lk, rk
    if lkey is not None or rkey is not None:
        raise ArgumentError("lkey and rkey go together")
    both = [c for c in left.columns if c in right.columns]
    if not both:
        raise ArgumentError("no fields in common")
    return both, both


def _sided(t: Table, side: str) -> DataFrame:
    """Columns renamed by position, so that no name is on both sides."""
    out = [col(c).alias(f"__{side}{i}") for i, c in enumerate(t.columns)]
    return t.frame.select(*out, *([F.col(ORD).alias(f"__{side}o")] if t.has_order else []), F.lit(True).alias(f"__{side}"))


def shape_join(left: Any, right: Any, how: str, key: Any = None, lkey: Any = None, rkey: Any = None, missing: Any = None, lprefix: str | None = None, rprefix: str | None = None, hint: str | None = None, hinted: str = "right") -> Table:
    """A join with the result's columns: left fields, then right fields that aren't keys; by key in order."""
    left, right = as_table(left), as_table(right)
    lk, rk = join_keys(left, right, key, lkey, rkey)
    ldf, rdf = _sided(left, "l"), _sided(right, "r")
    lname, rname = {c: f"__l{i}" for i, c in enumerate(left.columns)}, {c: f"__r{i}" for i, c in enumerate(right.columns)}
    if hint:
        ldf, rdf = (ldf.hint(hint), rdf) if hinted == "left" else (ldf, rdf.hint(hint))
    both = ldf.join(rdf, _equal([(F.col(lname[a]), kind(left, a), F.col(rname[b]), kind(right, b)) for a, b in zip(lk, rk, strict=True)]), how)
    types = {**{v: kind(left, c) for c, v in lname.items()}, **{v: kind(right, c) for c, v in rname.items()}}

    def filled(c: str, there: str) -> Column:
        sides = {"left": ("__r",), "right": ("__l",), "full": ("__l", "__r")}.get(how, ())
        if missing is None or there not in sides:
            return F.col(c)
        (value, other), _ = mixed.united([(F.col(c), types[c]), (F.lit(missing), mixed.literal_type(missing))])
        return F.when(F.col(there), value).otherwise(other)

    def one(a: str, b: str) -> tuple[Column, T.DataType]:
        """The key of both sides as one column."""
        if how not in ("right", "full"):
            return F.col(lname[a]), types[lname[a]]
        (x, y), to = mixed.united([(F.col(lname[a]), types[lname[a]]), (F.col(rname[b]), types[rname[b]])])
        return F.when(F.col("__l"), x).otherwise(y), to

    ones = {a: one(a, b) for a, b in zip(lk, rk, strict=True)}
    keys = {a: c for a, (c, _) in ones.items()}
    shown = [(f"{lprefix or ''}{c}", keys[c] if c in keys else filled(lname[c], "__l")) for c in left.columns]
    shown += [(f"{rprefix or ''}{c}", filled(rname[c], "__r")) for c in right.columns if c not in rk]
    names = unique_names(n for n, _ in shown)
    order = [mixed.comparable(*ones[a]) for a in lk] + [F.col(o) for o in ("__lo", "__ro") if o in both.columns]
    return Table(both.select(*[c.alias(n) for (_, c), n in zip(shown, names, strict=True)], F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)]).alias(ORD)))


def _equal(pairs: list[tuple[Column, T.DataType, Column, T.DataType]]) -> Column:
    """Whether keys of both sides are equal; null equals null."""
    both = [mixed.sides(*p) for p in pairs]
    return reduce(lambda a, b: a & b, [a.eqNullSafe(b) for a, b in both])


@method
@sorting
def join(left: Table, right: Table, key: Any = None, lkey: Any = None, rkey: Any = None, lprefix: str | None = None, rprefix: str | None = None) -> Table:
    """Inner join."""
    return shape_join(left, right, "inner", key, lkey, rkey, None, lprefix, rprefix)


@method
@sorting
def leftjoin(left: Table, right: Table, key: Any = None, lkey: Any = None, rkey: Any = None, missing: Any = None, lprefix: str | None = None, rprefix: str | None = None) -> Table:
    return shape_join(left, right, "left", key, lkey, rkey, missing, lprefix, rprefix)


@method
@sorting
def rightjoin(left: Table, right: Table, key: Any = None, lkey: Any = None, rkey: Any = None, missing: Any = None, lprefix: str | None = None, rprefix: str | None = None) -> Table:
    return shape_join(left, right, "right", key, lkey, rkey, missing, lprefix, rprefix)


@method
@sorting
def outerjoin(left: Table, right: Table, key: Any = None, lkey: Any = None, rkey: Any = None, missing: Any = None, lprefix: str | None = None, rprefix: str | None = None) -> Table:
    return shape_join(left, right, "full", key, lkey, rkey, missing, lprefix, rprefix)


@method
def hashjoin(left: Table, right: Table, key: Any = None, lkey: Any = None, rkey: Any = None, lprefix: str | None = None, rprefix: str | None = None) -> Table:
    """Inner join that hashes the right side."""
    return shape_join(left, right, "inner", key, lkey, rkey, None, lprefix, rprefix, "shuffle_hash")


@method
def hashleftjoin(left: Table, right: Table, key: Any = None, lkey: Any = None, rkey: Any = None, missing: Any = None, lprefix: str | None = None, rprefix: str | None = None) -> Table:
    return shape_join(left, right, "left", key, lkey, rkey, missing, lprefix, rprefix, "shuffle_hash")


@method
def hashrightjoin(left: Table, right: Table, key: Any = None, lkey: Any = None, rkey: Any = None, missing: Any = None, lprefix: str | None = None, rprefix: str | None = None) -> Table:
    """Right join that hashes the left side."""
    return shape_join(left, right, "right", key, lkey, rkey, missing, lprefix, rprefix, "shuffle_hash", "left")


def _anti(left: Any, right: Any, key: Any, lkey: Any, rkey: Any, hint: str | None) -> Table:
    left, right = as_table(left), as_table(right)
    lk, rk = join_keys(left, right, key, lkey, rkey)
    keys = right.frame.select(*[col(c).alias(f"__r{i}") for i, c in enumerate(rk)])
    keys = keys.hint(hint) if hint else keys
    return Table(left.frame.join(keys, _equal([(col(a), kind(left, a), F.col(f"__r{i}"), kind(right, b)) for i, (a, b) in enumerate(zip(lk, rk, strict=True))]), "left_anti"))


@method
@sorting
def antijoin(left: Table, right: Table, key: Any = None, lkey: Any = None, rkey: Any = None) -> Table:
    """Left rows without a match."""
    return _anti(left, right, key, lkey, rkey, None)


@method
def hashantijoin(left: Table, right: Table, key: Any = None, lkey: Any = None, rkey: Any = None) -> Table:
    return _anti(left, right, key, lkey, rkey, "shuffle_hash")


def first_rows(t: Table, keys: list[str], last: bool = False) -> Table:
    """The first (or last) row of each key in row order."""
    t = t.ordered()
    rows = F.struct(*[col(c) for c in t.frame.columns])
    pick = (F.max_by if last else F.min_by)(rows, F.col(ORD))
    return Table(t.frame.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(grouping(t, keys))]).agg(pick.alias("r")).select("r.*"))


@method
@sorting
def lookupjoin(left: Table, right: Table, key: Any = None, lkey: Any = None, rkey: Any = None, missing: Any = None, lprefix: str | None = None, rprefix: str | None = None) -> Table:
    """Left join to the first right row of each key."""
    left, right = as_table(left), as_table(right)
    _, rk = join_keys(left, right, key, lkey, rkey)
    return shape_join(left, first_rows(right, rk), "left", key, lkey, rkey, missing, lprefix, rprefix)


@method
def hashlookupjoin(left: Table, right: Table, key: Any = None, lkey: Any = None, rkey: Any = None, missing: Any = None, lprefix: str | None = None, rprefix: str | None = None) -> Table:
    left, right = as_table(left), as_table(right)
    _, rk = join_keys(left, right, key, lkey, rkey)
    return shape_join(left, first_rows(right, rk), "left", key, lkey, rkey, missing, lprefix, rprefix, "shuffle_hash")


@method
def crossjoin(*tables: Table, prefix: bool = False) -> Table:
    """All combinations, the operation itself; ``prefix`` puts the table's number before its names."""
    each = [as_table(t) for t in tables]
    sides = [_sided(t, f"t{k}_") for k, t in enumerate(each)]
    names = unique_names(f"{k + 1}_{c}" if prefix else c for k, t in enumerate(each) for c in t.columns)
    shown = [F.col(f"__t{k}_{i}") for k, t in enumerate(each) for i in range(len(t.columns))]
    both = reduce(lambda a, b: a.crossJoin(b), sides)
    order = [o for o in (f"__t{k}_o" for k in range(len(each))) if o in both.columns]
    return Table(both.select(*[c.alias(n) for c, n in zip(shown, names, strict=True)], *([F.struct(*order).alias(ORD)] if order else [])))


@method
@sorting
def unjoin(t: Table, value: str | int, key: Any = None, autoincrement: tuple[int, int] = (1, 1)) -> tuple[Table, Table]:
    """A table as facts and a dimension: by a key that is there, or by ids given to the sorted distinct values."""
    t = as_table(t)
    v = resolve_all(t, value)[0]
    if key is not None:
        k = resolve_all(t, key)
        facts = t.keep(*[col(c) for c in t.columns if c != v])
        return facts, Table(t.frame.select(*map(col, [*k, v])).distinct(), order=[*k, v])
    start, step = autoincrement
    values = numbered(Table(t.frame.select(col(v)).distinct(), order=[v]), "__n")
    dimension = Table(values.frame.select((F.col("__n") * step + start).alias("id"), col(v), F.struct("__n").alias(ORD)))
    ids = dimension.df.select(F.col("id").alias("__id"), col(v).alias("__v"))
    facts = t.frame.join(ids, col(v).eqNullSafe(F.col("__v")))
    names = [F.col("__id").alias(f"{v}_id") if c == v else col(c) for c in t.columns]
    return Table(facts.select(*names, *([ORD] if t.has_order else []))), dimension


