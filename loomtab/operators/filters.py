"""Filters. Null compares as lower than any value, and equal to null."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import ORD, Table, as_table, col, method, resolve, resolve_all
from ..errors import ArgumentError
from ..functions.expressions import context_column, record_column, truthy, value_column
from ..plans import mixed
from ..plans.numbering import near

#: Comparisons under which null is the lowest value.
OPS: dict[str, Callable[[Column, Any], Column]] = {
    "==": lambda c, v: c.eqNullSafe(v),
    "!=": lambda c, v: ~c.eqNullSafe(v),
    "<": lambda c, v: c.isNull() | (c < v) if v is not None else F.lit(False),
    "<=": lambda c, v: c.isNull() | (c <= v) if v is not None else c.isNull(),
    ">": lambda c, v: c > v if v is not None else c.isNotNull(),
    ">=": lambda c, v: c >= v if v is not None else F.lit(True),
}


def _compared(t: Table, name: str, values: Iterable[Any]) -> tuple[Column, list[Any]]:
    """A field and constants to compare it with: as they are, or by their keys where one is of another type."""
    own, values = t.frame.schema[name].dataType, list(values)
    kinds = [mixed.literal_type(v) for v in values]
    if not isinstance(own, T.VariantType) and all(k == own or isinstance(own, T.NumericType) and isinstance(k, T.NumericType) or mixed.kind_of(k) is None or {mixed.kind_of(k), mixed.kind_of(own)} <= {"date", "datetime"} or mixed.kind_of(own) in ("dict", "list") for k in kinds):
        return col(name), values
    return mixed.key(col(name), own), [None if v is None else mixed.key(F.lit(v), k) for v, k in zip(values, kinds, strict=True)]


def _kept(t: Table, test: Column, complement: bool) -> Table:
    """Rows that pass; with ``complement`` all others, those for which the test is null included."""
    return Table(t.frame.where(~F.coalesce(test, F.lit(False)) if complement else test))


@method
def select(t: Table, *what: Any, complement: bool = False) -> Table:
    """Rows for which a callable or ``{field}`` expression, or a callable of one field, is true."""
    t = as_table(t)
    if len(what) == 1:
        test = record_column(t, what[0], "boolean")
    elif len(what) == 2:
        test = value_column(t, resolve(t, what[0]), what[1], "boolean")
    else:
        raise ArgumentError("a predicate, or a field and a predicate")
    kind = t.frame.select(test.alias("x")).schema["x"].dataType
    return _kept(t, test if isinstance(kind, T.BooleanType) else truthy(test, kind), complement)


@method
def selectop(t: Table, field: str | int, value: Any, op: str | Callable[[Column, Any], Column], complement: bool = False) -> Table:
    """Rows whose field stands in a relation to a value: a name of ``OPS``, or a function of a Column and the value."""
    t = as_table(t)
    if not isinstance(op, str):
        return _kept(t, op(col(resolve(t, field)), value), complement)
    c, (value,) = _compared(t, resolve(t, field), [value])
    return _kept(t, OPS[op](c, value), complement)


def _comparison(name: str, op: str) -> Callable:
    def f(t: Table, field: str | int, value: Any, complement: bool = False) -> Table:
        return selectop(t, field, value, op, complement)

    f.__name__, f.__doc__ = name, f"Rows with field {op} value; null is the lowest value."
    return method(f)


selecteq, selectne = _comparison("selecteq", "=="), _comparison("selectne", "!=")
selectlt, selectle = _comparison("selectlt", "<"), _comparison("selectle", "<=")
selectgt, selectge = _comparison("selectgt", ">"), _comparison("selectge", ">=")
selectis, selectisnot = _comparison("selectis", "=="), _comparison("selectisnot", "!=")


@method
def selectcontains(t: Table, field: str | int, value: Any, complement: bool = False) -> Table:
    """Rows whose text or array contains a value."""
    t = as_table(t)
    name = resolve(t, field)
    test = F.array_contains(col(name), value) if isinstance(t.frame.schema[name].dataType, T.ArrayType) else col(name).contains(value)
    return _kept(t, test, complement)


@method
def selectin(t: Table, field: str | int, values: Iterable[Any], complement: bool = False) -> Table:
    t, values = as_table(t), list(values)
    c, values = _compared(t, resolve(t, field), values)
    test = F.coalesce(c.isin([v for v in values if v is not None]), F.lit(False))
    return _kept(t, test | c.isNull() if any(v is None for v in values) else test, complement)


@method
def selectnotin(t: Table, field: str | int, values: Iterable[Any], complement: bool = False) -> Table:
    return selectin(t, field, values, not complement)


@method
def selectisinstance(t: Table, field: str | int, kind: type | str | tuple, complement: bool = False) -> Table:
    """Rows whose value is of a type: of a column of one type all rows with a value, or none."""
    from ..functions.types import of_kind

    t = as_table(t)
    name = resolve(t, field)
    if isinstance(t.frame.schema[name].dataType, T.VariantType):
        wanted = [k if isinstance(k, str) else k.__name__ for k in (kind if isinstance(kind, tuple) else (kind,))]
        return _kept(t, mixed.python_type(col(name)).isin(wanted), complement)
    return _kept(t, col(name).isNotNull() if of_kind(t.frame.schema[name].dataType, kind) else F.lit(False), complement)


def _range(name: str, low: str, high: str) -> Callable:
    def f(t: Table, field: str | int, minv: Any, maxv: Any, complement: bool = False) -> Table:
        t = as_table(t)
        c, (minv, maxv) = _compared(t, resolve(t, field), [minv, maxv])
        return _kept(t, OPS[low](c, minv) & OPS[high](c, maxv), complement)

    f.__name__, f.__doc__ = name, f"Rows with minv {'<=' if low == '>=' else '<'} value {high} maxv."
    return method(f)


selectrangeopenleft = _range("selectrangeopenleft", ">=", "<")
selectrangeopenright = _range("selectrangeopenright", ">", "<=")
selectrangeopen = _range("selectrangeopen", ">=", "<=")
selectrangeclosed = _range("selectrangeclosed", ">", "<")


@method
def selecttrue(t: Table, field: str | int, complement: bool = False) -> Table:
    """Rows whose value counts as true in Python."""
    t = as_table(t)
    name = resolve(t, field)
    return _kept(t, truthy(col(name), t.frame.schema[name].dataType), complement)


@method
def selectfalse(t: Table, field: str | int, complement: bool = False) -> Table:
    return selecttrue(t, field, not complement)


@method
def selectnone(t: Table, field: str | int, complement: bool = False) -> Table:
    t = as_table(t)
    return _kept(t, col(resolve(t, field)).isNull(), complement)


@method
def selectnotnone(t: Table, field: str | int, complement: bool = False) -> Table:
    return selectnone(t, field, not complement)


@method
def rowlenselect(t: Table, n: int, complement: bool = False) -> Table:
    """Rows of ``n`` values: trailing nulls are what padding left of short rows."""
    t = as_table(t)
    length = F.coalesce(F.array_max(F.array(*[F.when(col(c).isNotNull(), i + 1) for i, c in enumerate(t.columns)])), F.lit(0))
    return _kept(t, length == n, complement)


@method
def selectusingcontext(t: Table, query: Callable[[Any, Any, Any], Any], by: Any = None, ahead: bool = True) -> Table:
    """Rows for which ``query(previous, current, next)`` is true, within groups of ``by`` where given; large groups are in blocks.

    A query that is no expression of fields gets records, None where there is no neighbour. A stream needs ``by``; see ``addfieldusingcontext`` for ``ahead``.
    """
    t = as_table(t)
    if t.frame.isStreaming:
        from ..streaming.stateful import with_context

        return with_context(t, resolve_all(t, by) if by is not None else [], query, None, "boolean", ahead=ahead)
    t = t.ordered()
    frame, w = near(t, resolve_all(t, by) if by is not None else [])
    frame, test = context_column(t, frame, w, query, "boolean")
    return Table(frame.withColumn("__keep", test).where("__keep AND __own").select(*map(col, t.columns), ORD))


@method
def facet(t: Table, key: Any) -> dict[Any, Table]:
    """A table for each value of a key."""
    t = as_table(t)
    keys = resolve_all(t, key)
    found = t.frame.select(*map(col, keys)).distinct().toLocalIterator()
    out = {}
    for r in found:
        test = F.lit(True)
        for k, v in zip(keys, r, strict=True):
            test &= col(k).eqNullSafe(v)
        out[r[0] if len(keys) == 1 else tuple(r)] = Table(t.frame.where(test))
    return out


@method
def biselect(t: Table, *what: Any) -> tuple[Table, Table]:
    """The rows that pass, and all others."""
    return select(t, *what), select(t, *what, complement=True)


@method
def skipcomments(t: Table, prefix: str) -> Table:
    """Rows whose first value doesn't start with a prefix."""
    t = as_table(t)
    return _kept(t, col(t.columns[0]).cast("string").startswith(prefix), True)


def flagged(pattern: str, flags: int) -> str:
    """A pattern with Python's flags as inline flags."""
    letters = "".join(c for f, c in ((re.I, "i"), (re.M, "m"), (re.S, "s"), (re.X, "x")) if flags & f)
    return f"(?{letters}){pattern}" if letters else pattern


@method
def search(t: Table, *what: Any, flags: int = 0, complement: bool = False) -> Table:
    """Rows in which a pattern matches some field, or the given ones; null is searched as the text ``None``."""
    t = as_table(t)
    fields, pattern = (t.columns, what[0]) if len(what) == 1 else (resolve_all(t, what[0]), what[1])
    test = F.lit(False)
    for c in fields:
        test |= F.coalesce(col(c).cast("string"), F.lit("None")).rlike(flagged(pattern, flags))
    return _kept(t, test, complement)


@method
def searchcomplement(t: Table, *what: Any, flags: int = 0) -> Table:
    return search(t, *what, flags=flags, complement=True)
