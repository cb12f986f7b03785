"""Lookups and materialisation: results on the driver, and the tables that they come from."""

from __future__ import annotations

from collections.abc import Callable, Iterator, MutableMapping
from typing import Any, NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..core import ORD, Table, as_table, col, method, resolve_all
from ..errors import DuplicateKeyError
from ..functions.expressions import Record
from .sorts import rowslice


@method
def lookuptable(t: Table, key: Any, value: Any = None) -> Table:
    """``key, values``: each key's values in row order, as a table; the distributed form of the lookups."""
    t = as_table(t).ordered()
    keys = resolve_all(t, key)
    fields = t.columns if value is None else resolve_all(t, value)
    v = col(fields[0]) if value is not None and len(fields) == 1 else F.struct(*map(col, fields))
    rows = F.array_sort(F.collect_list(F.struct(F.col(ORD).alias("o"), v.alias("v"))))
    k = col(keys[0]) if len(keys) == 1 else F.struct(*map(col, keys))
    return Table(t.frame.groupBy(k.alias("key")).agg(F.transform(rows, lambda x: x["v"]).alias("values")), order="key")


def _plain(x: Any) -> Any:
    return tuple(x) if isinstance(x, Row) else x


def _lookup(t: Any, key: Any, value: Any, dictionary: MutableMapping | None, make: Callable[[Any], Any], one: bool, strict: bool) -> MutableMapping:
    out: MutableMapping = {} if dictionary is None else dictionary
    for r in lookuptable(t, key, value).df.toLocalIterator():
        if one and strict and len(r["values"]) > 1:
            raise DuplicateKeyError(_plain(r["key"]))
        values = [make(v) for v in (r["values"][:1] if one else r["values"])]
        k = _plain(r["key"])
        out[k] = values[0] if one else [*out.get(k, []), *values]
    return out


@method
def lookup(t: Table, key: Any, value: Any = None, dictionary: MutableMapping | None = None) -> MutableMapping:
    """Key to list of values (rows without ``value``)."""
    return _lookup(t, key, value, dictionary, _plain, False, False)


@method
def lookupone(t: Table, key: Any, value: Any = None, dictionary: MutableMapping | None = None, strict: bool = False) -> MutableMapping:
    """Key to the first value; ``strict`` raises for a key that comes twice."""
    return _lookup(t, key, value, dictionary, _plain, True, strict)


@method
def dictlookup(t: Table, key: Any, dictionary: MutableMapping | None = None) -> MutableMapping:
    return _lookup(t, key, None, dictionary, lambda r: r.asDict(), False, False)


@method
def dictlookupone(t: Table, key: Any, dictionary: MutableMapping | None = None, strict: bool = False) -> MutableMapping:
    return _lookup(t, key, None, dictionary, lambda r: r.asDict(), True, strict)


def _record(r: Row) -> Record:
    return Record(r, tuple(r.__fields__))


@method
def recordlookup(t: Table, key: Any, dictionary: MutableMapping | None = None) -> MutableMapping:
    return _lookup(t, key, None, dictionary, _record, False, False)


@method
def recordlookupone(t: Table, key: Any, dictionary: MutableMapping | None = None, strict: bool = False) -> MutableMapping:
    return _lookup(t, key, None, dictionary, _record, True, strict)


# --- materialisation ------------------------------------------------------------------------------------------------


def _rows(t: Any) -> Iterator[Row]:
    t = as_table(t)
    return (t.frame.orderBy(ORD).drop(ORD) if t.has_order else t.frame).toLocalIterator()


@method
def listoflists(t: Table) -> list[list]:
    return [list(as_table(t).columns), *(list(r) for r in _rows(t))]


@method
def listoftuples(t: Table) -> list[tuple]:
    return [tuple(as_table(t).columns), *(tuple(r) for r in _rows(t))]


@method
def tupleoftuples(t: Table) -> tuple[tuple, ...]:
    return tuple(listoftuples(t))


@method
def tupleoflists(t: Table) -> tuple[list, ...]:
    return tuple(listoflists(t))


@method
def columns_(t: Table) -> dict[str, list]:
    """Field to list of values."""
    names, *rows = listoftuples(t)
    return {n: [r[i] for r in rows] for i, n in enumerate(names)}


@method
def facetcolumns(t: Table, key: Any) -> dict[Any, dict[str, list]]:
    """Key to field to list of values."""
    out = {}
    for r in lookuptable(t, key).df.toLocalIterator():
        out[_plain(r["key"])] = {n: [v[n] for v in r["values"]] for n in as_table(t).columns}
    return out


@method
def cache(t: Table) -> Table:
    """Keeps the rows in the executors' memory and disks."""
    return Table(as_table(t).frame.persist(StorageLevel.MEMORY_AND_DISK))


@method
def values(t: Table, *fields: Any) -> DataFrame:
    """Fields' values as a DataFrame."""
    t = as_table(t)
    return t.df.select(*map(col, resolve_all(t, fields)))


@method
def header(t: Table) -> tuple[str, ...]:
    return tuple(as_table(t).columns)


@method
def fieldnames(t: Table) -> tuple[str, ...]:
    return tuple(as_table(t).columns)


def _sliced(t: Any, args: tuple) -> Iterator[Row]:
    return _rows(rowslice(t, *args) if args else t)


@method
def data(t: Table, *args: int | None) -> Iterator[tuple]:
    """Data rows, or a slice of them."""
    return (tuple(r) for r in _sliced(t, args))


@method
def records(t: Table, *args: int | None) -> Iterator[Record]:
    return (_record(r) for r in _sliced(t, args))


@method
def dicts(t: Table, *args: int | None) -> Iterator[dict[str, Any]]:
    return (r.asDict() for r in _sliced(t, args))


@method
def namedtuples(t: Table, *args: int | None, name: str = "row") -> Iterator[Any]:
    kind = NamedTuple(name, [(c, Any) for c in as_table(t).columns])
    return (kind(*r) for r in _sliced(t, args))
