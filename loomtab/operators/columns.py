"""Projections, columns and headers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..core import ORD, Table, as_table, col, fitted, from_rows, grouping, method, resolve, resolve_all, unique_names, sorting
from ..errors import ArgumentError
from ..functions.expressions import Record, context_column, record_column, value_column
from ..plans.numbering import near, numbered
from ..plans.shipping import ship


@method
def cut(t: Table, *fields: Any) -> Table:
    """Keeps fields, by name or index, in the order given."""
    t = as_table(t)
    return t.keep(*map(col, resolve_all(t, fields)))


@method
def cutout(t: Table, *fields: Any) -> Table:
    """Drops fields."""
    t = as_table(t)
    gone = set(resolve_all(t, fields))
    return t.keep(*[col(c) for c in t.columns if c not in gone])


@method
def movefield(t: Table, field: str | int, index: int) -> Table:
    """Moves a field to an index."""
    t = as_table(t)
    name = resolve(t, field)
    names = [c for c in t.columns if c != name]
    names.insert(index, name)
    return t.keep(*map(col, names))


def _inserted(t: Table, field: str, value: Column, index: int | None) -> list[Column]:
    out = [col(c) for c in t.columns if c != field]
    out.insert(len(out) if index is None else index, value.alias(field))
    return out


@method
def addfield(t: Table, field: str, value: Any = None, index: int | None = None, returns: str | None = None) -> Table:
    """Adds a constant, a Column, an ``{field}`` expression, or a callable of the record."""
    t = as_table(t)
    return t.keep(*_inserted(t, field, record_column(t, value, returns), index))


@method
def addfields(t: Table, definitions: Sequence[Sequence[Any]]) -> Table:
    """Adds several fields ``(name, value[, index])``; each value sees the original row."""
    t = as_table(t)
    out: list[tuple[str, Column]] = [(c, col(c)) for c in t.columns]
    for name, value, *index in definitions:
        out.insert(index[0] if index else len(out), (name, record_column(t, value).alias(name)))
    return t.keep(*[c for _, c in out])


@method
def addrownumbers(t: Table, start: int = 1, step: int = 1, field: str = "row") -> Table:
    """Prepends consecutive numbers in row order, without gathering the rows in one task."""
    t = numbered(as_table(t), "__row")
    return t.keep((F.col("__row") * step + start).alias(field), *[col(c) for c in t.columns if c != "__row"])


@method
def annex(*tables: Table, missing: Any = None) -> Table:
    """Tables side by side by row number; shorter ones are padded."""
    each = [as_table(t) for t in tables]
    names = iter(unique_names(c for t in each for c in t.columns))
    out = None
    shown: list[str] = []
    for t in each:
        n = numbered(t, "__row")
        mine = {c: next(names) for c in t.columns}
        part = n.frame.select("__row", *[col(c).alias(m) for c, m in mine.items()])
        shown += mine.values()
        out = part if out is None else out.join(part, "__row", "full")
    if out is None:
        raise ArgumentError("no tables")
    fill = [F.coalesce(col(c), F.lit(missing)).alias(c) if missing is not None else col(c) for c in shown]
    return Table(out.select(*fill, F.struct("__row").alias(ORD)))


@method
def addcolumn(t: Table, field: str, values: Sequence[Any], index: int | None = None, missing: Any = None) -> Table:
    """Adds a driver-side sequence by position; the shorter side is padded."""
    t = as_table(t)
    both = annex(t, from_rows([(v,) for v in values], header=[field]), missing=missing)
    return movefield(both, both.columns[-1], index) if index is not None else both


@method
def addfieldusingcontext(t: Table, field: str, query: Callable[[Any, Any, Any], Any], by: Any = None, recurrent: bool = False, returns: str = "double", ahead: bool = True) -> Table:
    """Adds ``query(previous, current, next)``, within groups of ``by`` where given.

    Where the query is an expression of fields it becomes lag and lead; otherwise it gets records, None where there is no neighbour, and its results are of
    the type ``returns``. With ``recurrent=True`` the previous row carries the field
    already computed, so rows run in order within each group (all rows are one group without ``by``).
    A stream needs ``by``; a key's last row waits there for its successor, unless ``ahead=False`` says that the query doesn't look at the next row.
    """
    t = as_table(t)
    names, keys = t.columns, resolve_all(t, by) if by is not None else []
    if t.frame.isStreaming:
        from ..streaming.stateful import with_context

        return with_context(t, keys, query, field, returns, recurrent, ahead)
    t = t.ordered()
    if not recurrent:
        frame, found = context_column(t, *near(t, keys), query, returns)
        return Table(frame.withColumn("__found", found).where("__own").select(*map(col, names), F.col("__found").alias(field), ORD))
    ship(t.frame.sparkSession)
    to = T._parse_datatype_string(returns)
    schema = T.StructType([*t.df.schema.fields, T.StructField(field, to), t.frame.schema[ORD]])
    placed = t.frame.select(*map(col, names), ORD, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(grouping(t, keys))]).alias("__key")) if keys else t.frame.select(*map(col, names), ORD, F.lit(0).alias("__key"))
    placed = placed.repartition("__key") if keys else placed.repartition(1)
    return Table(placed.sortWithinPartitions("__key", ORD).mapInArrow(_recurring(query, tuple(names), field, to, to_arrow_schema(schema)), schema))


def _recurring(query: Callable, names: tuple[str, ...], field: str, to: T.DataType, kinds: pa.Schema):
    """Rows sorted by key and order, a batch at a time: the last row's record is carried on, and a batch waits until the row after it is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, before = None, None

        def found(b: pa.RecordBatch, following: pa.RecordBatch | None) -> pa.RecordBatch:
            nonlocal key, before
            rows = list(zip(*(c.to_pylist() for c in b.columns[: len(names)]), strict=True))
            ids = [*map(repr, b.column(len(names) + 1).to_pylist()), None]
            if following is not None:
                rows.append(tuple(c[0].as_py() for c in following.columns[: len(names)]))
                ids[-1] = repr(following.column(len(names) + 1)[0].as_py())
            out = []
            for k in range(b.num_rows):
                if ids[k] != key:
                    key, before = ids[k], None
                value = fitted(query(before, Record(rows[k], names), Record(rows[k + 1], names) if ids[k + 1] == key else None), to)
                before = Record((*rows[k], value), (*names, field))
                out.append(value)
            return pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(out, kinds.field(len(names)).type), b.column(len(names))], schema=kinds)

        waiting = None
        for b in batches:
            if b.num_rows:
                if waiting is not None:
                    yield found(waiting, b)
                waiting = b
        if waiting is not None:
            yield found(waiting, None)

    return run


# --- headers --------------------------------------------------------------------------------------------------------


@method
def rename(t: Table, *what: Any, strict: bool = True) -> Table:
    """Renames one field to another, or by a dict; unknown fields raise unless ``strict`` is false."""
    t = as_table(t)
    pairs = dict([what]) if len(what) == 2 else what[0] if what else {}
    names = {}
    for old, new in pairs.items():
        if strict or old in t.columns or isinstance(old, int):
            names[resolve(t, old)] = new
    return setheader(t, [names.get(c, c) for c in t.columns])


@method
def setheader(t: Table, header: Sequence[str]) -> Table:
    """Replaces the header; further fields keep their names, further names are new empty fields."""
    t = as_table(t)
    names = unique_names([*header, *t.columns[len(header) :]])
    return t.keep(*[col(c).alias(n) for c, n in zip(t.columns, names, strict=False)], *[F.lit(None).cast("string").alias(n) for n in names[len(t.columns) :]])


@method
def extendheader(t: Table, fields: Sequence[str]) -> Table:
    """Appends names to the header: empty fields, or names for the unnamed fields of rows longer than it."""
    t = as_table(t)
    unnamed = [c for i, c in enumerate(t.columns) if c == f"f{i}"]
    return rename(t, dict(zip(unnamed, fields, strict=False))) if unnamed else setheader(t, [*t.columns, *fields])


@method
def pushheader(t: Table, header: Sequence[str], *more: str) -> Table:
    """A new header; the old one becomes the first row (all fields as text)."""
    t = as_table(t).ordered()
    names = unique_names([header, *more] if isinstance(header, str) else header)
    names += [f"f{i}" for i in range(len(names), len(t.columns))]
    first = t.frame.sparkSession.createDataFrame([tuple(t.columns)], [f"c{i}" for i in range(len(t.columns))])
    old = t.frame.select(F.lit(1).alias("__n"), F.struct(ORD).alias("__o"), *[col(c).cast("string").alias(n) for c, n in zip(t.columns, names, strict=False)])
    none = F.lit(None).cast(old.schema["__o"].dataType).alias("__o")
    both = first.select(F.lit(0).alias("__n"), none, *[F.col(f"c{i}").alias(n) for i, n in enumerate(names[: len(t.columns)])]).unionByName(old)
    return Table(both.withColumn(ORD, F.struct("__n", "__o")).drop("__n", "__o"))


@method
def skip(t: Table, n: int) -> Table:
    """Drops ``n`` rows, the header among them; the next row becomes the header."""
    t = as_table(t)
    if n == 0:
        return t
    t = numbered(t, "__row")
    names = [c for c in t.columns if c != "__row"]
    head = t.frame.where(F.col("__row") == n - 1).drop("__row", ORD).collect()
    rest = Table(t.frame.where(F.col("__row") >= n).drop("__row"))
    return setheader(rest, [str(v) for v in head[0]]) if head else rest.keep(*map(col, names))


@method
def prefixheader(t: Table, prefix: str) -> Table:
    t = as_table(t)
    return setheader(t, [f"{prefix}{c}" for c in t.columns])


@method
def suffixheader(t: Table, suffix: str) -> Table:
    t = as_table(t)
    return setheader(t, [f"{c}{suffix}" for c in t.columns])


@method
def sortheader(t: Table, reverse: bool = False) -> Table:
    """Fields in order of their names."""
    t = as_table(t)
    return t.keep(*[col(c) for c in sorted(t.columns, reverse=reverse)])


# --- row mappings ---------------------------------------------------------------------------------------------------


def mapped(c: Column, table: dict) -> Column:
    """A dict applied to a column; other values stay."""
    if not table:
        return c
    pairs = [F.lit(x) for kv in table.items() if kv[0] is not None for x in kv]
    known = F.create_map(*pairs) if pairs else None
    out = F.when(F.map_contains_key(known, c), F.try_element_at(known, c)).otherwise(c) if pairs else c
    return F.when(c.isNull(), F.lit(table[None])).otherwise(out) if None in table else out


@method
def fieldmap(t: Table, mappings: dict[str, Any], failonerror: bool | None = None, errorvalue: Any = None) -> Table:
    """New fields from a field, an expression string, a callable, (field, callable) or (field, dict)."""
    t = as_table(t)
    policy = {"failonerror": bool(failonerror), "errorvalue": errorvalue}
    out = []
    for name, m in mappings.items():
        if isinstance(m, (tuple, list)) and len(m) == 2:
            field, f = resolve(t, m[0]), m[1]
            c = mapped(col(field), f) if isinstance(f, dict) else value_column(t, field, f, **policy)
        elif isinstance(m, int) or (isinstance(m, str) and m in t.columns):
            c = col(resolve(t, m))
        else:
            c = record_column(t, m, **policy)
        out.append(c.alias(name))
    return t.keep(*out)


def _mapper(names: tuple[str, ...], f: Callable[[Record], Iterator[Any]], schema: T.StructType, failonerror: bool):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False, name=None):
                try:
                    for row in f(Record(r[: len(names)], names)):
                        out.append((*row, *r[len(names) :]))
                except Exception:
                    if failonerror:
                        raise
            yield pd.DataFrame(out, columns=[x.name for x in schema.fields]) if out else pd.DataFrame({x.name: [] for x in schema.fields})

    return run


@method
def rowmapmany(t: Table, generator: Callable[[Record], Iterator[Any]], schema: str, failonerror: bool = False) -> Table:
    """Rows that a generator gives for each record, as ``schema`` (DDL); rows before an error stay."""
    t = as_table(t)
    to = T.StructType.fromDDL(schema)
    ship(t.frame.sparkSession)
    return Table(t.df.mapInPandas(_mapper(tuple(t.columns), generator, to, failonerror), to))


@method
def rowmap(t: Table, mapper: Callable[[Record], Sequence[Any]], schema: str, failonerror: bool = False) -> Table:
    """One row for each record, as ``schema`` (DDL); records on which the mapper fails are dropped."""
    return rowmapmany(t, lambda r: [mapper(r)], schema, failonerror)


@method
@sorting
def rowgroupmap(t: Table, key: Any, mapper: Callable[[Any, list[Record]], Iterator[Any]], schema: str) -> Table:
    """Rows that ``mapper(key, rows)`` gives for each group, its rows in order."""
    t = as_table(t).ordered()
    keys, names, to = resolve_all(t, key), tuple(t.columns), T.StructType.fromDDL(schema)
    ship(t.frame.sparkSession)

    def run(k, pdf):
        import pandas as pd

        rows = [Record(r, names) for r in pdf.sort_values("__seq", kind="stable")[list(names)].itertuples(index=False, name=None)]
        return pd.DataFrame([tuple(x) for x in mapper(k[0] if len(k) == 1 else k, rows)], columns=[f.name for f in to.fields])

    seq = F.row_number().over(Window.partitionBy(*map(col, keys)).orderBy(ORD))
    return Table(t.frame.withColumn("__seq", seq).drop(ORD).groupBy(*map(col, keys)).applyInPandas(run, to))


@method
def unpack(t: Table, field: str | int, newfields: Sequence[str] | int | None = None, include_original: bool = False, missing: Any = None) -> Table:
    """An array field's elements as fields: named, or a number of them."""
    t = as_table(t)
    name = resolve(t, field)
    names = [f"{name}{i + 1}" for i in range(newfields)] if isinstance(newfields, int) else list(newfields or [])
    out = [F.coalesce(F.try_element_at(col(name), F.lit(i + 1)), F.lit(missing)) if missing is not None else F.try_element_at(col(name), F.lit(i + 1)) for i in range(len(names))]
    return t.keep(*[col(c) for c in t.columns if c != name or include_original], *[c.alias(n) for c, n in zip(out, names, strict=True)])


@method
def unpackdict(t: Table, field: str | int, keys: Sequence[str] | None = None, includeoriginal: bool = False, missing: Any = None) -> Table:
    """A map or struct field's entries as fields; keys that aren't given are found over all rows, sorted."""
    t = as_table(t)
    name = resolve(t, field)
    if isinstance(t.frame.schema[name].dataType, T.StructType):
        keys = list(keys or t.frame.schema[name].dataType.names)
        out = [col(name)[k] for k in keys]
    else:
        if keys is None:
            found = t.frame.select(F.explode(F.map_keys(col(name))).alias("k")).distinct().orderBy("k")
            keys = [r.k for r in found.toLocalIterator()]
        out = [F.try_element_at(col(name), F.lit(k)) for k in keys]
    out = [F.coalesce(c, F.lit(missing)) for c in out] if missing is not None else out
    return t.keep(*[col(c) for c in t.columns if c != name or includeoriginal], *[c.alias(str(k)) for c, k in zip(out, keys, strict=True)])
