"""File formats.

Readers give Spark the paths, so scans are distributed, pruned and pushed down where the format allows. Writers have two forms: a
directory of part files written by all executors (``directory=True``, the one for large tables), or one file in row order, streamed
through the driver partition by partition.
"""

from __future__ import annotations

import csv
import io
import json
import pickle
from collections.abc import Iterable, Iterator, Sequence
from typing import Any
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import ORD, Table, as_table, col, from_rows, method, session, unique_names
from ..errors import ArgumentError
from ..functions.types import python_name
from ..plans.shipping import ship
from ..plans.stored import stored
from .records import lines, read_records
from .registry import is_stream, read_bytes, source_of, write_bytes

#: Lines in which a header record is looked for.
HEADER_LINES = 100


def _lines_frame(source: Any, encoding: str | None) -> DataFrame:
    """Lines of a path or a source as ``value``."""
    spark = session()
    if not is_stream(source):
        return spark.read.option("encoding", encoding or "UTF-8").text(source)
    return spark.createDataFrame([(x,) for x in read_bytes(source).decode(encoding or "utf-8").splitlines()], "value string")


def _in_order(t: Table) -> Iterator[Any]:
    return (t.frame.orderBy(ORD).drop(ORD) if t.has_order else t.df).toLocalIterator(prefetchPartitions=True)


# --- delimited text -------------------------------------------------------------------------------------------------


def fromcsv(source: Any = None, encoding: str | None = None, errors: str = "strict", header: Sequence[str] | None = None, delimiter: str = ",", quotechar: str = '"', ragged: bool = False, multiline: bool = True, **csvargs: Any) -> Table:
    """Delimited text; all values are text, empty ones are ``''``.

    ``header`` names the fields of a file without a header row. ``ragged=True`` keeps the extra values of long rows as fields
    (the width is found over all rows) and leaves absent values of short rows null; otherwise long rows are trimmed and absent values are ``''``.
    Large files are split between tasks, also where values hold line breaks (UTF-8 and no further ``csvargs``; ``multiline=False`` says that no value does).
    """
    split = not is_stream(source) and source is not None and (encoding or "utf-8").lower().replace("-", "") == "utf8" and not csvargs and len(delimiter) == len(quotechar) == 1
    if split and (ragged or (multiline and _is_large(source))):
        return _split_csv(source, header, delimiter, quotechar, ragged)
    if is_stream(source) or source is None or ragged:
        text = read_bytes(source).decode(encoding or "utf-8", errors)
        rows = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, quotechar=quotechar, **csvargs)
        return from_rows(rows, header)
    reader = session().read.option("sep", delimiter).option("quote", quotechar).option("escape", quotechar).option("multiLine", multiline).option("inferSchema", False).option("encoding", encoding or "UTF-8").option("mode", "PERMISSIVE")
    if header is not None:
        return Table(reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in unique_names(header)])).csv(source).na.fill(""))
    df = reader.option("header", True).csv(source)
    return Table(df.toDF(*unique_names(df.columns)).na.fill(""))


def _is_large(source: Any) -> bool:
    """Whether any file of a path is more than one split."""
    spark = session()
    longest = spark.read.format("binaryFile").load(source).select("length").agg(F.max("length")).first()[0]
    return (longest or 0) > spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def _split_csv(source: Any, header: Sequence[str] | None, delimiter: str, quotechar: str, ragged: bool) -> Table:
    """Records read in splits, in order; each file's first one is its header if none is given."""
    df = read_records(source, delimiter, quotechar)
    names = list(header) if header is not None else None
    if names is None:
        first = "\n".join(r.line for r in lines(session(), source).limit(HEADER_LINES).collect())
        names = next(csv.reader(io.StringIO(first, newline=""), delimiter=delimiter, quotechar=quotechar), [])
        df = df.where("NOT (start = 0 AND seq = 0)")
    width = max(len(names), df.agg(F.max(F.size("values"))).first()[0] or 0) if ragged else len(names)
    names = unique_names([*names, *(f"f{i}" for i in range(len(names), width))])
    value = (lambda i: F.get("values", F.lit(i))) if ragged else (lambda i: F.coalesce(F.get("values", F.lit(i)), F.lit("")))
    return Table(df.select(*[value(i).alias(n) for i, n in enumerate(names)], F.struct("file", "start", "seq").alias(ORD)))


def fromtsv(source: Any = None, encoding: str | None = None, errors: str = "strict", header: Sequence[str] | None = None, **csvargs: Any) -> Table:
    return fromcsv(source, encoding, errors, header, **{"delimiter": "\t"} | csvargs)


def _csv(t: Any, source: Any, encoding: str | None, errors: str, write_header: bool, append: bool, directory: bool, csvargs: dict[str, Any]) -> None:
    t = as_table(t)
    if directory:
        out = t.df.write.mode("append" if append else "overwrite").option("sep", csvargs.get("delimiter", ",")).option("header", write_header).option("escape", '"').option("emptyValue", "")
        out.csv(source)
        return
    with source_of(source, True).open("ab" if append else "wb") as f:
        if write_header:
            f.write(_delimited([t.columns], csvargs).encode(encoding or "utf-8", errors))
        rows = t.frame.orderBy(ORD).drop(ORD) if t.has_order else t.df
        ship(t.frame.sparkSession)
        for r in rows.mapInArrow(_chunks(csvargs), "chunk string").toLocalIterator(prefetchPartitions=True):
            f.write(r.chunk.encode(encoding or "utf-8", errors))


def _delimited(rows: Iterable[Sequence[Any]], csvargs: dict[str, Any]) -> str:
    out = io.StringIO(newline="")
    csv.writer(out, **csvargs).writerows(rows)
    return out.getvalue()


def _chunks(csvargs: dict[str, Any]):
    """Executors turn their rows to text; the driver puts the pieces together in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [c.to_pylist() for c in b.columns]
            text = _delimited(zip(*values, strict=True), csvargs) if values else "\r\n" * b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([text])], ["chunk"])

    return run


@method
def tocsv(t: Table, source: Any = None, encoding: str | None = None, errors: str = "strict", write_header: bool = True, directory: bool = False, **csvargs: Any) -> None:
    _csv(t, source, encoding, errors, write_header, False, directory, csvargs)


@method
def appendcsv(t: Table, source: Any = None, encoding: str | None = None, errors: str = "strict", write_header: bool = False, directory: bool = False, **csvargs: Any) -> None:
    _csv(t, source, encoding, errors, write_header, True, directory, csvargs)


@method
def totsv(t: Table, source: Any = None, encoding: str | None = None, errors: str = "strict", write_header: bool = True, directory: bool = False, **csvargs: Any) -> None:
    _csv(t, source, encoding, errors, write_header, False, directory, {"delimiter": "\t"} | csvargs)


@method
def appendtsv(t: Table, source: Any = None, encoding: str | None = None, errors: str = "strict", write_header: bool = False, directory: bool = False, **csvargs: Any) -> None:
    _csv(t, source, encoding, errors, write_header, True, directory, {"delimiter": "\t"} | csvargs)


def _tee(write: Any, t: Any, *args: Any, **kwargs: Any) -> Table:
    """Writes a table and passes it on: computed once, in the folder that executors share, so that both have the same rows whatever executors are lost."""
    t = Table(stored(as_table(t).frame))
    write(t, *args, **kwargs)
    return t


@method
def teecsv(t: Table, *args: Any, **kwargs: Any) -> Table:
    return _tee(tocsv, t, *args, **kwargs)


@method
def teetsv(t: Table, *args: Any, **kwargs: Any) -> Table:
    return _tee(totsv, t, *args, **kwargs)


# --- lines ----------------------------------------------------------------------------------------------------------


def fromtext(source: Any = None, encoding: str | None = None, errors: str = "strict", strip: bool | str | None = None, header: Sequence[str] = ("lines",)) -> Table:
    """A row per line, without white space at its ends (or the given characters; ``strip=False`` leaves it)."""
    df = _lines_frame(source if source is not None else source_of(None), encoding)
    value = F.col("value") if strip is False else F.btrim("value", F.lit(strip if isinstance(strip, str) else " \t\n\r\x0b\x0c"))
    return Table(df.select(value.alias(header[0])))


def _template(t: Table, template: str) -> Iterator[str]:
    names = t.columns
    for r in _in_order(t):
        yield template.format(**dict(zip(names, r, strict=True)))


def _totext(t: Any, source: Any, encoding: str | None, template: str | None, prologue: str | None, epilogue: str | None, append: bool) -> None:
    if template is None:
        raise ArgumentError("a template")
    with source_of(source, True).open("ab" if append else "wb") as f:
        f.write((prologue or "").encode(encoding or "utf-8"))
        for text in _template(as_table(t), template):
            f.write(text.encode(encoding or "utf-8"))
        f.write((epilogue or "").encode(encoding or "utf-8"))


@method
def totext(t: Table, source: Any = None, encoding: str | None = None, errors: str = "strict", template: str | None = None, prologue: str | None = None, epilogue: str | None = None) -> None:
    """A template filled for each row, between a prologue and an epilogue."""
    _totext(t, source, encoding, template, prologue, epilogue, False)


@method
def appendtext(t: Table, source: Any = None, encoding: str | None = None, errors: str = "strict", template: str | None = None, prologue: str | None = None, epilogue: str | None = None) -> None:
    _totext(t, source, encoding, template, prologue, epilogue, True)


@method
def teetext(t: Table, *args: Any, **kwargs: Any) -> Table:
    return _tee(totext, t, *args, **kwargs)


# --- JSON -----------------------------------------------------------------------------------------------------------


def fromjson(source: Any, *fields: str, header: Sequence[str] | None = None, lines: bool = False, schema: str | None = None) -> Table:
    """An array of objects, or one object per line, typed over all rows; ``schema`` (DDL) spares the pass that finds types."""
    names = list(header or fields)
    if is_stream(source):
        text = read_bytes(source).decode()
        return fromdicts([json.loads(x) for x in text.splitlines() if x.strip()] if lines else json.loads(text), header=names or None)
    reader = session().read.option("multiLine", not lines)
    df = (reader.schema(schema) if schema else reader).json(source)
    if not names and not schema:
        names = _first_seen(source, df.columns)
    return Table(df.select(*map(col, names)) if names else df)


def _first_seen(path: str, names: list[str]) -> list[str]:
    """Fields in the order of the first lines, which Spark sorts by name."""
    text = "\n".join(r.value for r in session().read.text(path).limit(200).collect())
    return sorted(names, key=lambda n: (text.find(json.dumps(n)) if json.dumps(n) in text else len(text), n))


def fromdicts(dicts: Iterable[dict], header: Sequence[str] | None = None, missing: Any = None) -> Table:
    """Driver dicts; fields in order of first appearance over all of them."""
    rows = list(dicts)
    names = list(header) if header is not None else list(dict.fromkeys(k for d in rows for k in d))
    return from_rows([[d.get(n, missing) for n in names] for d in rows], names)


def _json_value(v: Any) -> Any:
    return v.asDict(True) if hasattr(v, "asDict") else v.isoformat() if hasattr(v, "isoformat") else v if isinstance(v, (str, int, float, bool, list, dict)) or v is None else str(v)


def _tojson(t: Any, source: Any, prefix: str | None, suffix: str | None, lines: bool, row: Any, first: list[Any], directory: bool, kwargs: dict[str, Any]) -> None:
    t = as_table(t)
    if directory:
        t.df.write.mode("overwrite").option("ignoreNullFields", False).json(source)
        return
    dump = lambda x: json.dumps(x, default=_json_value, **kwargs)
    with source_of(source, True).open("wb") as f:
        f.write((prefix or "").encode() + (b"" if lines else b"["))
        for k, x in enumerate(first):
            f.write((", " if k and not lines else "").encode() + dump(x).encode() + (b"\n" if lines else b""))
        for k, r in enumerate(_in_order(t), len(first)):
            f.write((", " if k and not lines else "").encode() + dump(row(t.columns, [_json_value(v) for v in r])).encode() + (b"\n" if lines else b""))
        f.write((b"" if lines else b"]") + (suffix or "").encode())


@method
def tojson(t: Table, source: Any = None, prefix: str | None = None, suffix: str | None = None, lines: bool = False, directory: bool = False, **kwargs: Any) -> None:
    """An array of objects, or an object per line; ``directory=True`` has all executors write lines."""
    _tojson(t, source, prefix, suffix, lines, lambda n, r: dict(zip(n, r, strict=True)), [], directory, kwargs)


@method
def tojsonarrays(t: Table, source: Any = None, prefix: str | None = None, suffix: str | None = None, output_header: bool = False, lines: bool = False, **kwargs: Any) -> None:
    t = as_table(t)
    _tojson(t, source, prefix, suffix, lines, lambda n, r: r, [t.columns] if output_header else [], False, kwargs)


# --- XML and HTML ---------------------------------------------------------------------------------------------------


def fromxml(source: str, row: str, fields: dict[str, str] | None = None, schema: str | None = None) -> Table:
    """Elements ``row`` as rows; ``fields`` maps names to child paths (``a/b``, ``a/@attr``, ``@attr``, ``.`` for the text)."""
    reader = session().read.format("xml").option("rowTag", row).option("inferSchema", False).option("nullValue", "\u0000")
    df = (reader.schema(schema) if schema else reader).load(source)
    if fields is None:
        return Table(df)

    def at(path: str) -> Any:
        parts = [("_VALUE" if p == "." else f"_{p[1:]}" if p.startswith("@") else p) for p in path.split("/")]
        c, kind = None, df.schema
        for p in parts:
            if isinstance(kind, T.ArrayType):
                c, kind = F.transform(c, lambda x, p=p: x[p]), T.ArrayType(kind.elementType[p].dataType)
            else:
                c, kind = (col(p) if c is None else c[p]), kind[p].dataType
        if isinstance(kind, T.StructType) and "_VALUE" in kind.names:
            c = c["_VALUE"]
        return c

    return Table(df.select(*[at(p).alias(n) for n, p in fields.items()]))


@method
def toxml(t: Table, target: Any = None, root: str = "table", rows: str = "row", style: str = "tag", encoding: str = "utf-8", prologue: str | None = None, epilogue: str | None = None, directory: bool = False) -> None:
    """Styles: ``tag`` (an element per field), ``attribute`` (attributes of the row), ``name`` (``<field name=...>``), or a row template."""
    t = as_table(t)
    if directory:
        t.df.write.mode("overwrite").format("xml").option("rowTag", rows).option("rootTag", root).save(target)
        return
    s = lambda v: "" if v is None else str(v)

    def one(r: Sequence[Any]) -> str:
        pairs = list(zip(t.columns, r, strict=True))
        if style == "tag":
            return f"<{rows}>" + "".join(f"<{n}>{escape(s(v))}</{n}>" for n, v in pairs) + f"</{rows}>\n"
        if style == "attribute":
            return f"<{rows} " + " ".join(f"{n}={quoteattr(s(v))}" for n, v in pairs) + "/>\n"
        if style == "name":
            return f"<{rows}>" + "".join(f"<field name={quoteattr(n)}>{escape(s(v))}</field>" for n, v in pairs) + f"</{rows}>\n"
        return style.format(**{n: escape(s(v)) for n, v in pairs})

    with source_of(target, True).open("wb") as f:
        f.write((prologue or f'<?xml version="1.0" encoding="{encoding}"?>\n').encode(encoding) + f"<{root}>\n".encode(encoding))
        for r in _in_order(t):
            f.write(one(r).encode(encoding))
        f.write(f"</{root}>\n".encode(encoding) + (epilogue or "").encode(encoding))


@method
def tohtml(t: Table, source: Any = None, encoding: str | None = None, errors: str = "strict", **kwargs: Any) -> None:
    """An HTML table; values are escaped."""
    from ..operators.show import displayall

    write_bytes(source, displayall(t, **kwargs).encode(encoding or "utf-8", errors))


@method
def teehtml(t: Table, *args: Any, **kwargs: Any) -> Table:
    return _tee(tohtml, t, *args, **kwargs)


# --- pickles --------------------------------------------------------------------------------------------------------


class _Plain(pickle.Unpickler):
    """Loads built-in values, dates and decimals only: a pickle can't name any other code."""

    ALLOWED = {("datetime", "datetime"), ("datetime", "date"), ("datetime", "time"), ("decimal", "Decimal"), ("builtins", "set"), ("builtins", "frozenset")}

    def find_class(self, module: str, name: str) -> Any:
        if (module, name) in self.ALLOWED:
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} isn't allowed")


def frompickle(source: Any = None) -> Table:
    """Pickled rows, the header first, of plain values."""
    f, rows = io.BytesIO(read_bytes(source)), []
    while True:
        try:
            rows.append(_Plain(f).load())
        except EOFError:
            return from_rows(rows)


def _topickle(t: Any, source: Any, protocol: int, write_header: bool, append: bool) -> None:
    t = as_table(t)
    with source_of(source, True).open("ab" if append else "wb") as f:
        if write_header:
            pickle.dump(tuple(t.columns), f, protocol)
        for r in _in_order(t):
            pickle.dump(tuple(r), f, protocol)


@method
def topickle(t: Table, source: Any = None, protocol: int = -1, write_header: bool = True) -> None:
    _topickle(t, source, protocol, write_header, False)


@method
def appendpickle(t: Table, source: Any = None, protocol: int = -1, write_header: bool = False) -> None:
    _topickle(t, source, protocol, write_header, True)


@method
def teepickle(t: Table, *args: Any, **kwargs: Any) -> Table:
    return _tee(topickle, t, *args, **kwargs)


# --- columnar -------------------------------------------------------------------------------------------------------


def fromparquet(path: str, order: Any = None) -> Table:
    return Table(session().read.parquet(path), order)


@method
def toparquet(t: Table, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    out = as_table(t).df.write.mode(mode)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def fromorc(path: str, order: Any = None) -> Table:
    return Table(session().read.orc(path), order)


@method
def toorc(t: Table, path: str, mode: str = "overwrite") -> None:
    as_table(t).df.write.mode(mode).orc(path)


def frombcolz(source: str, expression: str | None = None, outcols: Sequence[str] | None = None, limit: int | None = None, skip: int = 0) -> Table:
    """A chunked columnar table: a Parquet directory, filter and projection pushed to the scan."""
    df = session().read.parquet(source)
    df = df.where(expression) if expression else df
    df = df.select(*map(col, outcols)) if outcols else df
    df = df.offset(skip) if skip else df
    return Table(df.limit(limit) if limit is not None else df)


@method
def tobcolz(t: Table, path: str, **kwargs: Any) -> None:
    toparquet(t, path, **kwargs)


@method
def appendbcolz(t: Table, path: str, check_names: bool = True) -> None:
    there = session().read.parquet(path).columns
    if check_names and there != as_table(t).columns:
        raise ArgumentError(f"fields {as_table(t).columns}, there {there}")
    toparquet(as_table(t).df.toDF(*there), path, mode="append")


def type_names(t: Table) -> dict[str, str]:
    return {f.name: python_name(f.dataType) for f in t.df.schema}
