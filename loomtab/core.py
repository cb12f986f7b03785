"""``Table``: a DataFrame, and the order of its rows where one is declared.

Row order is part of the data model of tabular pipelines, and none of Spark's. A table may carry a hidden column ``__ord``
(a struct of the order columns). Order-dependent operators sort windows by it; all others leave it alone, and Catalyst prunes it
where nothing reads it. A table without a declared order gets one from the scan order when first needed.
"""

from __future__ import annotations

import datetime
import decimal
import functools
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import FieldSelectionError
from .plans.mixed import comparable, unwrapped

ORD = "__ord"


def session() -> SparkSession:
    """The active session, or a local one."""
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


class Table:
    """A DataFrame with an optional row order; operators are functions of the package and methods here."""

    def __init__(self, df: DataFrame, order: str | Sequence[str] | None = None):
        if order is not None and ORD not in df.columns:
            df = df.withColumn(ORD, F.struct(*[F.col(quoted(c)) for c in ([order] if isinstance(order, str) else order)]))
        self.frame = df

    @property
    def columns(self) -> list[str]:
        return [c for c in self.frame.columns if c != ORD]

    @property
    def df(self) -> DataFrame:
        """The rows without the hidden order."""
        return self.frame.drop(ORD) if self.has_order else self.frame

    @property
    def has_order(self) -> bool:
        return ORD in self.frame.columns

    def ordered(self) -> Table:
        """This table with an order: the declared one, or that of the scan."""
        return self if self.has_order else Table(self.frame.withColumn(ORD, F.struct(F.monotonically_increasing_id().alias("scan"))))

    def keep(self, *columns: Column | str) -> Table:
        """A projection that keeps the order."""
        return Table(self.frame.select(*columns, *([ORD] if self.has_order else [])))

    def __getitem__(self, what: str | int | slice):
        if isinstance(what, str):
            return self.df.select(quoted(what))
        from .operators.sorts import rowslice

        return rowslice(self, what.start, what.stop, what.step) if isinstance(what, slice) else self.ordered().frame.orderBy(ORD).drop(ORD).offset(what).limit(1).collect()[0]

    def __len__(self) -> int:
        return self.frame.count()

    def __iter__(self):
        yield tuple(self.columns)
        rows = self.frame.orderBy(ORD).drop(ORD) if self.has_order else self.frame
        yield from (tuple(map(unwrapped, r)) for r in rows.toLocalIterator())

    def __repr__(self) -> str:
        return f"Table[{', '.join(f'{n}: {t}' for n, t in self.df.dtypes)}]"

    def _repr_html_(self) -> str:
        from .operators.show import display

        return display(self)


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def kind(t: Table, name: str) -> T.DataType:
    """A field's type."""
    return t.frame.schema[name].dataType


def grouping(t: Table, names: Iterable[str]) -> list[Column]:
    """What to group, sort or number rows by for fields of any type."""
    return [comparable(col(n), kind(t, n)) for n in names]


def as_table(x: Any) -> Table:
    """A table from a table, a DataFrame, or a header row followed by rows."""
    if isinstance(x, Table):
        return x
    if isinstance(x, DataFrame):
        return Table(x)
    return from_rows(x)


def resolve(t: Table, field: str | int) -> str:
    """A field's name from its name or index."""
    names = t.columns
    if isinstance(field, str) and field in names:
        return field
    if isinstance(field, int) and not isinstance(field, bool) and 0 <= field < len(names):
        return names[field]
    raise FieldSelectionError(f"no field {field!r} among {names}")


def resolve_all(t: Table, fields: Any) -> list[str]:
    """Names of one field or several; nested sequences are flattened; none means all."""
    if fields is None:
        return t.columns
    if isinstance(fields, (str, int)):
        return [resolve(t, fields)]
    return [n for f in fields for n in resolve_all(t, f)]


def unique_names(names: Iterable[Any]) -> list[str]:
    """Names as text, with suffixes for repeated ones."""
    out: list[str] = []
    for n in map(str, names):
        k, m = 2, n
        while m in out:
            m, k = f"{n}_{k}", k + 1
        out.append(m)
    return out


def spark_type(values: Iterable[Any]) -> T.DataType:
    """One type for Python values: numbers widen, mixed kinds become text."""
    kinds = {type(v) for v in values if v is not None}
    if not kinds:
        return T.StringType()
    if kinds == {bool}:
        return T.BooleanType()
    if kinds <= {bool, int}:
        return T.LongType()
    if kinds <= {bool, int, float}:
        return T.DoubleType()
    if kinds <= {bool, int, float, decimal.Decimal}:
        return T.DecimalType(38, 10)
    for kind, to in ((str, T.StringType()), (bytes, T.BinaryType()), (datetime.datetime, T.TimestampNTZType()), (datetime.date, T.DateType()), (datetime.time, T.TimeType())):
        if kinds == {kind}:
            return to
    if kinds <= {list, tuple, set, frozenset}:
        return T.ArrayType(spark_type(x for v in values if v is not None for x in v))
    if kinds == {dict}:
        return T.MapType(T.StringType(), spark_type(x for v in values if v is not None for x in v.values()))
    return T.StringType()


def exemplar(value: Any) -> Any:
    """A small value that stands for all of its kind in ``spark_type``; ``...`` for kinds that it has no type for."""
    kind = type(value)
    if kind in (list, tuple, set, frozenset, dict):
        inner = {repr(x): x for x in map(exemplar, value.values() if kind is dict else value)}
        found = [inner[k] for k in sorted(inner)]
        return dict(enumerate(found)) if kind is dict else found
    for x in (None, False, 0, 0.0, decimal.Decimal(0), "", b"", datetime.datetime(1970, 1, 1), datetime.date(1970, 1, 1), datetime.time()):
        if kind is type(x):
            return x
    return ...


def fitted(value: Any, to: T.DataType) -> Any:
    """A Python value as its column's type has it."""
    if value is None:
        return None
    if isinstance(to, T.StringType):
        return value if isinstance(value, str) else str(value)
    if isinstance(to, T.DoubleType):
        return float(value)
    if isinstance(to, T.LongType):
        if isinstance(value, (float, decimal.Decimal)) and value != int(value):
            raise ValueError(f"{value!r} is no integer")
        return int(value)
    if isinstance(to, T.DecimalType):
        return decimal.Decimal(str(value))
    if isinstance(to, T.ArrayType):
        return [fitted(x, to.elementType) for x in value]
    if isinstance(to, T.MapType):
        return {str(k): fitted(x, to.valueType) for k, x in value.items()}
    return value


def from_rows(rows: Iterable[Sequence[Any]], header: Sequence[Any] | None = None, missing: Any = None) -> Table:
    """Driver rows as a table in their order: short rows are padded, long ones widen the header."""
    it = iter(rows)
    names = list(header) if header is not None else list(next(it, ()))
    data = [tuple(r) for r in it]
    width = max([len(names), *map(len, data)])
    names = unique_names([*names, *(f"f{i}" for i in range(len(names), width))])
    data = [r + (missing,) * (width - len(r)) for r in data]
    schema = T.StructType([T.StructField(n, spark_type([r[i] for r in data])) for i, n in enumerate(names)])
    fit = [tuple(fitted(v, f.dataType) for v, f in zip(r, schema, strict=True)) + (k,) for k, r in enumerate(data)]
    df = session().createDataFrame(fit, T.StructType([*schema.fields, T.StructField("__n", T.LongType())]))
    return Table(df.withColumn(ORD, F.struct(F.col("__n"))).drop("__n"))


#: Keywords of operators that sort, for tables in memory or in buffers: accepted, without effect on what Spark plans.
SORTING = frozenset({"presorted", "buffersize", "tempdir", "cache"})


def method(f: Callable) -> Callable:
    """Registers an operator as a method of ``Table``."""
    setattr(Table, f.__name__, f)
    return f


def sorting(f: Callable) -> Callable:
    """An operator that takes the keywords of ``SORTING`` too."""

    @functools.wraps(f)
    def run(*args: Any, **kwargs: Any) -> Any:
        return f(*args, **{k: v for k, v in kwargs.items() if k not in SORTING})

    return run
