"""NumPy, pandas, columns and generated tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import zip_longest
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import ORD, Table, as_table, from_rows, method, resolve, session


@method
def todataframe(t: Table, index: str | None = None, exclude: Sequence[str] | None = None, columns: Sequence[str] | None = None, nrows: int | None = None) -> Any:
    """A pandas frame, rows in order."""
    t = as_table(t)
    df = (t.frame.orderBy(ORD) if t.has_order else t.frame).drop(ORD)
    pdf = (df.limit(nrows) if nrows is not None else df).toPandas()
    pdf = pdf[[c for c in (columns or pdf.columns) if c not in (exclude or ())]]
    return pdf.set_index(index) if index else pdf


def fromdataframe(pdf: Any, include_index: bool = False) -> Table:
    if isinstance(pdf, DataFrame):
        return Table(pdf)
    pdf = pdf.reset_index(names="index") if include_index else pdf
    pdf = pdf.assign(__n=range(len(pdf)))
    return Table(session().createDataFrame(pdf).withColumn(ORD, F.struct("__n")).drop("__n"))


@method
def toarray(t: Table, dtype: Any = None, count: int = -1) -> Any:
    """A structured array."""
    import numpy as np

    records = todataframe(t, nrows=None if count < 0 else count).to_records(index=False)
    return np.asarray(records.astype(dtype) if dtype is not None else records)


@method
def torecarray(t: Table, dtype: Any = None, count: int = -1) -> Any:
    import numpy as np

    return toarray(t, dtype, count).view(np.recarray)


def fromarray(a: Any) -> Table:
    import pandas as pd

    return fromdataframe(pd.DataFrame({n: a[n] for n in a.dtype.names}))


@method
def valuestoarray(t: Table, field: str | int, dtype: Any = None, count: int = -1) -> Any:
    """A field's values as an array."""
    t = as_table(t)
    out = todataframe(t, columns=[resolve(t, field)], nrows=None if count < 0 else count).iloc[:, 0].to_numpy()
    return out.astype(dtype) if dtype is not None else out


def fromcolumns(cols: Sequence[Sequence[Any]], header: Sequence[str] | None = None, missing: Any = None) -> Table:
    """Columns side by side; uneven ones are padded."""
    names = list(header) if header is not None else [f"f{i}" for i in range(len(cols))]
    return from_rows(list(zip_longest(*cols, fillvalue=missing)), names)


def empty() -> Table:
    return Table(session().createDataFrame([], T.StructType([])))


def wrap(x: Any) -> Table:
    """A table from a DataFrame, or from rows with a header first."""
    return as_table(x)


def randomtable(numflds: int = 5, numrows: int = 100, seed: int = 0) -> Table:
    """Fields ``f0..`` of uniform numbers, made by the executors."""
    rows = session().range(numrows).select(F.struct("id").alias(ORD), *[F.rand(seed + i).alias(f"f{i}") for i in range(numflds)])
    return Table(rows)


def dummytable(numrows: int = 100, fields: Sequence[tuple[str, Callable[[int], Column] | Column]] | None = None, seed: int = 0) -> Table:
    """Fields from generators: a Column, or a function of a seed that gives one."""
    fruit = F.array(*map(F.lit, ("apples", "pears", "bananas", "oranges")))
    fields = fields or (("foo", lambda s: F.floor(F.rand(s) * 101)), ("bar", lambda s: F.element_at(fruit, (F.floor(F.rand(s) * 4) + 1).cast("int"))), ("baz", lambda s: F.rand(s)))
    out = [(f if isinstance(f, Column) else f(seed + i)).alias(n) for i, (n, f) in enumerate(fields)]
    return Table(session().range(numrows).select(F.struct("id").alias(ORD), *out))
