"""Reshaping between wide and long."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import ORD, Table, as_table, col, method, resolve, resolve_all, unique_names, sorting
from ..plans.numbering import numbered
from .aggregates import aggregate_column


def _one_type(t: Table, fields: list[str]) -> str:
    kinds = {t.frame.schema[c].dataType.simpleString() for c in fields}
    if len(kinds) == 1:
        return kinds.pop()
    return "double" if all(isinstance(t.frame.schema[c].dataType, T.NumericType) for c in fields) else "string"


@method
def melt(t: Table, key: Any = None, variables: Any = None, variablefield: str = "variable", valuefield: str = "value") -> Table:
    """Wide to long: a row for each key and variable, nulls too; values of different types become text."""
    t = as_table(t)
    if key is None and variables is None:
        raise ValueError("key or variables")
    wide = resolve_all(t, variables) if variables is not None else [c for c in t.columns if c not in resolve_all(t, key)]
    keys = resolve_all(t, key) if key is not None else [c for c in t.columns if c not in wide]
    kind = _one_type(t, wide)
    pairs = F.array(*[F.struct(F.lit(c).alias(variablefield), col(c).cast(kind).alias(valuefield)) for c in wide])
    out = t.frame.select(*map(col, keys), *([ORD] if t.has_order else []), F.posexplode(pairs).alias("__p", "__v"))
    order = [F.struct(F.col(ORD).alias("o"), F.col("__p").alias("p")).alias(ORD)] if t.has_order else []
    return Table(out.select(*map(col, keys), "__v.*", *order))


def _names(df, column: str) -> list[Any]:
    """Distinct values of the column that gives the new header: as many as the result has fields."""
    return [r[0] for r in df.select(col(column)).distinct().orderBy(col(column)).toLocalIterator() if r[0] is not None]


@method
@sorting
def recast(t: Table, key: Any = None, variablefield: str = "variable", valuefield: str = "value", reducers: dict[str, Any] | None = None, missing: Any = None) -> Table:
    """Long to wide; variables are found over all rows; several values of a cell become an array or are reduced."""
    t = as_table(t).ordered()
    variable, value = resolve(t, variablefield), resolve(t, valuefield)
    keys = resolve_all(t, key) if key is not None else [c for c in t.columns if c not in (variable, value)]
    names = _names(t.frame, variable)
    cells = t.frame.groupBy(*map(col, keys), col(variable).alias("__v")).agg(F.count(F.lit(1)).alias("__n"), F.min_by(F.struct(col(value)), F.col(ORD)).alias("__first"), *[aggregate_column(t, f, value).alias(f"__r{i}") for i, f in enumerate((reducers or {}).values())])
    several = cells.where(F.col("__n") > 1).limit(1).count() > 0 if not reducers else False
    if several:
        lists = t.frame.groupBy(*map(col, keys)).pivot(variable, names).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ORD).alias("o"), col(value).alias("v")))), lambda x: x["v"]))
        return Table(lists, order=keys)
    out: list[Column] = []
    for v in names:
        which = list(reducers or {}).index(v) if v in (reducers or {}) else None
        cell = F.col("__first")[value] if which is None else F.col(f"__r{which}")
        c = F.max_by(cell, F.when(F.col("__v") == v, 1))
        out.append((F.coalesce(c, F.lit(missing)) if missing is not None else c).alias(str(v)))
    return Table(cells.groupBy(*map(col, keys)).agg(*out), order=keys)


@method
@sorting
def pivot(t: Table, f1: str | int, f2: str | int, f3: str | int, aggfun: Any, missing: Any = None) -> Table:
    """A crosstab: rows by ``f1``, columns by sorted values of ``f2``, cells the aggregation of ``f3``."""
    t = as_table(t)
    a, b, c = resolve(t, f1), resolve(t, f2), resolve(t, f3)
    values = _names(t.frame, b)
    out = t.frame.groupBy(col(a)).pivot(b, values).agg(aggregate_column(t, aggfun, c))
    names = [a, *map(str, values)]
    out = out.toDF(*names)
    if missing is not None:
        out = out.select(col(a), *[F.coalesce(col(n), F.lit(missing)).alias(n) for n in names[1:]])
    return Table(out, order=[a])


@method
def transpose(t: Table, limit: int = 10_000) -> Table:
    """Rows as columns: the first field's values become the header. Values are text.

    The result has a column per row, so more than ``limit`` rows are refused.
    """
    t = as_table(t)
    n = numbered(t, "__row")
    first, rest = t.columns[0], t.columns[1:]
    names = [str(r[0]) for r in n.frame.orderBy("__row").select(col(first)).limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} rows")
    long = n.frame.select("__row", F.posexplode(F.array(*[F.struct(F.lit(c).alias("c"), col(c).cast("string").alias("v")) for c in rest])).alias("p", "x"))
    wide = long.groupBy("p", "x.c").agg(*[F.max_by("x.v", F.when(F.col("__row") == i, 1)).alias(f"__c{i}") for i in range(len(names))])
    shown = unique_names([first, *names])
    return Table(wide.select(F.col("c").alias(shown[0]), *[F.col(f"__c{i}").alias(x) for i, x in enumerate(shown[1:])], F.struct("p").alias(ORD)))


@method
def flatten(t: Table) -> Table:
    """All cells, row by row, in one field ``value``."""
    t = as_table(t).ordered()
    kind = _one_type(t, t.columns)
    out = t.frame.select(ORD, F.posexplode(F.array(*[col(c).cast(kind) for c in t.columns])).alias("__p", "value"))
    return Table(out.select("value", F.struct(F.col(ORD).alias("o"), F.col("__p").alias("p")).alias(ORD)))


@method
def unflatten(t: Table, *args: Any, missing: Any = None) -> Table:
    """A field's values in rows of ``period``: ``unflatten(table, field, period)`` or, for one field, ``unflatten(table, period)``."""
    t = as_table(t)
    field, period = (resolve(t, args[0]), args[1]) if len(args) == 2 else (t.columns[0], args[0])
    n = numbered(t, "__row")
    row, at = F.floor(F.col("__row") / period).alias("__r"), F.col("__row") % period
    cells = [F.max_by(col(field), F.when(at == i, 1)).alias(f"f{i}") for i in range(period)]
    there = [F.max(F.when(at == i, 1)).alias(f"__t{i}") for i in range(period)]
    out = n.frame.groupBy(row).agg(*cells, *there)
    shown = [F.when(F.col(f"__t{i}").isNull(), F.lit(missing)).otherwise(F.col(f"f{i}")).alias(f"f{i}") if missing is not None else F.col(f"f{i}") for i in range(period)]
    return Table(out.select(*shown, F.struct("__r").alias(ORD)))
