"""Aggregations, reductions, counts and statistics."""

from __future__ import annotations

import builtins
import pickle
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..core import ORD, Table, as_table, col, exemplar, fitted, grouping, kind, method, resolve, resolve_all, session, sorting, spark_type
from ..errors import ArgumentError
from ..functions.expressions import Opaque, Record, Symbol, _column, record_column
from ..functions.types import python_name
from ..plans import mixed
from ..plans.shipping import ship
from .joins import first_rows


def _ordered_list(c: Column, ordered: bool) -> Column:
    """Values in row order, nulls included."""
    if not ordered:
        return F.transform(F.collect_list(F.struct(c.alias("v"))), lambda x: x["v"])
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(ORD).alias("o"), c.alias("v")))), lambda x: x["v"])


class strjoin:
    """Joins values to one text."""

    def __init__(self, separator: str):
        self.separator = separator

    def __call__(self, values: Sequence[Any]) -> str:
        return self.separator.join("" if v is None else str(v) for v in values)


def _registry(f: Any, c: Column | None, ordered: bool) -> Column | None:
    """The built-in aggregate that a known callable or name stands for."""
    name = f if isinstance(f, str) else getattr(f, "__name__", None) if f in (len, sum, min, max, list, set, tuple, any, all, sorted) or f is builtins.sum else None
    if isinstance(f, strjoin):
        return F.array_join(F.transform(_ordered_list(c, ordered), lambda x: F.coalesce(x.cast("string"), F.lit(""))), f.separator)
    known: dict[str, Callable[[], Column]] = {
        "len": lambda: F.count(F.lit(1)), "count": lambda: F.count(F.lit(1)), "sum": lambda: F.sum(c), "min": lambda: F.min(c), "max": lambda: F.max(c), "mean": lambda: F.avg(c), "avg": lambda: F.avg(c), "list": lambda: _ordered_list(c, ordered), "tuple": lambda: _ordered_list(c, ordered),
        "set": lambda: F.sort_array(F.collect_set(c)), "sorted": lambda: F.sort_array(F.collect_list(c)), "any": lambda: F.bool_or(c), "all": lambda: F.bool_and(c), "first": lambda: F.min_by(c, F.col(ORD)), "last": lambda: F.max_by(c, F.col(ORD)), "median": lambda: F.median(c), "stddev": lambda: F.stddev(c), "variance": lambda: F.variance(c), "countdistinct": lambda: F.count_distinct(c),
    }
    return known[name]() if name in known else None


def aggregate_column(t: Table, f: Any, source: Any = None, returns: str | None = None) -> Column:
    """A Column for an aggregation: a Column itself, a registered name or callable, or an opaque callable of the values."""
    if isinstance(f, Column):
        return f
    fields = resolve_all(t, source) if source is not None else []
    c = col(fields[0]) if len(fields) == 1 else F.struct(*map(col, fields)) if fields else F.struct(*map(col, t.columns))
    found = _registry(f, c, t.has_order)
    if found is not None:
        return found
    if not callable(f):
        raise ArgumentError(f"no aggregation {f!r}")

    def run(values):
        return f(list(values))

    return F.udf(run, returns or "double", useArrow=True)(_ordered_list(c, t.has_order))


def _key_columns(t: Table, key: Any) -> tuple[list[str], list[Column]]:
    if key is None:
        return [], []
    if callable(key):
        return ["key"], [record_column(t, key).alias("key")]
    names = resolve_all(t, key)
    return names, [col(n) for n in names]


#: Aggregations whose result doesn't depend on row order.
UNORDERED = (len, sum, min, max, set, sorted, any, all)


def _needs_order(f: Any) -> bool:
    if isinstance(f, Column):
        return False
    return f in ("list", "tuple", "first", "last") if isinstance(f, str) else f not in UNORDERED


def _definition(t: Table, f: Any, value: Any) -> tuple[Any, Any]:
    """Source and aggregation of ``f``, ``(source, f)``, or a source alone, which is listed."""
    if isinstance(f, (tuple, list)):
        return (f[0], f[1]) if len(f) == 2 else (None, f[0])
    if isinstance(f, str) and f in t.columns:
        return f, list
    return value, f


@method
@sorting
def aggregate(t: Table, key: Any, aggregation: Any = None, value: Any = None, field: str = "value", returns: str | None = None) -> Table:
    """Groups reduced by one aggregation, or by several ``{out: f | (source, f) | (sources, f)}``.

    Without a key a table without rows gives no row.
    """
    t = as_table(t)
    defs = {o: _definition(t, f, value) for o, f in (aggregation.items() if isinstance(aggregation, dict) else [(field, aggregation)])}
    if any(_needs_order(f) for _, f in defs.values()):
        t = t.ordered()
    names, keys = _key_columns(t, key)
    aggs = [aggregate_column(t, f, s, returns).alias(o) for o, (s, f) in defs.items()]
    if keys:
        return Table(t.frame.groupBy(*keys).agg(*aggs), order=names)
    return Table(t.frame.agg(*aggs, F.count(F.lit(1)).alias("__n")).where("__n > 0").drop("__n"))


@method
@sorting
def rowreduce(t: Table, key: Any, reducer: Callable[[Any, list[Record]], Sequence[Any]], schema: str) -> Table:
    """One row, as ``schema`` (DDL), that ``reducer(key, rows)`` gives for each group."""
    from .columns import rowgroupmap

    return rowgroupmap(t, key, lambda k, rows: [reducer(k, rows)], schema)


@method
@sorting
def fold(t: Table, key: Any, f: Callable[[Any, Any], Any], value: Any = None, returns: str | None = None, associative: bool = False) -> Table:
    """``reduce(f, values)`` of each group in row order; fields ``key`` and ``value``.

    Values stream through ``f`` in sorted batches with the result so far carried on, so a group takes no memory however large it is. Groups are dealt by key; where ``f``
    is ``associative``, rows are dealt by key and order instead: parts of a group are folded in several tasks, and their results in order.
    The results' type is ``returns``, or what ``f`` makes of the values' type in the end (integers are 64 bits wide, a float among them makes doubles).
    """
    t = as_table(t).ordered()
    k = resolve_all(t, key)
    v = resolve(t, value if value is not None else t.columns[-1])
    name = col(k[0]) if len(k) == 1 else F.struct(*map(col, k))
    rows = t.frame.select(name.alias("key"), col(v).alias("value"), F.col(ORD).alias("o"))
    to = T._parse_datatype_string(returns) if isinstance(returns, str) else returns
    if to is None:
        to = folded_type(f, kind(t, v)) or _found_type(_folds(rows, f, None, False))
    if not associative:
        return Table(_folds(rows, f, to, False).select("key", "value"), order="key")
    parts = _folds(rows, f, to, True)
    return Table(_folds(parts, f, to, False).select("key", "value"), order="key")


def folded_type(f: Callable[[Any, Any], Any], own: T.DataType) -> T.DataType | None:
    """The type of a fold's results: that of ``f`` of itself and the values, once it is stable; None where ``f`` can't be traced."""
    to = mixed.common([own, T.LongType()]) if isinstance(own, T.IntegralType) else own
    frame = session().range(0).select(F.lit(None).cast(own).alias("v"))
    for _ in range(4):
        try:
            got = f(Symbol(F.lit(None).cast(to)), Symbol(F.col("v")))
        except (Opaque, TypeError, AttributeError, ValueError):
            return None
        if not isinstance(got, (Symbol, Column)):
            return None
        try:
            after = mixed.common([to, frame.select(_column(got).alias("x")).schema["x"].dataType])
        except AnalysisException:
            return None
        after = T.LongType() if isinstance(after, T.IntegralType) else after
        if after == to:
            return to
        to = after
    return None if isinstance(to, T.VariantType) else to


def _found_type(pickled: DataFrame) -> T.DataType:
    """The type of all results of an opaque fold, by a pass over them."""
    return spark_type([pickle.loads(r[0]) for r in pickled.select("value").distinct().collect()])


def _folds(rows: DataFrame, f: Callable[[Any, Any], Any], to: T.DataType | None, parts: bool) -> DataFrame:
    """``key, value, o`` of each run of a key: folded values and the first row's order. Of each part of a key with ``parts``; the results' kinds alone, pickled, without a type."""
    ship(rows.sparkSession)
    placed = rows.repartitionByRange("key", "o") if parts else rows.repartition("key")
    schema = T.StructType([rows.schema["key"], T.StructField("value", to or T.BinaryType()), rows.schema["o"]])
    arrow = to_arrow_schema(schema)

    def result(x: Any) -> Any:
        return fitted(x, to) if to is not None else pickle.dumps(exemplar(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        current: tuple | None = None  # key, value so far, order of the first row
        for b in batches:
            for key, x, o in zip(*(b.column(n).to_pylist() for n in ("key", "value", "o")), strict=True):
                if current is not None and current[0] == key:
                    current = (key, f(current[1], x), current[2])
                    continue
                if current is not None:
                    done.append(current)
                current = (key, x, o)
            if done:
                yield packed(done)
                done = []
        if current is not None:
            yield packed([current])

    def packed(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(([r[0] for r in found], [result(r[1]) for r in found], [r[2] for r in found]), arrow, strict=True)], schema=arrow)

    return placed.sortWithinPartitions("key", "o").mapInArrow(run, schema)


@method
@sorting
def groupcountdistinctvalues(t: Table, key: Any, value: str | int) -> Table:
    """Distinct values of each group; null is a value."""
    t = as_table(t)
    k, v = resolve_all(t, key), resolve(t, value)
    n = F.count_distinct(col(v)) + F.max(col(v).isNull().cast("long"))
    return Table(t.frame.groupBy(*map(col, k)).agg(n.alias("value")), order=k)


@method
@sorting
def groupselectfirst(t: Table, key: Any) -> Table:
    """The first row of each group."""
    t = as_table(t)
    return first_rows(t, resolve_all(t, key))


@method
@sorting
def groupselectlast(t: Table, key: Any) -> Table:
    t = as_table(t)
    return first_rows(t, resolve_all(t, key), last=True)


def _extreme(t: Any, key: Any, value: str | int, largest: bool) -> Table:
    t = as_table(t).ordered()
    v = col(resolve(t, value))
    rows = F.struct(*[col(c) for c in t.frame.columns])
    groups = [k.alias(f"__k{i}") for i, k in enumerate(grouping(t, resolve_all(t, key)))]
    by = [F.col(f"__k{i}") for i in range(len(groups))]
    # the first row of each value, then the extreme value of each group: partial sums both, no group is sorted
    each = t.frame.groupBy(*groups, v.alias("__v")).agg(F.min_by(rows, F.col(ORD)).alias("__r"))
    pick = (F.max_by if largest else F.min_by)("__r", F.struct(F.col("__v").isNotNull().alias("n"), F.col("__v").alias("v")))
    return Table(each.groupBy(*by).agg(pick.alias("r")).select("r.*"))


@method
@sorting
def groupselectmin(t: Table, key: Any, value: str | int) -> Table:
    """The row with the smallest value of each group; null is the smallest, of ties the first row."""
    return _extreme(t, key, value, False)


@method
@sorting
def groupselectmax(t: Table, key: Any, value: str | int) -> Table:
    """The row with the largest value of each group; of ties the first row."""
    return _extreme(t, key, value, True)


@method
@sorting
def mergeduplicates(t: Table, key: Any, missing: Any = None, conflicts: str = "columns") -> Table:
    """One row for each key: of each field the one value that isn't missing.

    Where several differ the field is null and ``<field>_conflict`` has them, sorted; with ``conflicts="array"`` every
    field is an array of its values instead.
    """
    t = as_table(t)
    k = resolve_all(t, key)
    rest = [c for c in t.columns if c not in k]
    sets = [F.sort_array(F.collect_set(F.nullif(col(c), F.lit(missing)) if missing is not None else col(c))).alias(c) for c in rest]
    merged = t.frame.groupBy(*map(col, k)).agg(*sets) if sets else t.frame.select(*map(col, k)).distinct()
    if conflicts == "array":
        return Table(merged, order=k)
    one = [F.when(F.size(col(c)) == 1, col(c)[0]).otherwise(F.when(F.size(col(c)) == 0, F.lit(missing)) if missing is not None else None).alias(c) for c in rest]
    several = [F.when(F.size(col(c)) > 1, col(c)).alias(f"{c}_conflict") for c in rest]
    return Table(merged.select(*map(col, k), *one, *several), order=k)


@method
@sorting
def merge(*tables: Table, key: Any, missing: Any = None, conflicts: str = "columns") -> Table:
    """Tables of any headers united, then one row for each key."""
    from .setops import cat

    return mergeduplicates(cat(*tables), key, missing, conflicts)


class Conflict(frozenset):
    """Different values of one field of one key, for results on the driver."""

    def __new__(cls, items: Sequence[Any]):
        return super().__new__(cls, items)


# --- counts and statistics ------------------------------------------------------------------------------------------


@method
def nrows(t: Table) -> int:
    return as_table(t).frame.count()


@method
def valuecount(t: Table, field: str | int, value: Any) -> tuple[int, float | None]:
    """Rows with a value, and their share; no share without rows."""
    t = as_table(t)
    n, all_ = t.frame.agg(F.count_if(col(resolve(t, field)).eqNullSafe(value)), F.count(F.lit(1))).first()
    return n, n / all_ if all_ else None


@method
def valuecounts(t: Table, *fields: Any) -> Table:
    """Values with count and frequency, the most frequent first."""
    t = as_table(t)
    k = resolve_all(t, fields)
    counts = t.frame.groupBy(*map(col, k)).agg(F.count(F.lit(1)).alias("count"))
    total = t.frame.agg(F.count(F.lit(1)).alias("__total"))
    return Table(counts.join(F.broadcast(total)).select(*map(col, k), "count", (F.col("count") / F.col("__total")).alias("frequency"), F.struct((-F.col("count")).alias("n"), *map(col, k)).alias(ORD)))


@method
def valuecounter(t: Table, *fields: Any) -> Counter:
    t = as_table(t)
    k = resolve_all(t, fields)
    return Counter({(r[0] if len(k) == 1 else tuple(r[:-1])): r[-1] for r in t.frame.groupBy(*map(col, k)).count().toLocalIterator()})


#: Parsers by name: a value of text parses if the column isn't null.
PARSERS: dict[str, Callable[[Column], Column]] = {"int": lambda c: F.trim(c).try_cast("long"), "float": lambda c: F.trim(c).try_cast("double"), "bool": lambda c: F.trim(c).try_cast("boolean"), "date": lambda c: F.trim(c).try_cast("date"), "datetime": lambda c: F.trim(c).try_cast("timestamp_ntz")}


@method
def parsecounts(t: Table, field: str | int, parsers: Sequence[str] = ("int", "float")) -> Table:
    """For each parser, the text values that parse and those that don't."""
    t = as_table(t)
    c = col(resolve(t, field))
    is_text = isinstance(t.frame.schema[resolve(t, field)].dataType, T.StringType)
    value = c if is_text else F.lit(None).cast("string")
    sums = [F.struct(F.lit(p).alias("type"), F.count_if(value.isNotNull() & PARSERS[p](value).isNotNull()).alias("count"), F.count_if(value.isNotNull() & PARSERS[p](value).isNull()).alias("errors")) for p in parsers]
    return Table(t.frame.agg(F.array(*sums).alias("x")).select(F.inline("x")), order="type")


@method
def parsecounter(t: Table, field: str | int, parsers: Sequence[str] = ("int", "float")) -> tuple[Counter, Counter]:
    rows = parsecounts(t, field, parsers).df.collect()
    return Counter({r["type"]: r["count"] for r in rows}), Counter({r["type"]: r["errors"] for r in rows})


@method
def typecounts(t: Table, field: str | int) -> Table:
    """Types of a field's values with count and frequency: the column's type or, in a column of unlike ones, each value's; NoneType for nulls."""
    t = as_table(t)
    c = resolve(t, field)
    own = t.frame.schema[c].dataType
    kind = mixed.python_type(col(c)) if isinstance(own, T.VariantType) else F.when(col(c).isNull(), "NoneType").otherwise(python_name(own))
    return valuecounts(Table(t.frame.select(kind.alias("type"))), "type")


@method
def typecounter(t: Table, field: str | int) -> Counter:
    return Counter({r["type"]: r["count"] for r in typecounts(t, field).df.collect()})


@method
def typeset(t: Table, field: str | int) -> set[str]:
    return set(typecounter(t, field))


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


@method
def stringpatterns(t: Table, field: str | int) -> Table:
    """Patterns of text (letters as A and a, digits as 9) with count and frequency."""
    t = as_table(t)
    text = col(resolve(t, field)).cast("string")
    pattern = F.translate(text, _UPPER + _LOWER + _DIGITS, "A" * 26 + "a" * 26 + "9" * 10)
    return valuecounts(Table(t.frame.select(pattern.alias("pattern"))), "pattern")


@method
def stringpatterncounter(t: Table, field: str | int) -> Counter:
    return Counter({r["pattern"]: r["count"] for r in stringpatterns(t, field).df.toLocalIterator()})


@method
def rowlengths(t: Table) -> Table:
    """Row lengths with counts: up to the last value that isn't null."""
    t = as_table(t)
    length = F.coalesce(F.array_max(F.array(*[F.when(col(c).isNotNull(), i + 1) for i, c in enumerate(t.columns)])), F.lit(0))
    return Table(t.frame.select(length.alias("length")).groupBy("length").count(), order="length")


@method
def limits(t: Table, field: str | int) -> tuple[Any, Any]:
    t = as_table(t)
    c = col(resolve(t, field))
    return tuple(t.frame.agg(F.min(c), F.max(c)).first())


@method
def statsframe(t: Table, field: str | int) -> Table:
    """One row: count, errors, sum, min, max, mean, pvariance and pstdev of the values that are numbers."""
    t = as_table(t)
    c = col(resolve(t, field))
    v = c.cast("string").try_cast("double") if isinstance(t.frame.schema[resolve(t, field)].dataType, T.StringType) else c.cast("double")
    return Table(t.frame.agg(F.count(v).alias("count"), F.count_if(v.isNull()).alias("errors"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.var_pop(v).alias("pvariance"), F.stddev_pop(v).alias("pstdev")))


@method
def stats(t: Table, field: str | int) -> Any:
    return statsframe(t, field).df.first()


@method
def diffheaders(a: Table, b: Table) -> tuple[set[str], set[str]]:
    """Names that were added, and that were removed."""
    x, y = set(as_table(a).columns), set(as_table(b).columns)
    return y - x, x - y


@method
def diffvalues(a: Table, b: Table, field: str | int) -> tuple[set, set]:
    """Values that were added, and that were removed."""
    a, b = as_table(a), as_table(b)
    x, y = a.frame.select(col(resolve(a, field))).distinct(), b.frame.select(col(resolve(b, field))).distinct()
    return {r[0] for r in y.exceptAll(x).collect()}, {r[0] for r in x.exceptAll(y).collect()}
