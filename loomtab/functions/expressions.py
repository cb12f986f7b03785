"""Callables and expression strings as Columns.

An expression string such as ``"{foo} > 3 and {bar} == 'x'"`` is parsed, never evaluated: a small set of syntax maps to Columns. A callable of a
record is first traced with a symbolic record; if it uses only what a symbol offers, the result is a Column inside code
generation. Anything else runs as an Arrow-batched Python function over the record.
"""

from __future__ import annotations

import ast
import dis
import operator
import pickle
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import Table, col, exemplar, fitted, resolve, spark_type
from ..errors import ArgumentError, FieldSelectionError
from ..plans.shipping import ship


class Opaque(Exception):
    """What a symbol can't do."""


def _column(x: Any) -> Column:
    return x.column if isinstance(x, Symbol) else x if isinstance(x, Column) else F.lit(x)


def _plain(*_: Any, **__: Any) -> Any:
    raise Opaque


class Symbol:
    """A value that is not known yet: operators give Columns, all that needs the value itself is refused."""

    def __init__(self, column: Column):
        self.column = column

    __hash__ = None
    __bool__ = __str__ = __repr__ = __len__ = __iter__ = __int__ = __float__ = __index__ = __format__ = __contains__ = _plain

    def upper(self):
        return Symbol(F.upper(self.column))

    def lower(self):
        return Symbol(F.lower(self.column))

    def strip(self):
        return Symbol(F.trim(self.column))

    def startswith(self, x: str):
        return Symbol(self.column.startswith(_column(x)))

    def endswith(self, x: str):
        return Symbol(self.column.endswith(_column(x)))


def _binary(f: Callable[[Column, Column], Column]):
    return (lambda a, b: Symbol(f(a.column, _column(b)))), (lambda a, b: Symbol(f(_column(b), a.column)))


def _floor_mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; null for a zero divisor."""
    b = F.nullif(b, F.lit(0))
    return ((a % b) + b) % b


BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": operator.add, "sub": operator.sub, "mul": operator.mul, "truediv": lambda a, b: F.try_divide(a.cast("double"), b), "pow": F.pow,
    "floordiv": lambda a, b: F.floor(F.try_divide(a.cast("double"), b)), "mod": _floor_mod, "and": operator.and_, "or": operator.or_,
}
COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a.eqNullSafe(b), "ne": lambda a, b: ~a.eqNullSafe(b), "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge,
}
for _name, _f in BINARY.items():
    _here, _there = _binary(_f)
    setattr(Symbol, f"__{_name}__", _here)
    setattr(Symbol, f"__r{_name}__", _there)
for _name, _f in COMPARE.items():
    setattr(Symbol, f"__{_name}__", _binary(_f)[0])
Symbol.__neg__ = lambda a: Symbol(-a.column)
Symbol.__abs__ = lambda a: Symbol(F.abs(a.column))
Symbol.__invert__ = lambda a: Symbol(~a.column)


class SymbolicRecord:
    """Fields by name, index or attribute, as symbols."""

    def __init__(self, t: Table, of: Callable[[str], Column] = col):
        self._t, self._of = t, of

    def __getitem__(self, field: str | int) -> Symbol:
        return Symbol(self._of(resolve(self._t, field)))

    def __getattr__(self, field: str) -> Symbol:
        try:
            return self[field]
        except FieldSelectionError as e:
            raise AttributeError(field) from e

    __iter__ = __len__ = __bool__ = __str__ = __repr__ = _plain


def _tests_identity(code: Any) -> bool:
    """Whether code asks if something is None, or is something: a symbol can't answer that."""
    return any(i.opname in ("IS_OP", "POP_JUMP_IF_NONE", "POP_JUMP_IF_NOT_NONE") for i in dis.get_instructions(code)) or any(_tests_identity(c) for c in code.co_consts if hasattr(c, "co_code"))


def traced(f: Callable, *symbols: Any) -> Column | None:
    """The Column that a callable gives for symbols; None if it is opaque."""
    own = __name__.split(".")[0]
    if hasattr(f, "__code__") and not f.__module__.startswith((f"{own}.functions", f"{own}.operators")) and _tests_identity(f.__code__):
        return None
    try:
        got = f(*symbols)
    except (Opaque, TypeError, AttributeError, ValueError, KeyError):
        return None
    if isinstance(got, Symbol):
        return got.column
    if isinstance(got, Column):
        return got
    return F.lit(got) if got is None or isinstance(got, (bool, int, float, str)) else None


class Record(tuple):
    """A row for opaque callables: values by index, name or attribute."""

    def __new__(cls, values: Any, names: tuple[str, ...]):
        out = super().__new__(cls, values)
        out.names = names
        return out

    def __getitem__(self, i: Any) -> Any:
        return super().__getitem__(self.names.index(i) if isinstance(i, str) else i)

    def __getattr__(self, name: str) -> Any:
        if name != "names" and name in self.names:
            return self[name]
        raise AttributeError(name)


def opaque(t: Table, f: Callable[[Record], Any], returns: str | T.DataType | None = None, errorvalue: Any = None, failonerror: bool = False) -> Column:
    """A callable of a record as an Arrow-batched function; its type is ``returns``, or fits what all rows give, found by a pass over them.

    A value that isn't of the type ``returns`` is an error of the callable.
    """
    names = tuple(t.columns)
    ship(t.frame.sparkSession)

    def safe(*values: Any) -> Any:
        try:
            return f(Record(values, names))
        except Exception:
            if failonerror:
                raise
            return errorvalue

    columns = [col(n) for n in names]
    if returns is None:
        kind = F.udf(lambda *v: pickle.dumps(exemplar(safe(*v))), "binary", useArrow=True)
        returns = spark_type([pickle.loads(r[0]) for r in t.df.select(kind(*columns)).distinct().collect()])
    to = T._parse_datatype_string(returns) if isinstance(returns, str) else returns

    def typed(*values: Any) -> Any:
        try:
            return fitted(f(Record(values, names)), to)
        except Exception:
            if failonerror:
                raise
            return fitted(errorvalue, to)

    return F.udf(typed, to, useArrow=True)(*columns)


def context_column(t: Table, frame: DataFrame, w: WindowSpec, query: Callable, returns: str) -> tuple[DataFrame, Column]:
    """``query(previous, current, next)`` over a window's neighbours: an expression if it can be traced, else a function of records."""
    found = traced(query, SymbolicRecord(t, lambda n: F.lag(col(n)).over(w)), SymbolicRecord(t), SymbolicRecord(t, lambda n: F.lead(col(n)).over(w)))
    if found is not None:
        return frame, found
    ship(frame.sparkSession)
    names, to = tuple(t.columns), T._parse_datatype_string(returns)
    row = F.struct(*[col(n).alias(f"c{i}") for i, n in enumerate(names)])

    def run(*rows: Any) -> Any:
        return fitted(query(*[None if r is None else Record(tuple(r), names) for r in rows]), to)

    near = {"__before": F.lag(row).over(w), "__here": row, "__after": F.lead(row).over(w)}
    return frame.withColumns(near), F.udf(run, to, useArrow=True)(*map(F.col, near))


def record_column(t: Table, what: Any, returns: str | T.DataType | None = None, **policy: Any) -> Column:
    """A Column from a Column, an expression string with ``{field}``, a callable of a record, or a constant."""
    if isinstance(what, Column):
        return what
    if isinstance(what, str) and re.search(r"\{[^{}]+\}", what):
        return expression(t, what)
    if callable(what):
        found = traced(what, SymbolicRecord(t))
        return found if found is not None else opaque(t, what, returns, **policy)
    return constant(what)


def constant(x: Any) -> Column:
    if isinstance(x, (list, tuple)):
        return F.array(*map(constant, x))
    return F.lit(x)


def value_column(t: Table, field: str, f: Callable[[Any], Any], returns: str | T.DataType | None = None, **policy: Any) -> Column:
    """A Column from a callable of one field's value."""
    found = traced(f, Symbol(col(field)))
    return found if found is not None else opaque(t, lambda r: f(r[field]), returns, **policy)


# --- expression strings ---------------------------------------------------------------------------------------------

_CALLS: dict[str, Callable[..., Column]] = {
    "len": F.length, "abs": F.abs, "round": lambda x, *n: F.bround(x, *n), "min": F.least, "max": F.greatest, "int": lambda x: x.try_cast("long"), "float": lambda x: x.try_cast("double"), "str": lambda x: x.cast("string"), "bool": lambda x: x.try_cast("boolean"),
}
_METHODS: dict[str, Callable[..., Column]] = {
    "upper": F.upper, "lower": F.lower, "strip": F.trim, "lstrip": F.ltrim, "rstrip": F.rtrim, "startswith": lambda x, y: x.startswith(y), "endswith": lambda x, y: x.endswith(y), "replace": lambda x, a, b: F.replace(x, a, b), "title": F.initcap,
}
_OPERATORS = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "truediv", ast.FloorDiv: "floordiv", ast.Mod: "mod", ast.Pow: "pow"}
_COMPARISONS = {ast.Eq: "eq", ast.NotEq: "ne", ast.Lt: "lt", ast.LtE: "le", ast.Gt: "gt", ast.GtE: "ge", ast.Is: "eq", ast.IsNot: "ne"}


def expression(t: Table, text: str) -> Column:
    """The Column of an expression string; whatever is outside the subset raises ``ArgumentError``."""
    fields: list[str] = []

    def name(m: re.Match) -> str:
        fields.append(m[1])
        return f"__field{len(fields) - 1}"

    try:
        tree = ast.parse(re.sub(r"\{([^{}]+)\}", name, text), mode="eval").body
    except SyntaxError as e:
        raise ArgumentError(f"not an expression: {text}") from e

    def walk(x: ast.expr) -> Column:
        if isinstance(x, ast.Constant):
            return F.lit(x.value)
        if isinstance(x, ast.Name) and x.id.startswith("__field"):
            field = fields[int(x.id[7:])]
            return col(resolve(t, int(field) if field.isdigit() else field))
        if isinstance(x, ast.BinOp) and type(x.op) in _OPERATORS:
            return BINARY[_OPERATORS[type(x.op)]](walk(x.left), walk(x.right))
        if isinstance(x, ast.UnaryOp):
            v = walk(x.operand)
            return ~F.coalesce(v, F.lit(False)) if isinstance(x.op, ast.Not) else -v if isinstance(x.op, ast.USub) else v
        if isinstance(x, ast.BoolOp):
            parts, f = [walk(v) for v in x.values], operator.and_ if isinstance(x.op, ast.And) else operator.or_
            out = parts[0]
            for p in parts[1:]:
                out = f(out, p)
            return out
        if isinstance(x, ast.Compare):
            out, left = None, walk(x.left)
            for op, r in zip(x.ops, x.comparators, strict=True):
                if isinstance(op, (ast.In, ast.NotIn)):
                    one = left.isin(*[v.value for v in r.elts]) if isinstance(r, (ast.List, ast.Tuple, ast.Set)) else walk(r).contains(left)
                    one = ~one if isinstance(op, ast.NotIn) else one
                else:
                    right = walk(r)
                    one, left = COMPARE[_COMPARISONS[type(op)]](left, right), right
                out = one if out is None else out & one
            return out
        if isinstance(x, ast.IfExp):
            return F.when(walk(x.test), walk(x.body)).otherwise(walk(x.orelse))
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id in _CALLS:
            return _CALLS[x.func.id](*map(walk, x.args))
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr in _METHODS:
            return _METHODS[x.func.attr](walk(x.func.value), *map(walk, x.args))
        raise ArgumentError(f"not in the expression subset: {ast.dump(x)[:80]}")

    return walk(tree)


def expr(text: str, trusted: bool = True) -> Callable[[Table], Column]:
    """An expression string as a function of a table; ``trusted`` makes no difference, as nothing is evaluated."""
    del trusted
    return lambda t: expression(t, text)


def truthy(c: Column, kind: T.DataType) -> Column:
    """Python's truth of a value: null, zero and empty are false."""
    if isinstance(kind, T.BooleanType):
        test = c
    elif isinstance(kind, T.NumericType):
        test = c != 0
    elif isinstance(kind, T.StringType):
        test = c != ""
    elif isinstance(kind, T.BinaryType):
        test = F.octet_length(c) > 0
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        test = F.size(c) > 0
    else:
        test = c.isNotNull()
    return F.coalesce(test, F.lit(False))
