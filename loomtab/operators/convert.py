"""Value conversion with an explicit error policy.

Known callables and method names become built-in expressions; opaque ones run Arrow-batched. What a conversion can't handle becomes
``errorvalue`` (``failonerror=False``), raises (``True``), or is kept beside the value as struct<value, error> (``"inline"``).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..core import Table, as_table, col, method, resolve, resolve_all
from ..errors import ArgumentError
from ..functions.expressions import SymbolicRecord, Symbol, opaque, record_column, traced
from ..functions.parsers import Parser
from .columns import mapped

_PY_INT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"


def _to_int(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(_PY_INT), F.trim(F.replace(c, F.lit("_"), F.lit(""))).try_cast("long"))
    return c.try_cast("long")


def _to_float(c: Column, kind: T.DataType) -> Column:
    return F.trim(c).try_cast("double") if isinstance(kind, T.StringType) else c.try_cast("double")


#: Callables that are casts. Python's ``bool`` of a text is whether it's empty.
CASTS: dict[Any, Callable[[Column, T.DataType], Column]] = {
    int: _to_int,
    float: _to_float,
    str: lambda c, k: c.cast("string"),
    bool: lambda c, k: c != "" if isinstance(k, T.StringType) else c.try_cast("boolean"),
    len: lambda c, k: F.size(c) if isinstance(k, (T.ArrayType, T.MapType)) else F.length(c),
    abs: lambda c, k: F.abs(c),
    round: lambda c, k: F.bround(c, 0).try_cast("long"),
}
CASTS |= {f.__name__: g for f, g in list(CASTS.items())}

#: Text methods by name, with their arguments.
METHODS: dict[str, Callable[..., Column]] = {
    "upper": lambda c: F.upper(c), "lower": lambda c: F.lower(c), "title": lambda c: F.initcap(c), "capitalize": lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30))), "swapcase": lambda c: F.translate(c, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "strip": lambda c, x=" \t\n\r\x0b\x0c": F.btrim(c, F.lit(x)), "lstrip": lambda c, x=" \t\n\r\x0b\x0c": F.ltrim(c, F.lit(x)), "rstrip": lambda c, x=" \t\n\r\x0b\x0c": F.rtrim(c, F.lit(x)),
    "replace": lambda c, a, b: F.replace(c, F.lit(a), F.lit(b)), "split": lambda c, x=None: F.split(F.trim(c), r"\s+") if x is None else F.split(c, f"\\Q{x}\\E"), "startswith": lambda c, x: c.startswith(x), "endswith": lambda c, x: c.endswith(x), "zfill": lambda c, n: F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c), "ljust": lambda c, n, x=" ": F.when(F.length(c) < n, F.rpad(c, n, x)).otherwise(c), "rjust": lambda c, n, x=" ": F.when(F.length(c) < n, F.lpad(c, n, x)).otherwise(c),
    "find": lambda c, x: F.instr(c, x) - 1, "count": lambda c, x: F.regexp_count(c, F.lit(f"\\Q{x}\\E")), "isdigit": lambda c: c.rlike("^[0-9]+$"), "isalpha": lambda c: c.rlike(r"^\p{L}+$"), "join": lambda c, x="": F.array_join(c, x),
}


def converted(t: Table, field: str, how: Any, failonerror: Any, errorvalue: Any, returns: str | None = None, pass_row: bool = False) -> Column:
    """The Column of one field's conversion."""
    c, kind = col(field), t.frame.schema[field].dataType
    args: tuple = ()
    if isinstance(how, (tuple, list)) and how and isinstance(how[0], str) and how[0] in METHODS:
        how, args = how[0], tuple(how[1:])
    if isinstance(how, Column):
        out = how
    elif isinstance(how, dict):
        return mapped(c, how)
    elif how is None:
        return c
    elif isinstance(how, Parser):
        out = how.column(c)
    elif isinstance(how, str) and how in METHODS:
        out = METHODS[how](c, *args)
    elif (isinstance(how, str) or callable(how)) and _hashable(how) and how in CASTS:
        out = CASTS[how](c, kind)
    elif callable(how):
        symbols = (Symbol(c), SymbolicRecord(t)) if pass_row else (Symbol(c),)
        found = traced(how, *symbols)
        if found is None:
            f = (lambda r: how(r[field], r)) if pass_row else (lambda r: how(r[field]))
            return opaque(t, f, returns, errorvalue, failonerror is True)
        out = found
    else:
        raise ArgumentError(f"no conversion {how!r}")
    failed = c.isNotNull() & out.isNull()
    if failonerror is True:
        text = F.concat(F.lit(f"conversion of {field} failed: "), c.cast("string"))
        return F.when(failed, F.raise_error(text)).otherwise(out)
    if failonerror == "inline":
        return F.struct(out.alias("value"), F.when(failed, F.concat(F.lit("cannot convert "), c.cast("string"))).alias("error"))
    return F.when(failed, F.lit(errorvalue)).otherwise(out) if errorvalue is not None else out


def _hashable(x: Any) -> bool:
    try:
        hash(x)
    except TypeError:
        return False
    return True


@method
def convert(t: Table, *args: Any, where: Any = None, failonerror: Any = None, errorvalue: Any = None, pass_row: bool = False, returns: str | None = None) -> Table:
    """Converts fields: ``(field | fields, converter[, argument...])``, or a dict or list of converters.

    A converter is a callable, a text method's name with its arguments, a dict of values, a parser, or a Column. ``where``
    (a predicate) leaves the other rows alone.
    """
    t = as_table(t)
    if len(args) == 1 and isinstance(args[0], dict):
        plan = {resolve(t, k): v for k, v in args[0].items()}
    elif len(args) == 1 and isinstance(args[0], (list, tuple)):
        plan = dict(zip(t.columns, args[0], strict=False))
    elif len(args) >= 2:
        how = args[1] if len(args) == 2 else args[1:]
        plan = dict.fromkeys(resolve_all(t, args[0]), how)
    else:
        raise ArgumentError("fields and a converter")
    policy = config.failonerror if failonerror is None else failonerror
    test = record_column(t, where, "boolean") if where is not None else None
    out = []
    for c in t.columns:
        if c not in plan:
            out.append(col(c))
            continue
        new = converted(t, c, plan[c], policy, errorvalue, returns, pass_row)
        if test is not None:
            kind = t.frame.select(new.alias("x")).schema["x"].dataType.simpleString()
            old = col(c) if kind == t.frame.schema[c].dataType.simpleString() else col(c).try_cast(kind)
            new = F.when(F.coalesce(test, F.lit(False)), new).otherwise(old)
        out.append(new.alias(c))
    return t.keep(*out)


@method
def convertall(t: Table, *args: Any, **kwargs: Any) -> Table:
    t = as_table(t)
    return convert(t, t.columns, *args, **kwargs)


def _typed(kind: T.DataType, x: Any) -> Column:
    return F.lit(x).try_cast(kind.simpleString()) if x is not None else F.lit(None)


@method
def replace(t: Table, field: Any, a: Any, b: Any, where: Any = None) -> Table:
    """One value for another; null can be either."""
    t = as_table(t)
    each = {c: F.when(col(c).eqNullSafe(_typed(t.frame.schema[c].dataType, a)) & (F.lit(a is None) | col(c).isNotNull()), F.lit(b)).otherwise(col(c)) for c in resolve_all(t, field)}
    return convert(t, each, where=where, failonerror=False)


@method
def replaceall(t: Table, a: Any, b: Any, where: Any = None) -> Table:
    t = as_table(t)
    fits = [c for c in t.columns if a is None or isinstance(a, str) == isinstance(t.frame.schema[c].dataType, T.StringType)]
    return replace(t, fits, a, b, where)


@method
def update(t: Table, field: Any, value: Any, where: Any = None) -> Table:
    """A constant for a field."""
    t = as_table(t)
    return convert(t, {c: F.lit(value) for c in resolve_all(t, field)}, where=where, failonerror=False)


@method
def convertnumbers(t: Table, strict: bool = False, **kwargs: Any) -> Table:
    """Text fields all of whose values are numbers become long or double; with ``strict`` every text field becomes double."""
    t = as_table(t)
    texts = [c for c in t.columns if isinstance(t.frame.schema[c].dataType, T.StringType)]
    if not texts:
        return t
    if strict:
        return convert(t, texts, float, **kwargs)
    checks = [F.bool_and(_to_int(col(c), T.StringType()).isNotNull() | col(c).isNull()).alias(f"i{i}") for i, c in enumerate(texts)]
    checks += [F.bool_and(_to_float(col(c), T.StringType()).isNotNull() | col(c).isNull()).alias(f"f{i}") for i, c in enumerate(texts)]
    found = t.frame.agg(*checks).first()
    plan = {c: int if found[f"i{i}"] else float for i, c in enumerate(texts) if found[f"i{i}"] or found[f"f{i}"]}
    return convert(t, plan, **kwargs) if plan else t


@method
def format(t: Table, field: Any, fmt: str) -> Table:
    """A format with one ``{}``, with an optional specification of text or of a fixed number of decimals; null gives ``None``."""
    t = as_table(t)
    return convert(t, {c: formatted(t, c, fmt) for c in resolve_all(t, field)}, failonerror=False)


def formatted(t: Table, field: str, fmt: str) -> Column:
    import re

    m = re.fullmatch(r"(?s)(.*?)\{(?:0)?(?::([^{}]*))?\}(.*)", fmt)
    if not m:
        raise ArgumentError(f"format {fmt!r}")
    before, spec, after = m[1].replace("{{", "{").replace("}}", "}"), m[2] or "", m[3].replace("{{", "{").replace("}}", "}")
    c = col(field)
    if not spec:
        text = c.cast("string")
    elif re.fullmatch(r",?(\.\d+f|d)?", spec) or re.fullmatch(r"0?\d+d", spec):
        digits = re.search(r"\.(\d+)f", spec)
        if digits or spec == ",":
            number = F.round(c.cast("double"), int(digits[1])) if digits else c
            text = F.format_string(f"%{',' if ',' in spec else ''}.{digits[1]}f" if digits else "%,d", number)
        else:
            text = F.format_string(f"%{spec}", c.cast("long"))
    elif re.fullmatch(r"[<>^]?\d+s?", spec):
        n = int(re.search(r"\d+", spec)[0])
        text = F.when(F.length(c.cast("string")) < n, (F.lpad if spec[0] == ">" else F.rpad)(c.cast("string"), n, " ")).otherwise(c.cast("string"))
    else:
        return opaque(t, lambda r: fmt.format(r[field]), "string")
    return F.concat(F.lit(before), F.when(c.isNull(), "None").otherwise(text), F.lit(after))


@method
def formatall(t: Table, fmt: str) -> Table:
    t = as_table(t)
    return format(t, t.columns, fmt)


@method
def interpolate(t: Table, field: Any, fmt: str) -> Table:
    """``fmt % value``."""
    t = as_table(t)
    return convert(t, {c: F.format_string(fmt, F.coalesce(col(c).cast("string"), F.lit("None")) if "%s" in fmt else col(c)) for c in resolve_all(t, field)}, failonerror=False)


@method
def interpolateall(t: Table, fmt: str) -> Table:
    t = as_table(t)
    return interpolate(t, t.columns, fmt)
