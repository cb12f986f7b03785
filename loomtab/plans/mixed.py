"""Columns of unlike types: one type for several inputs, and keys that compare values of any type.

Numbers compare with numbers by value, whatever their types (booleans are numbers), and come before all else; then kinds of values follow each other by the rank of
their Python type. Null is lowest. Nothing is cast to be compared: an integer never equals a text that looks like it.

A column that has to hold unlike types is a VARIANT, which keeps each value's own type. ``key`` is a struct that orders, hashes and groups as the values
compare: rank, number (the nearest double), rest (what that double lacks of an integer or decimal), text (of all others, in their order).
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranks of kinds of values: numbers first, the others by the names of their Python types (bytes and text as ``str`` and ``unicode``).
RANKS = {"number": 0, "date": 1, "datetime": 2, "dict": 3, "list": 4, "bytes": 5, "time": 6, "str": 7}
EXACT = "decimal(38,18)"
KEY = f"struct<rank:tinyint,number:double,rest:{EXACT},text:string>"
VARIANT = T.VariantType()

_KINDS = ((T.NumericType, "number"), (T.BooleanType, "number"), (T.DateType, "date"), ((T.TimestampType, T.TimestampNTZType), "datetime"), ((T.MapType, T.StructType), "dict"), (T.ArrayType, "list"), (T.BinaryType, "bytes"), (T.TimeType, "time"), (T.StringType, "str"))
#: Starts of a variant value's type name, and its kind and Python type.
_NAMES = {"BOOLEAN": ("number", "bool"), "BIGINT": ("number", "int"), "DECIMAL": ("number", "Decimal"), "DOUBLE": ("number", "float"), "FLOAT": ("number", "float"), "DATE": ("date", "date"), "TIMESTAMP": ("datetime", "datetime"), "OBJECT": ("dict", "dict"), "ARRAY": ("list", "list"), "BINARY": ("bytes", "bytes"), "STRING": ("str", "str")}


def kind_of(to: T.DataType) -> str | None:
    """A type's kind; None for VARIANT and for the type of nulls."""
    return next((n for k, n in _KINDS if isinstance(to, k)), None)


def literal_type(value: Any) -> T.DataType:
    """The type of a constant."""
    kinds = ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()), ((bytes, bytearray), T.BinaryType()), (datetime.datetime, T.TimestampNTZType()), (datetime.date, T.DateType()))
    return next((to for k, to in kinds if isinstance(value, k)), T.NullType() if value is None else VARIANT)


def alike(a: T.DataType, b: T.DataType) -> bool:
    """Whether Spark compares values of both types by value as they are."""
    return a == b or T.NullType() in (a, b) and VARIANT not in (a, b) or all(isinstance(x, T.IntegralType) for x in (a, b)) or all(isinstance(x, (T.FloatType, T.DoubleType)) for x in (a, b)) or all(isinstance(x, T.StringType) for x in (a, b))


def common(kinds: Iterable[T.DataType]) -> T.DataType:
    """One type that holds values of all: the widest of numbers (a float among integers makes doubles), VARIANT for unlike ones."""

    def both(a: T.DataType, b: T.DataType) -> T.DataType:
        if a == b or isinstance(b, T.NullType):
            return a
        if isinstance(a, T.NullType):
            return b
        if all(isinstance(x, T.IntegralType) for x in (a, b)):
            widths = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())
            return widths[max(widths.index(a), widths.index(b))]
        if all(isinstance(x, T.NumericType) for x in (a, b)):
            decimals = [x for x in (a, b) if isinstance(x, T.DecimalType)]
            if not decimals or any(isinstance(x, (T.FloatType, T.DoubleType)) for x in (a, b)):
                return T.DoubleType()
            scale, whole = max(x.scale for x in decimals), max(x.precision - x.scale if isinstance(x, T.DecimalType) else 19 for x in (a, b))
            return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else VARIANT
        if all(isinstance(x, T.StringType) for x in (a, b)):
            return T.StringType()
        if all(isinstance(x, T.ArrayType) for x in (a, b)) and (inner := both(a.elementType, b.elementType)) != VARIANT:
            return T.ArrayType(inner)
        return VARIANT

    return reduce(both, kinds, T.NullType())


def as_type(c: Column, own: T.DataType, to: T.DataType) -> Column:
    """A column as a type that ``common`` gave for it."""
    if own == to:
        return c
    if not isinstance(to, T.VariantType):
        return c.cast(to)
    if isinstance(own, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_variant_object(c)
    return (c.cast("string") if isinstance(own, T.TimeType) else c).cast(to)


def united(columns: list[tuple[Column, T.DataType]]) -> tuple[list[Column], T.DataType]:
    """Columns of several inputs in one type, and that type."""
    to = common(k for _, k in columns)
    return [as_type(c, k, to) for c, k in columns], to


def text(c: Column, own: T.DataType) -> Column:
    """A value other than a number, as text in its order."""
    return F.hex(c) if isinstance(own, T.BinaryType) else F.to_json(c) if isinstance(own, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")


def _number(c: Column, exact: Column | None) -> list[Column]:
    near = c.cast("double")
    rest = F.lit(0) if exact is None else F.coalesce(F.try_subtract(exact, near.try_cast(EXACT)), F.lit(0))
    return [near, rest.cast(EXACT)]


def key(c: Column, own: T.DataType) -> Column:
    """The comparable key of a column; null for null."""
    if isinstance(own, T.NullType):
        return F.lit(None).cast(KEY)
    if isinstance(own, T.VariantType):
        name = F.schema_of_variant(c)
        numeric = reduce(Column.__or__, [name.startswith(n) for n, (k, _) in _NAMES.items() if k == "number"])
        rank = F.coalesce(*[F.when(name.startswith(n), F.lit(RANKS[k])) for n, (k, _) in _NAMES.items()], F.lit(RANKS["str"]))
        exact = F.when(name.startswith("BIGINT") | name.startswith("DECIMAL"), F.try_variant_get(c, "$", EXACT))
        near, rest = _number(F.when(numeric, F.try_variant_get(c, "$", "double")), exact)
        words = F.when(name == "BINARY", F.hex(F.try_variant_get(c, "$", "binary"))).when(~numeric, F.try_variant_get(c, "$", "string"))
        parts = [rank, near, rest, words]
    elif kind_of(own) == "number":
        whole = isinstance(own, (T.IntegralType, T.DecimalType))
        parts = [F.lit(RANKS["number"]), *_number(c.cast("int") if isinstance(own, T.BooleanType) else c, c.try_cast(EXACT) if whole else None), F.lit(None)]
    else:
        parts = [F.lit(RANKS[kind_of(own) or "str"]), F.lit(None), F.lit(0), text(c, own)]
    fields = zip(("rank", "number", "rest", "text"), ("tinyint", "double", EXACT, "string"), parts, strict=True)
    return F.when(c.isNotNull(), F.struct(*[p.cast(to).alias(n) for n, to, p in fields]))


def comparable(c: Column, own: T.DataType) -> Column:
    """What to sort, group or hash a column by: its key for VARIANT, else the column."""
    return key(c, own) if isinstance(own, T.VariantType) else c


def sides(a: Column, own_a: T.DataType, b: Column, own_b: T.DataType) -> tuple[Column, Column]:
    """Two columns to compare with each other: as they are, or by their keys."""
    return (a, b) if alike(own_a, own_b) and not isinstance(own_a, T.VariantType) else (key(a, own_a), key(b, own_b))


def python_type(c: Column) -> Column:
    """The Python type's name of each value of a VARIANT."""
    name = F.schema_of_variant(c)
    return F.coalesce(F.when(c.isNull(), "NoneType"), *[F.when(name.startswith(n), F.lit(p)) for n, (_, p) in _NAMES.items()], F.lit("str"))


def unwrapped(value: Any) -> Any:
    """A value on the driver: a VARIANT's as its own Python type."""
    return value.toPython() if isinstance(value, T.VariantVal) else value
