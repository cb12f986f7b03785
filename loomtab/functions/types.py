"""Names of column types as Python has them."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = (
    (T.BooleanType, "bool"), (T.IntegralType, "int"), (T.FractionalType, "float"), (T.StringType, "str"), (T.BinaryType, "bytes"), (T.DateType, "date"), ((T.TimestampType, T.TimestampNTZType), "datetime"), (T.TimeType, "time"), (T.ArrayType, "list"), (T.MapType, "dict"), (T.StructType, "tuple"),
)


def python_name(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return "Decimal"
    return next((n for k, n in _KINDS if isinstance(kind, k)), kind.simpleString())


def of_kind(kind: T.DataType, wanted) -> bool:
    """Whether values of a column type are instances of a Python type, of one of several, or of a type by name."""
    return any(python_name(kind) == (w if isinstance(w, str) else w.__name__) for w in (wanted if isinstance(wanted, tuple) else (wanted,)))
