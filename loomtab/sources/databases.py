"""Databases. JDBC where a driver jar serves the address; sqlite3 and any DB-API connection through the driver, in batches."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from typing import Any

from pyspark.sql import types as T

from ..core import Table, as_table, from_rows, method, session
from ..errors import ArgumentError
from .files import _in_order

BATCH = 10_000

#: Type names by dialect, fixed values: bool, int, bigint, float, text, bytes, date, datetime, time.
DIALECTS = {
    "sqlite": ("BOOLEAN", "INTEGER", "BIGINT", "FLOAT", "VARCHAR", "BLOB", "DATE", "DATETIME", "TIME"),
    "postgresql": ("BOOLEAN", "INTEGER", "BIGINT", "DOUBLE PRECISION", "VARCHAR", "BYTEA", "DATE", "TIMESTAMP", "TIME"),
    "mysql": ("BOOL", "INTEGER", "BIGINT", "DOUBLE", "VARCHAR", "BLOB", "DATE", "DATETIME", "TIME"),
    "mssql": ("BIT", "INTEGER", "BIGINT", "FLOAT", "VARCHAR", "VARBINARY", "DATE", "DATETIME", "TIME"),
    "oracle": ("SMALLINT", "INTEGER", "NUMBER(19)", "FLOAT", "VARCHAR2", "BLOB", "DATE", "TIMESTAMP", "VARCHAR2(16)"),
}


def _is_jdbc(dbo: Any) -> bool:
    return isinstance(dbo, str) and dbo.startswith("jdbc:")


class _Connection:
    """A DB-API connection from a connection, a function that gives one, a cursor, or an sqlite3 file name; closed if it was opened here."""

    def __init__(self, dbo: Any):
        self.own = isinstance(dbo, str)
        self.connection = sqlite3.connect(dbo) if self.own else dbo() if callable(dbo) and not hasattr(dbo, "cursor") and not hasattr(dbo, "execute") else dbo

    def __enter__(self) -> Any:
        return self.connection

    def __exit__(self, *error: Any) -> None:
        if self.own:
            self.connection.close()


def _cursor(c: Any) -> Any:
    return c.cursor() if hasattr(c, "cursor") else c


def fromdb(dbo: Any, query: str, *args: Any, **kwargs: Any) -> Table:
    """Rows of a query. A ``jdbc:`` address is read by Spark, in partitions with ``column, lowerBound, upperBound, numPartitions``."""
    if _is_jdbc(dbo):
        reader = session().read.format("jdbc").option("url", dbo).option("query" if query.lstrip()[:6].lower() == "select" else "dbtable", query)
        for k, v in kwargs.items():
            reader = reader.option(k, v)
        return Table(reader.load())
    with _Connection(dbo) as c:
        cur = _cursor(c)
        cur.execute(query, *args, **kwargs)
        return from_rows(cur.fetchall(), [d[0] for d in cur.description])


def _quoted(name: str, dialect: str = "sqlite") -> str:
    mark = "`" if dialect == "mysql" else '"'
    return ".".join(mark + part.replace(mark, mark * 2) + mark for part in name.split("."))


def _kind(f: T.StructField, dialect: str, length: int | None) -> str:
    names = DIALECTS[dialect]
    order = (T.BooleanType, T.IntegerType, T.LongType, T.FractionalType, T.StringType, T.BinaryType, T.DateType, (T.TimestampType, T.TimestampNTZType), T.TimeType)
    i = next((i for i, k in enumerate(order) if isinstance(f.dataType, k)), 4)
    i = 1 if isinstance(f.dataType, (T.ByteType, T.ShortType)) else i
    return f"{names[i]}({length})" if i == 4 and length else names[i]


def make_create_table_statement(t: Any, tablename: str, schema: str | None = None, constraints: bool = True, dialect: str | None = None) -> str:
    """``CREATE TABLE`` text for a dialect: types of the schema, text lengths and nullability as found in the rows."""
    from pyspark.sql import functions as F

    from ..core import col

    t, dialect = as_table(t), dialect or "sqlite"
    if dialect not in DIALECTS:
        raise ArgumentError(f"no dialect {dialect!r}")
    texts = [f.name for f in t.df.schema if isinstance(f.dataType, T.StringType)]
    found = t.frame.agg(*[F.max(F.length(col(c))).alias(f"l{i}") for i, c in enumerate(texts)], *[F.bool_or(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(t.columns)]).first() if constraints else None
    lines = []
    for i, f in enumerate(t.df.schema):
        length = found[f"l{texts.index(f.name)}"] if found and f.name in texts else None
        lines.append(f"\t{_quoted(f.name, dialect)} {_kind(f, dialect, length)}" + (" NOT NULL" if found and found[f"n{i}"] is False else ""))
    return f"CREATE TABLE {_quoted(f'{schema}.{tablename}' if schema else tablename, dialect)} (\n" + ",\n".join(lines) + "\n)"


def make_sqlalchemy_column(values: Any, colname: str, constraints: bool = True) -> T.StructField:
    """A column's name, type and nullability from its values."""
    from ..core import spark_type

    values = list(values)
    return T.StructField(colname, spark_type(values), not constraints or None in values)


def make_sqlalchemy_table(t: Any, tablename: str, schema: str | None = None, constraints: bool = True) -> T.StructType:
    """A table's columns; typed by its schema."""
    del tablename, schema, constraints
    return as_table(t).df.schema


def create_table(t: Any, dbo: Any, tablename: str, schema: str | None = None, commit: bool = True, constraints: bool = True, dialect: str | None = None) -> None:
    _run(dbo, make_create_table_statement(t, tablename, schema, constraints, dialect), commit)


def drop_table(dbo: Any, tablename: str, schema: str | None = None, commit: bool = True, if_exists: bool = True) -> None:
    _run(dbo, f"DROP TABLE {'IF EXISTS ' if if_exists else ''}{_quoted(f'{schema}.{tablename}' if schema else tablename)}", commit)


def _run(dbo: Any, statement: str, commit: bool) -> None:
    with _Connection(dbo) as c:
        _cursor(c).execute(statement)
        if commit and hasattr(c, "commit"):
            c.commit()


def _batches(rows: Iterator[Any]) -> Iterator[list[tuple]]:
    out: list[tuple] = []
    for r in rows:
        out.append(tuple(v if isinstance(v, (int, float, str, bytes)) or v is None else str(v) for v in r))
        if len(out) == BATCH:
            yield out
            out = []
    if out:
        yield out


def _insert(t: Any, dbo: Any, tablename: str, schema: str | None, commit: bool, truncate: bool) -> None:
    t = as_table(t)
    if _is_jdbc(dbo):
        t.df.write.option("truncate", True).jdbc(dbo, f"{schema}.{tablename}" if schema else tablename, "overwrite" if truncate else "append")
        return
    name = _quoted(f"{schema}.{tablename}" if schema else tablename)
    with _Connection(dbo) as c:
        cur = _cursor(c)
        if truncate:
            cur.execute(f"DELETE FROM {name}")  # noqa: S608
        marks = ", ".join("?" * len(t.columns))
        for rows in _batches(_in_order(t)):
            cur.executemany(f"INSERT INTO {name} ({', '.join(map(_quoted, t.columns))}) VALUES ({marks})", rows)  # noqa: S608
        if commit and hasattr(c, "commit"):
            c.commit()


@method
def todb(t: Table, dbo: Any, tablename: str, schema: str | None = None, commit: bool = True, create: bool = False, drop: bool = False, constraints: bool = True, dialect: str | None = None) -> None:
    """Replaces a table's rows, in one transaction for a DB-API connection; ``create`` and ``drop`` make it anew."""
    if drop and not _is_jdbc(dbo):
        drop_table(dbo, tablename, schema, commit)
    if create and not _is_jdbc(dbo):
        create_table(t, dbo, tablename, schema, commit, constraints, dialect)
    _insert(t, dbo, tablename, schema, commit, True)


@method
def appenddb(t: Table, dbo: Any, tablename: str, schema: str | None = None, commit: bool = True) -> None:
    _insert(t, dbo, tablename, schema, commit, False)


