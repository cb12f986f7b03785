"""Comparison of tables with literal rows, and of queries with DuckDB."""

import glob
import os

import duckdb

from loomtab import Table

SF = "/root/testdata/sf0.001"


def rows(t: Table, ordered: bool = False) -> list[tuple]:
    out = [tuple(r) for r in (list(t)[1:] if ordered else t.df.collect())]
    return out if ordered else sorted(out, key=repr)


def same(t: Table, expected: list[tuple], ordered: bool = False) -> None:
    """``expected``: the header, then the rows."""
    header, *data = expected
    assert tuple(t.columns) == tuple(header)
    assert rows(t, ordered) == (data if ordered else sorted(data, key=repr))


def normal(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    return v


def duck(sql: str, folder: str = SF) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    out = con.sql(sql)
    return out.columns, out.fetchall()


def matches(df, sql: str, folder: str = SF) -> None:
    names = sorted(df.columns)
    columns, expected = duck(sql, folder)
    assert sorted(columns) == names
    got = sorted((tuple(normal(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(normal(r[columns.index(c)]) for c in names) for r in expected), key=repr)
