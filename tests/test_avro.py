"""Avro: round trips of all types, splits, markers, schemas and damage."""

import datetime
import decimal
import json
import os

import pytest
from pyspark.sql import functions as F

import loomtab as lt
from loomtab import Table
from loomtab.errors import ArgumentError
from loomtab.sources import avro

ALL = """SELECT id, id % 2 = 0 AS flag, CAST(id AS int) - 50 AS small, id * 123456789012 AS large, CAST(id AS float) / 3 AS f, id / 7 AS d, CASE WHEN id % 3 > 0 THEN concat('é', id) END AS text,
CAST(concat('b', id) AS binary) AS raw, CAST(-id AS decimal(20, 4)) / 8 AS money, date_add(date'1960-01-01', CAST(id AS int) * 100) AS day, timestamp_micros(id * 1234567890123 - 7) AS at,
CAST(timestamp'1950-01-01 01:02:03.000004' AS timestamp_ntz) + make_dt_interval(CAST(id AS int)) AS local, CAST('10:11:12.000013' AS time(6)) AS t, array(id, NULL, -id) AS list,
map('a', id, 'b', NULL) AS m, named_struct('x', id, 'y', array(named_struct('z', 'q'))) AS s, CAST(NULL AS int) AS nothing FROM range(100)"""


def values(t):
    return sorted(map(repr, t.df.collect()))


@pytest.mark.parametrize("codec", avro.CODECS)
def test_all_types_and_codecs_round(spark, tmp_path, codec):
    spark.conf.set("spark.sql.timeType.enabled", True)
    t = Table(spark.sql(ALL), "id")
    folder, file = f"{tmp_path}/folder", f"{tmp_path}/x.avro"
    lt.toavro(t, folder, codec=codec, directory=True)
    lt.toavro(t, file, codec=codec)
    for path in (folder, file):
        back = lt.fromavro(path)
        assert back.df.dtypes == t.df.dtypes
        assert values(back) == values(t)
    assert [r[0] for r in list(lt.fromavro(file))[1:]] == list(range(100))
    assert [r[0] for r in list(lt.fromavro(file, limit=3, skips=10))[1:]] == [10, 11, 12]


def test_a_file_is_read_in_many_tasks_with_all_its_rows(spark, tmp_path):
    t = Table(spark.range(0, 400_000, 1, 3).select("id", F.md5(F.col("id").cast("string")).alias("v")))
    lt.toavro(t, f"{tmp_path}/x.avro", codec="null")
    size = os.path.getsize(f"{tmp_path}/x.avro")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size // 20)
    try:
        back = lt.fromavro(f"{tmp_path}/x.avro")
        assert back.df.rdd.getNumPartitions() >= 18
        got = back.df.agg(F.count("*"), F.sum("id"), F.countDistinct("id"), F.sum((F.md5(F.col("id").cast("string")) == F.col("v")).cast("int"))).first()
        assert tuple(got) == (400_000, 399_999 * 200_000, 400_000, 400_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    ids = [r[0] for r in list(lt.cut(lt.fromavro(f"{tmp_path}/x.avro"), "id"))[1:]]
    assert ids == sorted(ids)


def test_empty_tables_keep_their_fields(spark, tmp_path):
    t = Table(spark.createDataFrame([], "a int, b string"))
    lt.toavro(t, f"{tmp_path}/folder", directory=True)
    lt.toavro(t, f"{tmp_path}/x.avro")
    for path in (f"{tmp_path}/folder", f"{tmp_path}/x.avro"):
        assert lt.fromavro(path).df.dtypes == [("a", "int"), ("b", "string")] and len(lt.fromavro(path)) == 0


def test_appends_share_schema_codec_and_marker(spark, tmp_path):
    a, b = [["k", "v"], [1, "x"]], [["k", "v"], [2, None]]
    for directory in (True, False):
        path = f"{tmp_path}/{directory}"
        lt.appendavro(a, path, directory=directory)
        lt.appendavro(b, path, directory=directory)
        assert sorted(map(tuple, lt.fromavro(path).df.collect())) == [(1, "x"), (2, None)]
        with pytest.raises(ArgumentError):
            lt.appendavro([["k"], [1]], path, directory=directory)
        assert len(lt.fromavro(path)) == 2


def file_of(schema, values, codec="null", marker=b"m" * 16, blocks=1):
    """A container made by hand."""
    named = avro.Named(schema)
    write = avro.encoder(named, schema)
    out = bytearray(avro.header(schema, codec) + marker)
    for _ in range(blocks):
        data = bytearray()
        for v in values:
            write(v, data)
        data = avro.packed(codec, bytes(data), None)
        avro.write_long(len(values), out)
        avro.write_long(len(data), out)
        out += data + marker
    return bytes(out)


OTHER = {
    "type": "record", "name": "r", "namespace": "n.s", "fields": [
        {"name": "color", "type": {"type": "enum", "name": "color", "symbols": ["RED", "GREEN"]}},
        {"name": "again", "type": ["null", "n.s.color"]},
        {"name": "code", "type": {"type": "fixed", "name": "code", "size": 3}},
        {"name": "amount", "type": {"type": "fixed", "name": "amount", "size": 6, "logicalType": "decimal", "precision": 12, "scale": 3}},
        {"name": "millis", "type": {"type": "long", "logicalType": "timestamp-millis"}},
        {"name": "hour", "type": {"type": "int", "logicalType": "time-millis"}},
        {"name": "wide", "type": ["int", "null", "long"]},
        {"name": "unlike", "type": ["null", "string", "long", {"type": "array", "items": "int"}]},
    ],
}
ROW = {"color": "GREEN", "again": "RED", "code": b"abc", "amount": decimal.Decimal("-12.345"), "millis": datetime.datetime(2020, 1, 2, 3, 4, 5, 678000), "hour": datetime.time(1, 2, 3), "wide": 1 << 40, "unlike": "7"}


def test_named_fixed_and_union_types(spark, tmp_path):
    rows = [ROW, ROW | {"again": None, "unlike": 7, "wide": None}, ROW | {"unlike": [1, 2]}, ROW | {"unlike": None, "wide": 3}]
    (tmp_path / "x.avro").write_bytes(file_of(OTHER, rows))
    t = lt.fromavro(f"{tmp_path}/x.avro")
    got = [dict(zip(t.columns, r, strict=True)) for r in list(t)[1:]]
    assert [r["unlike"] for r in got] == ["7", 7, [1, 2], None] and [r["wide"] for r in got] == [1 << 40, None, 1 << 40, 3] and [r["again"] for r in got] == ["RED", None, "RED", "RED"]
    assert (got[0]["color"], bytes(got[0]["code"]), got[0]["amount"], got[0]["hour"]) == ("GREEN", b"abc", decimal.Decimal("-12.345"), datetime.time(1, 2, 3))
    assert t.df.selectExpr("unix_millis(millis)").first()[0] == 1577934245678


def test_a_given_schema_takes_what_it_has_a_place_for(spark, tmp_path):
    schema = {"type": "record", "name": "r", "fields": [{"name": "a", "type": ["null", "int", "string"]}, {"name": "b", "type": ["null", "double"], "default": None}]}
    lt.toavro([["a"], [5]], f"{tmp_path}/x", schema=json.dumps(schema))
    assert list(lt.fromavro(f"{tmp_path}/x"))[1:] == [(5, None)]
    with pytest.raises(Exception, match="fits no member"):
        lt.toavro([["a"], [1 << 40]], f"{tmp_path}/y", schema=schema)
    with pytest.raises(ArgumentError):
        lt.toavro([["a b"], [1]], f"{tmp_path}/z")


def test_files_of_other_markers_and_schemas_are_united(spark, tmp_path):
    one = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "int"}]}
    two = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": "string"}]}
    for i in range(6):
        (tmp_path / f"{i}.avro").write_bytes(file_of(one, [{"a": i}], "deflate", bytes([i, 10, 13, 255]) * 4, blocks=2))
    (tmp_path / "6.avro").write_bytes(file_of(two, [{"a": 1 << 40, "b": "x"}], "snappy"))
    (tmp_path / "7.avro").write_bytes(b"")
    got = sorted(map(tuple, lt.fromavro(str(tmp_path)).df.collect()))
    assert got == sorted([(i, None) for i in range(6)] * 2 + [(1 << 40, "x")])
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20)  # every file is over a split, and each block may be
    try:
        assert sorted(map(tuple, lt.fromavro(str(tmp_path)).df.collect())) == got
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_byte_sources_and_arrays_in_runs_with_sizes(spark):
    schema = {"type": "record", "name": "r", "fields": [{"name": "a", "type": {"type": "array", "items": "int"}}]}
    data = bytes([3, 4, 2, 4, 2, 6, 0])  # a run of two in two bytes, and a run of one
    out = avro.header(schema, "null") + b"s" * 16 + bytes([2, len(data) * 2]) + data + b"s" * 16
    assert list(lt.fromavro(lt.MemorySource(out)))[1:] == [([1, 2, 3],)]


def test_damage_raises(spark, tmp_path):
    schema = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "string"}]}
    good = file_of(schema, [{"a": "hello"}] * 3, "deflate", blocks=2)
    for name, bad in {"short": good[:-20], "flipped": good[:-24] + b"\xff\xff" + good[-22:]}.items():
        (tmp_path / name).write_bytes(bad)
        with pytest.raises(Exception):  # noqa: B017
            lt.fromavro(f"{tmp_path}/{name}").df.collect()
    (tmp_path / "none").write_bytes(b"no container at all")
    with pytest.raises(ArgumentError):
        lt.fromavro(f"{tmp_path}/none")
    deep = {"type": "record", "name": "node", "fields": [{"name": "next", "type": ["null", "node"]}]}
    (tmp_path / "deep").write_bytes(avro.header(deep, "null") + b"m" * 16 + b"\2\2\0" + b"m" * 16)
    with pytest.raises(ArgumentError, match="contains itself"):
        lt.fromavro(f"{tmp_path}/deep")


def test_members_of_unions_are_found_by_type_where_that_tells_them(monkeypatch):
    """Writing a row tries no member after another, and chooses those that trying chooses."""
    unions = [["null", "int", "long", "double"], ["null", "long", "int"], ["string", {"type": "enum", "name": "e", "symbols": ["a"]}], [{"type": "enum", "name": "e", "symbols": ["a"]}, "string", "bytes"], ["boolean", "float", {"type": "long", "logicalType": "timestamp-micros"}, {"type": "int", "logicalType": "date"}], ["null", {"type": "array", "items": "int"}, {"type": "map", "values": "int"}]]
    values = [None, True, 0, -5, 2**31 - 1, 2**31, -(2**31) - 1, 1 << 60, 0.5, "a", "b", b"x", datetime.datetime(1950, 1, 2, 3, 4, 5, 6), datetime.date(2020, 1, 1), [1], {"k": 1}]
    for d in unions:
        named = avro.Named(d)
        write, read = avro.encoder(named, d), avro.decoder(named, d)
        for v in values:
            tried = next((i for i, m in enumerate(d) if avro._fits(named, m, v)), None)
            if tried is None:
                with pytest.raises(ValueError, match="fits no member"):
                    write(v, bytearray())
                continue
            out = bytearray()
            write(v, out)
            assert avro.read_long(bytes(out), 0)[0] == tried
            assert read(bytes(out), 0)[1] == len(out)
    fields = [{"name": n, "type": ["null", m]} for n, m in (("a", "long"), ("b", "int"), ("c", "double"), ("d", "string"), ("e", {"type": "long", "logicalType": "local-timestamp-micros"}))]
    named = avro.Named({"type": "record", "name": "r", "fields": fields})
    write = avro.encoder(named, named.schema)
    monkeypatch.setattr(avro, "_fits", None)
    write({"a": 7, "b": -7, "c": 0.5, "d": "x", "e": avro.EPOCH}, out := bytearray())
    assert avro.decoder(named, named.schema)(bytes(out), 0) == ({"a": 7, "b": -7, "c": 0.5, "d": "x", "e": 0}, len(out))
