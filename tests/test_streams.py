"""Stateful row operators on streams: five micro-batches, and a restart between them, give what the batch operators give."""

import datetime
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import types as T

import loomtab as lt
from loomtab import Table
from loomtab.errors import ArgumentError, OrderRequired
from loomtab.streaming import stateful
from loomtab.streaming.stateful import running

ROWS = [(i, "abc"[i * i % 3 % 3] if i % 11 else "hot", (1 << 60) + i if i % 4 == 0 else None, f"v{i}" if i % 3 == 0 else ("" if i % 3 == 1 else None)) for i in range(100)]
SCHEMA = "id long, k string, n long, s string"


def put(spark, folder, part):
    time.sleep(0.05)  # files are read by the time of their making
    spark.createDataFrame(ROWS[part * 20 : part * 20 + 20], SCHEMA).repartition(3).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return Table(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), "id")


def streamed(spark, tmp_path, of):
    """The result of a query that was stopped after two of five micro-batches and started again."""
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    for parts in ((0, 1), (2, 3, 4)):
        for p in parts:
            put(spark, source, p)
        out = of(stream(spark, source)).df
        q = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert q.awaitTermination(180)
    assert q.lastProgress["batchId"] >= 4
    return sorted(map(tuple, spark.read.parquet(target).collect()))


def batch(spark):
    return Table(spark.createDataFrame(ROWS, SCHEMA), "id")


def test_filldown_by_key(spark, tmp_path):
    got = streamed(spark, tmp_path, lambda t: lt.filldown(t, "n", "s", by="k"))
    assert got == sorted(map(tuple, lt.filldown(batch(spark), "n", "s", by="k").df.collect()))


def test_context_that_looks_back_only(spark, tmp_path):
    query = lambda p, c, n: (p["total"] if p else 0) + c["id"]
    got = streamed(spark, tmp_path, lambda t: lt.addfieldusingcontext(t, "total", query, by="k", recurrent=True, returns="long", ahead=False))
    assert got == sorted(map(tuple, lt.addfieldusingcontext(batch(spark), "total", query, by="k", recurrent=True, returns="long").df.collect()))


def test_context_with_the_next_row(spark, tmp_path):
    query = lambda p, c, n: p is not None and n is not None and n["id"] - p["id"] > 5
    got = streamed(spark, tmp_path, lambda t: lt.selectusingcontext(t, query, by="k"))
    last = {k: i for i, k, *_ in ROWS}
    expected = lt.selectusingcontext(batch(spark), query, by="k").df.collect()
    assert got == sorted(tuple(r) for r in expected if last[r.k] != r.id) and got


@pytest.mark.parametrize(("operator", "args", "kwargs"), [("filldown", ("n", "s"), {"missing": None}), ("addrownumbers", (), {"start": 5, "step": 2})])
def test_whole_streams_without_a_key(spark, tmp_path, operator, args, kwargs):
    for parts in ((0, 1), (2, 3, 4)):
        for p in parts:
            put(spark, f"{tmp_path}/in", p)
        q = running(stream(spark, f"{tmp_path}/in"), operator, f"{tmp_path}/out", f"{tmp_path}/state", *args, available_now=True, **kwargs)
        assert q.awaitTermination(180)
    expected = getattr(lt, operator)(batch(spark), *args, **kwargs)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert {r.batch for r in got.select("batch").distinct().collect()} == set(range(5))
    assert sorted(map(tuple, got.select(*expected.columns).collect())) == sorted(map(tuple, expected.df.collect()))


def test_streams_need_an_order_and_a_key(spark, tmp_path):
    put(spark, f"{tmp_path}/in", 0)
    t = stream(spark, f"{tmp_path}/in")
    with pytest.raises(ArgumentError):
        lt.filldown(t, "n")
    with pytest.raises(OrderRequired):
        lt.filldown(Table(t.df), "n", by="k")
    with pytest.raises(ArgumentError):
        running(t, "sort", "x", "y")


class Kept:
    """A state without a store."""

    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_key_of_many_rows_takes_little_memory():
    """100,000 rows of one key in one micro-batch, in no order: sorted in runs, and given out piece by piece."""
    n = 100_000
    wide = pa.schema([("id", pa.int64()), ("k", pa.string()), ("n", pa.int64()), ("o", pa.struct([("id", pa.int64())]))])

    def batches():
        for at in range(0, n, 10_000):
            ids = [(i * 7919) % n for i in range(at, at + 10_000)]
            yield pa.RecordBatch.from_pylist([{"id": i, "k": "hot", "n": (1 << 60) + i if i % 4 == 0 else None, "o": {"id": i}} for i in ids], wide)

    p = stateful._Filled([2], None, T.StructType([T.StructField("c0", T.LongType())]), wide.names)
    p.kept = Kept()
    tracemalloc.start()
    packed = (b.to_pandas() for b in stateful._packed([1])(batches()))
    seen = 0
    for part in p.handleInputRows(("hot",), packed, None):
        for b in stateful._unpacked(wide)([pa.RecordBatch.from_pandas(part)]):
            for r in b.to_pylist():
                assert r == {"id": seen, "k": "hot", "n": (1 << 60) + seen // 4 * 4, "o": {"id": seen}}
                seen += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and p.kept.get() == ((1 << 60) + n - 4,)
    assert peak < 50e6


def test_keys_of_all_types_are_told_apart(spark, tmp_path):
    """Keys of several fields, nulls, zeros of both signs, times by the microsecond and long integers."""
    schema = "id long, a long, b double, t timestamp, s string, n long"
    data = [(i, [None, 1 << 60, (1 << 60) + 1][i % 3], [0.0, -0.0, float("nan"), None][i % 4], datetime.datetime(2020, 1, 1, microsecond=i % 2), [None, "None", "', '"][i % 5 % 3], i if i % 3 else None) for i in range(200)]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = lt.filldown(Table(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "id"), "n", by=("a", "b", "t", "s")).df
    got.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(180)
    expected = lt.filldown(Table(spark.createDataFrame(data, schema), "id"), "n", by=("a", "b", "t", "s")).df
    assert sorted(map(repr, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(repr, expected.collect()))
