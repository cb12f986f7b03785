"""Row operators that look at rows before: on streams, across micro-batches.

With a key, each key's last rows are in Spark's state store, so a restarted query goes on where it was; the rows of a key in one micro-batch are in one task, which sorts
them in runs on its disk and holds a run in memory. Without a key no state can be split, so ``running`` gives each micro-batch to the batch operator, which takes any number of tasks, beside the one row that the micro-batches before
it carry on.

Rows are in the table's order within a micro-batch; a later micro-batch's rows come after. So a stream gives the rows of the batch operator if its micro-batches come in order.
"""

from __future__ import annotations

import heapq
import os
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..core import ORD, Table, as_table, col, fitted
from ..errors import ArgumentError, OrderRequired
from ..functions.expressions import Record
from ..plans.shipping import ship
from ..plans.stored import stored

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bytes of rows, about, that go as one value to the tasks of the state store and back.
PACKED = 1 << 12
#: Rows that are sorted in memory.
RUN = 20_000


def _rank(v: Any) -> Any:
    """A key that sorts null before all else."""
    return tuple(map(_rank, _values(v))) if isinstance(v, (tuple, dict)) else (v is not None, v)


def _values(row: Any) -> Any:
    """The values of a struct, which comes from Arrow as a dict; None stays."""
    return row if row is None else tuple(row.values() if isinstance(row, dict) else row)


def _pickles(rows: Iterable[tuple]) -> Iterator[bytes]:
    """Rows in pickles of about ``PACKED`` bytes."""
    rows, n = iter(rows), 16
    while part := list(islice(rows, n)):
        data = pickle.dumps(part, pickle.HIGHEST_PROTOCOL)
        yield data
        n = max(1, len(part) * PACKED // len(data))


def _in_order(rows: Iterable[tuple], most: int = RUN) -> Iterator[tuple]:
    """Rows by their order, which comes last in each; if they are more than ``most``, in runs on the task's disk, merged."""

    def at(r: tuple) -> Any:
        return _rank(r[-1])

    rows = iter(rows)
    run = sorted(islice(rows, most), key=at)
    if len(run) < most:
        yield from run
        return
    local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    with tempfile.TemporaryFile(dir=local if os.path.isdir(local) else None) as f:

        def read(spans: list[tuple[int, int]]) -> Iterator[tuple]:
            for where, size in spans:
                f.seek(where)
                yield from pickle.loads(f.read(size))  # noqa: S301 (this task's own)

        runs = []
        while run:
            runs.append([(f.tell(), f.write(data)) for data in _pickles(run)])
            run = sorted(islice(rows, most), key=at)
        yield from heapq.merge(*map(read, runs), key=at)


def _same(v: Any) -> Any:
    """A key's value with one form of zero."""
    return tuple(map(_same, _values(v))) if isinstance(v, (tuple, dict)) else v + 0.0 if isinstance(v, float) else v


def _packed(places: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows as pickles of some of a key's rows, each beside the key as text: exact for all types, and few for the state store's task to read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[tuple]] = {}
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault(repr(tuple(_same(r[p]) for p in places)), []).append(r)
            each = [(k, data) for k, rows in found.items() for data in _pickles(rows)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in each], pa.string()), pa.array([d for _, d in each], pa.binary())], ["key", "rows"])

    return run


def _unpacked(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("rows"):
                columns = zip(*pickle.loads(data.as_py()), strict=True)  # noqa: S301 (of this query's own tasks)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


class _Processor(StatefulProcessor):
    """A key's rows in order, with what ``step`` keeps of the rows before. Rows come and go in pickles, none of which waits for the others."""

    def __init__(self, state: T.StructType, fields: list[str]):
        self.state, self.row = state, Row(*(f"c{i}" for i in range(len(fields))))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", self.state)

    def _stepped(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        kept = tuple(self.kept.get()) if self.kept.exists() else (None,) * len(self.state)
        for r in _in_order(rows):
            kept, out = self.step(kept, r)
            for x in out:
                yield tuple(self.row(*x).asDict(True).values())
        self.kept.update(kept)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = (r for part in rows for data in part["rows"] for r in pickle.loads(data))  # noqa: S301 (of this query's own tasks)
        for data in _pickles(self._stepped(found)):
            yield pd.DataFrame({"rows": [data]})

    def close(self) -> None:
        pass


class _Filled(_Processor):
    def __init__(self, places: list[int], missing: Any, state: T.StructType, fields: list[str]):
        super().__init__(state, fields)
        self.places, self.missing = places, missing

    def step(self, kept: tuple, r: tuple) -> tuple[tuple, list[tuple]]:
        last, out = list(kept), list(r)
        for i, p in enumerate(self.places):
            if r[p] is None or r[p] == self.missing:
                out[p] = last[i] if last[i] is not None else r[p]
            else:
                last[i] = r[p]
        return tuple(last), [tuple(out)]


class _Context(_Processor):
    """Keeps the row before (with its result, if that is asked for) and, where the query sees the next row, the one that waits for it."""

    def __init__(self, query: Callable, names: tuple[str, ...], field: str | None, to: T.DataType, recurrent: bool, ahead: bool, state: T.StructType, fields: list[str]):
        super().__init__(state, fields)
        self.query, self.names, self.field, self.to, self.recurrent, self.ahead = query, names, field, to, recurrent, ahead

    def step(self, kept: tuple, r: tuple) -> tuple[tuple, list[tuple]]:
        before, value, held = _values(kept[0]), kept[1], _values(kept[2])
        if self.ahead and held is None:
            return (before, value, r), []
        here, after = (held, r) if self.ahead else (r, None)
        width = len(self.names)
        earlier = None if before is None else Record((*before[:width], value), (*self.names, self.field)) if self.recurrent else Record(tuple(before[:width]), self.names)
        found = fitted(self.query(earlier, Record(tuple(here[:width]), self.names), None if after is None else Record(after[:width], self.names)), self.to)
        out = [(*here[:width], found, here[width])] if self.field is not None else [tuple(here)] if found else []
        return (tuple(here), found, after), out


def _checked(t: Table, keys: list[str]) -> None:
    if not keys:
        raise ArgumentError("on a stream give a key, or use running()")
    if not t.has_order:
        raise OrderRequired("a stream's rows need a declared order")


def _keyed(t: Table, keys: list[str], processor: _Processor, schema: T.StructType) -> Table:
    spark = t.frame.sparkSession
    ship(spark)
    if "RocksDB" not in (spark.conf.get(PROVIDER, "") or ""):
        spark.conf.set(PROVIDER, ROCKS)  # the only store that this kind of state has
    held = t.frame.mapInArrow(_packed([t.frame.columns.index(k) for k in keys]), "key string, rows binary").groupBy("key").transformWithStateInPandas(processor, "rows binary", "Append", "None")
    return Table(held.mapInArrow(_unpacked(to_arrow_schema(schema)), schema))


def _loose(s: T.StructType) -> T.StructType:
    """A schema whose fields may be null."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in s.fields])


def filled(t: Table, names: list[str], missing: Any, keys: list[str]) -> Table:
    """``filldown`` by a key."""
    _checked(t, keys)
    schema = _loose(t.frame.schema)
    schema = T.StructType([*[f for f in schema if f.name != ORD], schema[ORD]])
    state = T.StructType([T.StructField(f"c{i}", schema[n].dataType) for i, n in enumerate(names)])
    places = [t.columns.index(n) for n in names]
    return _keyed(Table(t.frame.select(*map(col, schema.names))), keys, _Filled(places, missing, state, schema.names), schema)


def with_context(t: Table, keys: list[str], query: Callable, field: str | None, returns: str, recurrent: bool = False, ahead: bool = True) -> Table:
    """``addfieldusingcontext``, or ``selectusingcontext`` without ``field``, by a key. With ``ahead`` a key's last row waits for its successor."""
    _checked(t, keys)
    names, to = tuple(t.columns), T._parse_datatype_string(returns)
    whole = T.StructType([*[f for f in _loose(t.frame.schema) if f.name != ORD], T.StructField(ORD, t.frame.schema[ORD].dataType)])
    schema = whole if field is None else T.StructType([*whole.fields[:-1], T.StructField(field, to), whole[ORD]])
    state = T.StructType([T.StructField("before", whole), T.StructField("value", to), T.StructField("held", whole)])
    return _keyed(Table(t.frame.select(*map(col, whole.names))), keys, _Context(query, names, field, to, recurrent, ahead, state, schema.names), schema)


# --- without a key --------------------------------------------------------------------------------------------------


def _filldown(batch: Table, carried: DataFrame | None, *fields: Any, missing: Any = None) -> tuple[DataFrame, DataFrame]:
    """A micro-batch filled after the row before it, and its last row."""
    from ..operators.sorts import filldown

    names, order = batch.columns, batch.frame.schema[ORD].dataType
    mine = batch.frame.select(*map(col, names), F.struct(F.lit(True).alias("mine"), F.col(ORD).alias("o")).alias(ORD))
    if carried is not None:
        mine = carried.select(*map(col, names), F.struct(F.lit(False).alias("mine"), F.lit(None).cast(order).alias("o")).alias(ORD)).union(mine)
    out = stored(filldown(Table(mine), *fields, missing=missing).frame)
    last = out.agg(F.max_by(F.struct(*map(col, names)), ORD).alias("r")).where("r IS NOT NULL").select("r.*")
    return out.where(f"{ORD}.mine").select(*map(col, names)), last


def _addrownumbers(batch: Table, carried: DataFrame | None, start: int = 1, step: int = 1, field: str = "row") -> tuple[DataFrame, DataFrame]:
    """A micro-batch numbered after the rows before it, and how many rows there are by then."""
    from ..operators.columns import addrownumbers

    before = carried.first()[0] if carried is not None else 0
    out = stored(addrownumbers(batch, start + before * step, step, field).frame)
    return Table(out).df, out.agg((F.count(F.lit(1)) + before).alias("rows"))


STEPS = {"filldown": _filldown, "addrownumbers": _addrownumbers}


def running(t: Any, operator: str, target: str, checkpoint: str, *args: Any, available_now: bool = False, **kwargs: Any) -> StreamingQuery:
    """A query that writes ``filldown`` or ``addrownumbers`` of a whole stream as Parquet to ``target``, a folder ``batch=k`` for each micro-batch.

    What micro-batch ``k`` carries on, one row, is in ``checkpoint``. A micro-batch that is run again, after a failure or a restart, reads the same carried row and
    overwrites its own folders, so no row is lost or written twice.
    """
    t = as_table(t)
    if operator not in STEPS:
        raise ArgumentError(f"{operator!r} is none of {sorted(STEPS)}")
    if not t.has_order:
        raise OrderRequired("a stream's rows need a declared order")
    ship(t.frame.sparkSession)

    def each(frame: DataFrame, k: int) -> None:
        carried = frame.sparkSession.read.parquet(f"{checkpoint}/carried/batch={k - 1}") if k else None
        rows, last = STEPS[operator](Table(frame), carried, *args, **kwargs)
        rows.write.mode("overwrite").parquet(f"{target}/batch={k}")
        last.write.mode("overwrite").parquet(f"{checkpoint}/carried/batch={k}")

    writer = t.frame.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/query")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
