"""Delimited text whose values may hold line breaks, read in as many tasks as its size asks for.

A split of a file can't know whether it begins inside a quoted value. So each split is scanned twice in one pass: as if it began at a record, and as if inside a quoted
value; it gives the state in which it would end in either case. The splits' answers, a row each, are combined in order: that tells the state in which each begins. In a second
pass each split gives the records that lie in it, parsed, and as text what belongs to a record that began before it or that goes on after it; these pieces, two
for a split at most, are put together and parsed in turn. So the result is that of one parser over the whole file.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from itertools import pairwise
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shipping import ship

Place = tuple[str, int]


def opener(delimiter: str, quote: str) -> re.Pattern:
    """A quote that begins a value: at a record's begin or after a delimiter."""
    return re.compile(f"(?:^|[{re.escape(delimiter)}\r]){re.escape(quote)}")


def ends_quoted(line: str, quoted: bool, begin: re.Pattern, quote: str) -> bool:
    """Whether the end of a line is inside a quoted value, if its begin is (``quoted``) or is that of a record.

    Inside a quoted value two quotes are one character, and a single one ends it; elsewhere in a value a quote is a character.
    """
    at = 0
    while quote in line:
        if not quoted:
            found = begin.search(line, at)
            if not found:
                return False
            at = found.end()
        close = line.find(quote, at)
        if close < 0:
            return True
        quoted = line.startswith(quote, close + 1)
        at = close + 1 + quoted
    return quoted


def lines(spark: SparkSession, path: Any) -> DataFrame:
    """``file, start, line``: the lines of files, in order within each split, which begins at ``start``."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Place, list[str]]]:
    """Lines with their split, those of a batch together."""
    for b in batches:
        files, starts, values = b["file"], b["start"].to_pylist(), b["line"].to_pylist()
        changes = [0, *[i for i, (x, y) in enumerate(pairwise(zip(files.to_pylist(), starts, strict=True)), 1) if x != y], len(values)]
        for i, j in pairwise(changes):
            if j > i:
                yield (files[i].as_py(), starts[i]), values[i:j]


def _ends(delimiter: str, quote: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[Place, tuple[bool, bool]] = {}
        begin = opener(delimiter, quote)
        for place, part in _runs(batches):
            plain, inside = states.get(place, (False, True))
            for x in part:
                if quote in x:
                    plain, inside = ends_quoted(x, plain, begin, quote), ends_quoted(x, inside, begin, quote)
            states[place] = plain, inside
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        rows = [(*p, *s) for p, s in states.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "start", "plain", "inside"])

    return run


def begins(spark: SparkSession, path: Any, delimiter: str, quote: str) -> dict[Place, bool]:
    """The splits that begin inside a quoted value; a row for each split comes to the driver."""
    found = lines(spark, path).mapInArrow(_ends(delimiter, quote), "file string, start long, plain boolean, inside boolean")
    out: dict[Place, bool] = {}
    last, state = None, False
    for r in found.groupBy("file", "start").agg(F.any_value("plain").alias("plain"), F.any_value("inside").alias("inside")).orderBy("file", "start").toLocalIterator():
        if r.file != last:
            last, state = r.file, False
        out[r.file, r.start] = state
        state = r.inside if state else r.plain
    return out


def _parsed(text: str, csvargs: dict[str, Any]) -> list[list[str]]:
    return list(csv.reader(io.StringIO(text, newline=""), **csvargs))


#: Lines of records that are parsed at once.
TOGETHER = 2000


def _records(quoted: Any, delimiter: str, quote: str, csvargs: dict[str, Any]):
    """``file, start, seq, values, piece, opens``: records, and pieces of records (``opens``: the piece begins one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: Place | None = None
        begin = opener(delimiter, quote)
        state = head = False  # inside a quoted value; and in the piece of a record that began before the split
        open_: list[str] = []
        whole: list[str] = []
        seq = 0
        out: list[tuple] = []

        def flush() -> None:
            nonlocal seq, whole
            if whole:
                for v in _parsed("".join(whole), csvargs):
                    out.append((*place, seq, v, None, None))
                    seq += 1
                whole = []

        def leave() -> None:
            nonlocal open_
            flush()
            if open_:
                out.append((*place, -1 if head else 1 << 60, None, "".join(open_), not head))
                open_ = []

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_())
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "start", "seq", "values", "piece", "opens"])

        for here, part in _runs(batches):
            if here != place:
                leave()
                place, seq = here, 0
                state = head = quoted.value[here]
            for x in part:
                was, state = state, ends_quoted(x, state, begin, quote)
                if was or state:
                    open_.append(x + "\n")
                    if not state:
                        if head:
                            leave()
                            head = False
                        else:
                            whole += open_
                            open_ = []
                else:
                    whole.append(x + "\n")
                if len(whole) >= TOGETHER:
                    flush()
            if out:
                yield batch()
        if place is not None:
            leave()
            yield batch()

    return run


def _joined(csvargs: dict[str, Any]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [next(iter(_parsed(t, csvargs)), []) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["file"], b["start"], b["seq"], pa.array(values, pa.list_(pa.string()))], ["file", "start", "seq", "values"])

    return run


def read_records(path: Any, delimiter: str = ",", quotechar: str = '"', **csvargs: Any) -> DataFrame:
    """``file, start, seq, values`` of each record: values as they are, and the record's place (file, split, number in it). Empty lines are no records."""
    from ..core import session

    spark = session()
    ship(spark)
    args = {"delimiter": delimiter, "quotechar": quotechar} | csvargs
    quoted = spark.sparkContext.broadcast(begins(spark, path, delimiter, quotechar))  # a boolean for each split
    found = lines(spark, path).mapInArrow(_records(quoted, delimiter, quotechar, args), "file string, start long, seq long, values array<string>, piece string, opens boolean")
    whole = found.where("piece IS NULL").select("file", "start", "seq", "values")
    pieces = found.where("piece IS NOT NULL")
    order = Window.partitionBy("file").orderBy("start", "seq")  # two rows for a split
    numbered = pieces.withColumn("record", F.sum(F.col("opens").cast("int")).over(order))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "seq", "piece"))), lambda x: x["piece"]), "")
    joined = numbered.groupBy("file", "record").agg(text.alias("text"), F.min_by("start", F.struct("start", "seq")).alias("start"), F.min_by("seq", F.struct("start", "seq")).alias("seq"))
    broken = joined.select("file", "start", "seq", "text").mapInArrow(_joined(args), "file string, start long, seq long, values array<string>")
    return whole.union(broken).where(F.size("values") > 0)
