"""Streams: the row-wise operators work on streaming tables as they are; windowed counts and sessions are here."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Table, as_table, col, resolve, resolve_all


def _aggregated(t: Any, time: str, key: Any, window: Column, aggs: dict[str, Column], watermark: str | None) -> Table:
    t = as_table(t)
    df: DataFrame = t.df.withWatermark(resolve(t, time), watermark) if watermark and t.df.isStreaming else t.df
    out = df.groupBy(window.alias("w"), *map(col, resolve_all(t, key) if key is not None else [])).agg(*[c.alias(n) for n, c in aggs.items()])
    return Table(out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *[c for c in out.columns if c != "w"]))


def windowed(t: Any, time: str, size: str, aggs: dict[str, Column], key: Any = None, slide: str | None = None, watermark: str | None = None) -> Table:
    """Tumbling or sliding windows; with a watermark, late rows are bounded on a stream."""
    return _aggregated(t, time, key, F.window(col(time), size, slide) if slide else F.window(col(time), size), aggs, watermark)


def sessions(t: Any, time: str, gap: str, aggs: dict[str, Column], key: Any = None, watermark: str | None = None) -> Table:
    """Runs of rows of a key without a gap as long as ``gap``."""
    return _aggregated(t, time, key, F.session_window(col(time), gap), aggs, watermark)
