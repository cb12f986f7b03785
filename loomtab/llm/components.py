"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of ``u`` goes to the smallest vertex in reach of ``u``; a written table.

    The smallest vertices are a table first: a join of two plain exchanges is one that adaptive execution splits at a hub.
    """
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "star")
    out = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "links")
    released(least)
    return out


def _small_star(links: DataFrame) -> DataFrame:
    """Each smaller neighbour of ``u``, and ``u``, go to the smallest of them; a written table. Links lead from larger to smaller here."""
    least = written(links.groupBy("u").agg(F.min("v").alias("m")), "star")
    found = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = written(found.where("u <> v").distinct(), "links")
    released(least)
    return out


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """``vertex, component`` (its smallest vertex) for the vertices of ``links (u, v)``; both longs without nulls.

    Each round is written to the shared folder; it ends when a round changes nothing, after about log n rounds.
    Empty links give an empty table.
    """
    links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    state = _state(links)
    while state[0]:
        large, old = _large_star(links), links
        links = _small_star(large)
        released(large, old)
        before, state = state, _state(links)
        if state == before:
            break
    ends = links.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return ends.union(links.select(F.col("v").alias("vertex"), F.col("v").alias("component"))).distinct()
