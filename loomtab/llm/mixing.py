"""Mixing sources to target weights over a curriculum that changes with training time.

Each source has a weight schedule over training time 0..1, given as knots of a piecewise linear weight. Its integral,
scaled to the source's target, is the cumulative demand for the source's words by a time. A source's documents stand in a
fixed random order (MD5 of ``doc_id`` and text) and repeat in epochs; a copy that begins at word ``p`` of that stream is due when the
demand reaches ``p``, so its training position is the inverse of the demand at ``p``. Copies for which demand is over before
they begin have no position and are not taken. A range sort by position gives the training order.

Prefix sums are two-level: documents fall into buckets by the leading digits of the MD5, bucket totals are summed up
per source, and a window within each (source, bucket) does the rest, so a source with a third of all rows is spread over
many tasks. Per source, one row goes to the driver.

Results: null text has size 0 and is never taken; a null source is a source of its own, last in order; null
``doc_id`` orders as an empty string, its rows by their texts; repeated rows are separate documents, alike to the order; empty
input gives empty output.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, written

WORD = r"[^\x20\x09-\x0D]+"

#: Weight knots (time, weight), repeating over the sources in order: rising, falling and level.
DEFAULT_SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)))

Knots = Sequence[tuple[float, float]]


def water_fill(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Targets in proportion to ``weights`` with a sum of ``share`` times all sizes, none above ``cap`` times its size.

    The level at which weights turn to targets is found where the capped ones, in order of size by weight, end.
    """
    order = sorted(range(len(sizes)), key=lambda i: sizes[i] / weights[i])
    left, level = share * sum(sizes), 0.0
    for k, i in enumerate(order):
        level = left / sum(weights[j] for j in order[k:])
        if cap * sizes[i] >= level * weights[i]:
            break
        left -= cap * sizes[i]
    return [min(cap * float(s), level * w) for s, w in zip(sizes, weights, strict=True)]


def segments(knots: Knots) -> list[dict[str, float]]:
    """Pieces of the normalised cumulative demand: from time ``t`` and share ``done``, weight ``w`` with slope ``k``."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    out, done = [], 0.0
    for (t, w), (t2, w2) in zip(knots, knots[1:], strict=False):
        out.append({"t": t, "done": done, "w": w / area, "k": (w2 - w) / (t2 - t) / area})
        done += (t2 - t) * (w + w2) / 2 / area
    return out


def invert_demand(pieces: Column, share: Column) -> Column:
    """Time at which the cumulative demand passes ``share`` of its total; null where that is never."""
    piece = F.element_at(F.filter(pieces, lambda x: x["done"] <= share), -1)
    rest = share - piece["done"]
    curved = (F.sqrt(F.greatest(piece["w"] * piece["w"] + 2 * piece["k"] * rest, F.lit(0.0))) - piece["w"]) / piece["k"]
    return F.when(share < 1, F.least(piece["t"] + F.when(F.abs(piece["k"]) < 1e-12, rest / piece["w"]).otherwise(curved), F.lit(1.0)))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: int = 2, schedules: Sequence[Knots] = DEFAULT_SCHEDULES, clip: bool = True) -> DataFrame:
    """One row per document: ``doc`` (its columns), ``doc_id, size, source_size, target, copies``.

    ``copies``: array of (epoch, taken, position) of the copies that the mix takes, positions from 0 to 1.
    ``clip``: the copy at a target's edge gives only the words up to there; otherwise it is taken whole if its middle is
    within the target, and not at all if not.
    """
    spark = docs.sparkSession
    n = docs.count()
    digits = max(1, math.ceil(math.log(max(n / max(200, math.isqrt(n)), 1), 16)))
    source = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    base = docs.select(F.struct(*columns(docs)).alias("doc"), F.xxhash64(*columns(docs)).alias("tie"), source.alias("src"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))).cast("binary")).alias("at")).withColumn("bucket", F.substring("at", 1, digits))
    totals = written(base.groupBy("src", "bucket").agg(F.sum("size").alias("total")), "mix-totals")
    found = sorted((r.none, r.name, r.size) for r in totals.groupBy("src").agg(F.sum("total").alias("size")).select("src.none", "src.name", "size").collect())
    each = [float(weights[i % len(weights)]) for i in range(len(found))]
    targets = water_fill([s for *_, s in found], each, share, cap)
    plan = spark.createDataFrame(
        [((none, name), size, t, segments(schedules[i % len(schedules)])) for i, ((none, name, size), t) in enumerate(zip(found, targets, strict=True))],
        "src struct<none:boolean,name:string>, source_size long, target double, pieces array<struct<t:double,done:double,w:double,k:double>>",
    )
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("src", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset")).join(plan, "src")
    inside = Window.partitionBy("src", "bucket").orderBy("at", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["src", "bucket"])
    start, size, quota = F.col("start") + F.col("offset"), F.col("size"), F.floor(F.col("target") + 0.5)

    def copy(epoch: Column) -> Column:
        begin = epoch * F.col("source_size") + start
        position = invert_demand(F.col("pieces"), begin / F.greatest(quota, F.lit(1)))
        edge = F.least(quota - begin, size) if clip else F.when(2 * begin + size <= 2 * quota, size).otherwise(0)
        return F.struct(epoch.cast("int").alias("epoch"), F.when(position.isNotNull(), edge).otherwise(0).cast("long").alias("taken"), position.alias("position"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), copy), lambda x: x["taken"] > 0)
    return placed.select("doc", "doc.doc_id", "size", "source_size", "target", copies.alias("copies"))


def training_order(mixed: DataFrame, partitions: int) -> DataFrame:
    """The documents' copies in training order: ``doc, size, epoch, taken, position``, range-sorted by position."""
    each = mixed.select("doc", "size", F.explode("copies").alias("copy")).select("doc", "size", "copy.*")
    return each.repartitionByRange(partitions, "position", "doc.doc_id").sortWithinPartitions("position", "doc.doc_id")


def digest(mixed: DataFrame, partitions: int) -> DataFrame:
    """Per document what the mix takes and when its first copy is due, range-sorted by that; documents that aren't taken come last."""
    sums = mixed.select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("copies", F.lit(0).cast("long"), lambda s, x: s + x["taken"]).alias("taken"),
        F.size("copies").alias("n_copies"), F.round(F.try_element_at("copies", F.lit(1))["position"], 9).alias("first_position"),
    )
    order = [F.col("first_position").asc_nulls_last(), F.col("doc_id").asc_nulls_first()]
    return sums.repartitionByRange(partitions, *order).sortWithinPartitions(*order)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS place
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS schedule
  FROM d GROUP BY source),
r AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
l AS (SELECT level FROM r WHERE 2 * source_size >= level * w ORDER BY source_size / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, schedule, least(2.0::DOUBLE * source_size, l.level * w) AS target FROM r, l),
p AS (
  SELECT d.*, source_size, target, schedule, CAST(floor(target + 0.5) AS BIGINT) AS quota,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(least(quota - start, size), 0) + greatest(least(quota - source_size - start, size), 0) AS BIGINT) AS taken,
       CAST((size > 0 AND start < quota)::INT + (size > 0 AND start + source_size < quota)::INT AS INT) AS n_copies,
       CASE WHEN size > 0 AND start < quota THEN round(CASE schedule
            WHEN 0 THEN sqrt(0.25::DOUBLE + 2 * (start / quota)) - 0.5::DOUBLE
            WHEN 1 THEN 1.5::DOUBLE - sqrt(2.25::DOUBLE - 2 * (start / quota))
            ELSE start / quota END, 9) END AS first_position
FROM p
"""
