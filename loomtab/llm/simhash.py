"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has bit ``b`` if more than half of the text's word shingles have it in their XXH64. Documents of equal
fingerprint are one vertex from the start. Two fingerprints link at ``most`` differing bits or fewer.

Candidates come from the pigeonring principle: with the 64 bits in ``most + 1`` segments on a ring, two linked fingerprints have
a start segment from which, for every length l, the first l segments differ in at most ``l * most / (most + 1)`` bits in all.
For l = 1 that is no bit: the start segment is equal, and is the join key. The longer chains prune what the key brings
together, before the full Hamming check.

A key that more than ``crowd`` different fingerprints share is split by a second ring over the other bits: two of its linked
fingerprints are equal in a segment of that too, so (segment, second segment) is the key, of 35 bits and more. With billions of fingerprints
the first ring's keys of 21 bits are all shared by chance, the second's are not.

A key of both rings that more than ``crowd`` share is a large group of near copies. It isn't paired, but
resolved exactly without pairs: two fingerprints within two bits have a common point within one bit of both,
so each gives the 65 points around it, and those that give the same point, 65 at most, are joined in a star. That way
is for ``most = 2``; for other values there is no crowd and keys are paired.

Results: null text has no words; no words give fingerprint zero; fewer words than a shingle give one shingle of all. Null
``doc_id`` counts as a member, and is a component's id only where it has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER, released, small_batches, utf8, word_offsets, written
from .components import connected


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each shingle, in order, repeats included; fewer words than a shingle are one."""
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(b" ".join(words), 42)], "<u8")
    joined, at = word_offsets(words)
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(at[:-shingle].tolist(), (at[shingle:] - 1).tolist(), strict=True)], "<u8")


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    h = shingle_hashes(words, shingle)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint16 if len(h) < 1 << 16 else np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of each document."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in utf8(b["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _masks(most: int) -> list[int]:
    """The ring's segments as bit masks."""
    edges = [64 * i // (most + 1) for i in range(most + 2)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _chain(start: int, most: int, diff: Column) -> Column:
    """Whether the chains from ``start`` stay within their budgets; the last is the full Hamming distance."""
    masks, ok, seen = _masks(most), F.lit(True), 0
    for length in range(1, most + 2):
        seen |= masks[(start + length - 1) % (most + 1)]
        ok &= F.bit_count(diff.bitwiseAND(_long(seen))) <= length * most // (most + 1)
    return ok


def _second_masks(taken: int, most: int) -> list[int]:
    """The bits outside a segment in ``most + 1`` parts."""
    bits = [b for b in range(64) if not taken >> b & 1]
    edges = [len(bits) * i // (most + 1) for i in range(most + 2)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(edges, edges[1:], strict=False)]


def _shared(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key another row has, with ``n`` of the key; a written table."""
    shared = written(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "segments")
    out = written(keyed.join(shared, keys), "shared-segments")
    released(shared)
    return out


def links(distinct: DataFrame, most: int = 2, crowd: int = 32) -> DataFrame:
    """``u, v``: links that join the fingerprints of ``distinct (fp)`` as all links would."""
    n = most + 1
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(_long(m)).alias("part")) for i, m in enumerate(_masks(most))]))
    keyed = distinct.select("fp", keys.alias("key")).select("fp", "key.start", "key.part")
    keyed = _shared(keyed, ["start", "part"])
    few = keyed.where(F.col("n") <= crowd) if most == 2 else keyed
    a, b = few.select("start", "part", F.col("fp").alias("u")), few.select("start", "part", F.col("fp").alias("v"))
    diff = F.col("u").bitwiseXOR(F.col("v"))
    fits = F.when(F.col("start") == 0, _chain(0, most, diff))
    for i in range(1, n):
        fits = fits.when(F.col("start") == i, _chain(i, most, diff))
    found = a.join(b, ["start", "part"]).where((F.col("u") > F.col("v")) & fits).select("u", "v")
    if most != 2:
        return found
    second = F.when(F.lit(False), F.array(F.struct(F.lit(0).alias("sub"), F.col("fp").alias("rest"))))
    for i, m in enumerate(_masks(most)):
        second = second.when(F.col("start") == i, F.array(*[F.struct(F.lit(j).alias("sub"), F.col("fp").bitwiseAND(_long(x)).alias("rest")) for j, x in enumerate(_second_masks(m, most))]))
    keys = ["start", "part", "sub", "rest"]
    inner = _shared(keyed.where(F.col("n") > crowd).select("fp", "start", "part", F.explode(second).alias("k")).select("fp", "start", "part", "k.*"), keys)
    few = inner.where(F.col("n") <= crowd)
    pairs = few.select(*keys, F.col("fp").alias("u")).join(few.select(*keys, F.col("fp").alias("v")), keys)
    found = found.union(pairs.where((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most)).select("u", "v"))
    crowded = inner.where(F.col("n") > crowd).select("fp").distinct()
    points = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    around = crowded.select("fp", F.explode(points).alias("point")).groupBy("point").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)  # 65 at most
    return found.union(around.select(F.explode("near").alias("u"), F.array_min("near").alias("v")).where("u <> v"))


def labelled(groups: DataFrame, most: int = 2, crowd: int = 32) -> DataFrame:
    """``groups``, with a row per fingerprint ``fp``, and the ``label`` of each one's component (its smallest fingerprint)."""
    joined = connected(links(groups.select("fp"), most, crowd))
    return written(groups.join(joined.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("label", F.coalesce("component", "fp")).drop("component"), "labelled")


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 2, crowd: int = 32) -> DataFrame:
    """``doc_id, fp, component_id``: each document with the smallest ``doc_id`` that links reach from it."""
    fps = written(fingerprints(docs, shingle), "fingerprints")
    groups = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    labels = labelled(groups, most, crowd)
    ids = labels.groupBy("label").agg(F.min("least").alias("component_id"))
    named = written(labels.join(ids, "label").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(docs: list[tuple[int, str | None]], most: int = 2) -> dict[int, tuple[str, int]]:
    """The contract, read literally: for tests."""
    fps = {}
    for d, x in docs:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "").encode().split()
        hs = [xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        fps[d] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0
    ids, comp = sorted(fps), {}
    for d in ids:
        if d not in comp:
            comp[d], todo = d, [d]
            while todo:
                x = todo.pop()
                for y in ids:
                    if y not in comp and (fps[x] ^ fps[y]).bit_count() <= most:
                        comp[y] = d
                        todo.append(y)
    return {d: (f"{fps[d]:016x}", comp[d]) for d in ids}
