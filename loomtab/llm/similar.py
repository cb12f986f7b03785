"""Near-duplicates at a similarity of shingle sets, by SimHash segments on a ring.

A SimHash of a whole text differs in 10 of 64 bits between texts that share 80 % of their shingles: too many for equal segments to
be join keys. So each segment of the ring is a SimHash of its own, of the three shingles that are smallest under the segment's
order. Texts of similarity ``s`` have an equal segment with a chance of about ``s ** 3``, and their other segments differ by few bits.

1. Buckets: texts with an equal key segment (the first twelve of the ring).
2. Round by round, some texts of each bucket are compared with all its members of other components, and leave it: up to ``FIRST`` in
   the first round, and up to ``FEW`` of those outside the largest component in the others. It goes on until the members left are of one
   component, so no bucket is left before all its pairs are compared or joined.
3. After the first round a bucket with more than ``FEW`` members outside its largest component is resolved another way, which loses no
   pair of it: by the shingles of its members' prefixes, rarest first (prefix filter). Two texts of the similarity share a shingle of both
   prefixes, so each such shingle is a bucket, and goes on by the rounds of 2 until all its pairs are compared or joined, whatever its size. Pairs
   of these buckets are pruned by bounds that are exact.
4. Pigeonring: two texts within ``budget`` differing bits over all ``n`` segments have a start from which, for each length l, the
   chain of l segments differs by ``l * budget / n`` bits at most. Pairs without such a start go. The budget is four
   deviations above what the similarity makes likely.
   In later rounds the 512 smallest shingle hashes of both are compared too.
5. What is left is compared exactly, by the shingle sets of both texts. A centre's text goes to each chunk of its members, whose texts
   stream past it: a task holds two texts at a time.

A link between texts of the similarity or more is missed where none of the twelve key segments is equal: two times in ten
thousand at 0.8, and less above (of texts of under ten shingles, up to two in a thousand); and where a pair is beyond the four deviations of 4. No size of a
bucket loses a link, and no pair is linked without the exact comparison.

Results: texts of equal words are one; null text has no words; texts without words are alike; fewer words than a shingle are one shingle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, columns, free, released, small_batches, utf8, written
from .components import connected
from .simhash import shingle_hashes

SEGMENTS, KEYS, SMALLEST, CHUNK, FIRST, FEW, MEMBERS = 48, 12, 3, 256, 16, 1024, 4096
_ODD = np.random.default_rng(42).integers(0, 1 << 63, SEGMENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The ``part`` of buckets by a prefix's shingle; those below are key segments.
EXACT = KEYS
CHAINS = (1, 2, 4, 8, 16)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The ring of a set of shingle hashes: for each segment the bitwise majority of its three smallest."""
    h = np.resize(hashes, SMALLEST) if len(hashes) < SMALLEST else hashes
    least = np.zeros((0, SEGMENTS), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(h), 1 << 13):
            part = np.concatenate([least, h[i : i + (1 << 13), None] * _ODD])
            part.partition(min(SMALLEST, len(part)) - 1, axis=0)
            least = part[:SMALLEST]
        x = (least ^ (least >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    return (x[0] & x[1]) | (x[0] & x[2]) | (x[1] & x[2])


def budget(similarity: float) -> float:
    """Differing bits over the ring, four deviations above the mean of texts of the similarity."""
    bits = (32, 24, 16, 0)  # expected where 0, 1, 2 or all of the three are shared
    p = [math.comb(SMALLEST, k) * similarity**k * (1 - similarity) ** (SMALLEST - k) for k in range(SMALLEST + 1)]
    mean = sum(a * b for a, b in zip(p, bits, strict=True))
    spread = sum(a * (b * b + b / 2) for a, b in zip(p, bits, strict=True)) - mean * mean
    return SEGMENTS * mean + 4 * math.sqrt(SEGMENTS * spread)


def on_the_ring(u: np.ndarray, v: np.ndarray, most: float) -> np.ndarray:
    """Which pairs of rings have a start whose chains are within their budgets, and then the full distance within ``most``."""
    diff = np.bitwise_count(u ^ v)
    upto = np.zeros((len(diff), SEGMENTS + CHAINS[-1] + 1), np.int16)
    np.cumsum(np.concatenate([diff, diff[:, : CHAINS[-1]]], 1), 1, out=upto[:, 1:])
    start = np.ones((len(diff), SEGMENTS), bool)
    for length in CHAINS:
        start &= upto[:, length : length + SEGMENTS] - upto[:, :SEGMENTS] <= length * most / SEGMENTS
    return start.any(1) & (upto[:, SEGMENTS] <= most)


def _sketched(shingle: int, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, rings = [], []
            for x in utf8(b["text"]):
                words = words_of(x)
                names.append(hashlib.md5(b" ".join(words)).hexdigest())
                rings.append(sketch(np.unique(shingle_hashes(words, shingle))).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(rings, pa.binary()), *[b[c] for c in carried]], ["vertex", "ring", *carried])

    return run


def _keyed(rings: DataFrame) -> DataFrame:
    """``part, key, vertex``: each of ``vertex, ring`` for every key segment."""
    parts = [F.struct(F.lit(i).alias("part"), F.xxhash64(F.lit(i), F.substring("ring", 8 * i + 1, 8)).alias("key")) for i in range(KEYS)]
    return rings.select("vertex", F.explode(F.array(*parts)).alias("k")).select("k.part", "k.key", "vertex")


def _shingled(shingle: int):
    """A row for each different shingle of each text, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, of, rows = [], [], 0
            for i, x in enumerate(utf8(b["text"])):
                found.append(np.unique(shingle_hashes(words_of(x), shingle)))
                of.append(i)
                rows += len(found[-1])
                if rows >= 1 << 16 or i + 1 == len(b):
                    sizes = np.array([len(y) for y in found], np.int32)
                    names = b["vertex"].take(pa.array(np.repeat(of, sizes)))
                    yield pa.RecordBatch.from_arrays([names, pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(found).view(np.int64))], ["vertex", "size", "key"])
                    found, of, rows = [], [], 0

    return run


def _prefixes(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``part, key, vertex``: the shingles of each text's prefix that other texts have; a written table.

    Shingles are in the order of how many of the ``texts`` have them, then of their hash. Texts of the similarity share ``similarity * size`` of either one's shingles
    at least, so the first shared one is among the first ``size - ceil(similarity * size) + 1`` of both. Those that no other text has
    come first, so they only shorten what is left of the prefix.
    """
    each = written(texts.mapInArrow(_shingled(shingle), "vertex string, size int, key long"), "similar-shingles")
    shared = written(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "similar-shared")
    own = Window.partitionBy("vertex")
    ranked = each.join(shared, "key").withColumns({"rank": F.row_number().over(own.orderBy("n", "key")), "others": F.count(F.lit(1)).over(own)})
    prefix = F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9) + 1
    out = written(ranked.where(F.col("size") - F.col("others") + F.col("rank") <= prefix).select(F.lit(EXACT).alias("part"), "key", "vertex"), "similar-prefixes")
    released(each, shared)
    return out


def _pruned(most: float):
    """Pairs of a member's ring and those of its bucket's centres of other components that the pigeonring lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = np.repeat(np.arange(len(b)), pc.list_value_length(b["names"]).to_numpy())
            rings, centres = (np.frombuffer(b"".join(b[c].to_pylist()), "<u8").reshape(-1, SEGMENTS) for c in ("ring", "rings"))
            names, apart = b["names"].flatten(), pc.not_equal(b["components"].flatten(), b["component"].take(of)).to_numpy(zero_copy_only=False)
            out = []
            for i in range(0, len(of), 1 << 14):
                at = i + np.flatnonzero(apart[i : i + (1 << 14)])
                out.append(at[on_the_ring(rings[of[at]], centres[at], most)])
            at = np.concatenate([*out, np.zeros(0, np.int64)])
            u, v = names.take(at), b["vertex"].take(of[at])
            yield pa.RecordBatch.from_arrays([pc.min_element_wise(u, v), pc.max_element_wise(u, v)], ["u", "v"])

    return run


def _compared(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, np.uint64)
        for b in batches:
            found = []
            for u, v, x in zip(b["u"].to_pylist(), b["v"].to_pylist(), utf8(b["text"]), strict=True):
                h = np.unique(shingle_hashes(words_of(x), shingle))
                if v is None:
                    centre, own = u, h
                    continue
                if u != centre:
                    raise ValueError("members without their centre")
                both = len(np.intersect1d(own, h, assume_unique=True))
                if both >= similarity * (len(own) + len(h) - both) - 1e-9:
                    found.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["u", "v"])

    return run


def _exact(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs ``u, v`` whose texts are of the similarity, written. A centre's members are in chunks, its text is in each."""
    sizes = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = written(pairs.join(sizes, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("chunks")).alias("chunk")), "similar-pairs")
    centres = dealt.select("u", "chunk").distinct().join(texts.withColumnRenamed("vertex", "u"), "u").select("u", "chunk", F.lit(None).cast("string").alias("v"), "text")
    members = dealt.join(texts.withColumnRenamed("vertex", "v"), "v").select("u", "chunk", "v", "text")
    rows = centres.union(members).repartition("u", "chunk").sortWithinPartitions("u", "chunk", F.col("v").asc_nulls_first())
    out = written(rows.select("u", "v", "text").mapInArrow(_compared(shingle, similarity), "u string, v string"), "similar-links")
    released(dealt)
    return out


def similar(docs: DataFrame, keys: list[str], shingle: int, similarity: float) -> DataFrame:
    """``vertex, label`` and the ``keys`` of each row of ``docs (text, *keys)``; rows of one label are linked by similar texts."""
    spark = docs.sparkSession
    small_batches(spark)
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keys)
    rows = written(docs.select("text", *keys).mapInArrow(_sketched(shingle, keys), "vertex string, ring binary" + kinds), "similar-rows")
    rings = written(rows.groupBy("vertex").agg(F.first("ring").alias("ring"), F.min(F.struct(*keys)).alias("row")), "similar-rings")
    members = _keyed(rings).withColumn("may", F.lit(True))
    texts = tried = label = last = None
    while True:
        shared = members.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        at = members.join(shared, ["part", "key"]).join(rings.select("vertex", "ring"), "vertex")
        at = written(_placed(at, label), "similar-members")
        if not at.limit(1).count():
            break
        if texts is None:  # of all that will ever be compared: later buckets are parts of these
            some = at.select("vertex").distinct().join(rings, "vertex").select("vertex", "row.*")
            texts = written(docs.select("text", *keys).join(some, keys).select("vertex", "text").dropDuplicates(["vertex"]), "similar-texts")
        slot = F.pmod(F.xxhash64("vertex"), F.lit(FIRST if label is None else FEW))
        least = written(at.where("may").groupBy("part", "key", slot.alias("slot")).agg(F.min(F.struct("vertex", "component", "ring")).alias("c")).select("part", "key", "slot", "c.*"), "similar-centres")
        near = (_beside(at, least, similarity) if label is None else _streamed(at, least, texts, shingle, similarity)).distinct()
        near = written(near if tried is None else near.join(tried, ["u", "v"], "left_anti"), "similar-tried")
        tried = near if tried is None else tried.union(near)
        label, old = _joined(label, _exact(near, texts, shingle, similarity)), label
        left = at.join(least, ["part", "key", "vertex"], "left_anti").select("part", "key", "vertex")
        open_ = written(_apart(_placed(left, label)), "similar-open")
        released(at, least, old, last)
        members, last = open_.select("part", "key", "vertex", "may"), open_
        if old is None:  # members only leave and components only grow, so no bucket gets crowded later
            crowded = written(open_.where(F.col("apart") > FEW).select("vertex").distinct(), "similar-crowded")
            if crowded.limit(1).count():
                prefixes = _prefixes(texts.join(crowded, "vertex", "left_semi"), shingle, similarity)
                members = open_.where(F.col("apart") <= FEW).union(_apart(_placed(prefixes, label))).select("part", "key", "vertex", "may")
    if label is None:
        return rows.select("vertex", F.col("vertex").alias("label"), *keys)
    return rows.select("vertex", *keys).join(label, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("label"), *keys)


def _placed(members: DataFrame, label: DataFrame | None) -> DataFrame:
    """Members with their ``component``: themselves where they have no link."""
    at = members.withColumn("component", F.lit(None).cast("string")) if label is None else members.join(label, "vertex", "left")
    return at.withColumn("component", F.coalesce("component", "vertex"))


def _beside(at: DataFrame, least: DataFrame, similarity: float) -> DataFrame:
    """Pairs of a bucket's few centres and its members that the pigeonring lets pass; a member's row has all of the centres' rings."""
    few = least.groupBy("part", "key").agg(F.collect_list(F.struct("vertex", "component", "ring")).alias("c"))  # FIRST at most
    few = few.select("part", "key", F.col("c.vertex").alias("names"), F.col("c.component").alias("components"), F.aggregate("c.ring", F.lit(b""), lambda a, x: F.concat(a, x)).alias("rings"))
    beside = at.join(few, ["part", "key"]).select("vertex", "component", "ring", "names", "components", "rings")
    return beside.mapInArrow(_pruned(budget(similarity)), "u string, v string")


def _streamed(at: DataFrame, least: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The same for up to ``FEW`` centres: members, in chunks, stream past a task that holds the centres' rings and smallest shingles."""
    low = at.select("vertex").distinct().join(texts, "vertex").mapInArrow(_smallest(shingle), "vertex string, low binary, size int")
    names = ["part", "key", "chunk", "centre", "vertex", "component", "ring"]
    sizes = at.groupBy("part", "key").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("chunks"))
    members = at.join(sizes, ["part", "key"]).withColumns({"chunk": F.pmod(F.xxhash64("vertex"), F.col("chunks")).cast("int"), "centre": F.lit(False)}).select(*names)
    centres = least.join(sizes, ["part", "key"]).withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "centre": F.lit(True)}).select(*names)
    rows = centres.union(members).join(low, "vertex").repartition("part", "key", "chunk").sortWithinPartitions("part", "key", "chunk", F.desc("centre"))
    return rows.select(*names, "low", "size").mapInArrow(_past(similarity), "u string, v string")


#: Smallest shingle hashes that stand for a text; of fewer, all.
LOW = 512


def _smallest(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingle_hashes(words_of(x), shingle)) for x in utf8(b["text"])]
            yield pa.RecordBatch.from_arrays([b["vertex"], pa.array([x[:LOW].tobytes() for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int32())], ["vertex", "low", "size"])

    return run


def _close(a: np.ndarray, b: np.ndarray, whole: bool, similarity: float) -> bool:
    """Whether two texts may be of the similarity, by their smallest hashes: exact where they are all, else within four deviations."""
    both = np.union1d(a, b)
    if whole:
        return len(a) + len(b) - len(both) >= similarity * len(both) - 1e-9
    both = both[:LOW]
    shared = np.intersect1d(a, b, assume_unique=True)
    return np.searchsorted(shared, both[-1], side="right") >= (similarity - 4 * math.sqrt(similarity * (1 - similarity) / LOW)) * len(both)


class _Index:
    """Centres of a bucket by prefix shingles, by their smallest hashes."""

    def __init__(self, lows: list[np.ndarray], sizes: list[int], similarity: float):
        flat = np.concatenate(lows)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(lows)), [len(x) for x in lows])[order]
        self.sizes, self.ends, self.similarity = np.array(sizes), np.array([self.end(x, n) for x, n in zip(lows, sizes, strict=True)]), similarity

    @staticmethod
    def end(low: np.ndarray, size: int) -> np.uint64:
        """Up to where the smallest hashes are all of the text's."""
        return low[-1] if size > LOW else np.uint64(2**64 - 1)

    def possible(self, low: np.ndarray, size: int) -> np.ndarray:
        """Which centres can be of the similarity: no more is shared than among the smallest, and all the rest of the text whose smallest end first."""
        a, b = np.searchsorted(self.flat, low), np.searchsorted(self.flat, low, side="right")
        n = b - a
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.sizes))
        rest = np.where(self.ends <= self.end(low, size), self.sizes, size) - LOW
        both = np.minimum(shared + np.maximum(rest, 0), np.minimum(self.sizes, size))
        return both >= self.similarity * (self.sizes + size - both) - 1e-9


def _past(similarity: float):
    most = budget(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, names, parts, rings, lows, sizes, ready = None, [], [], [], [], [], None
        for b in batches:
            found = []
            for r in b.to_pylist():
                ring, low = np.frombuffer(r["ring"], "<u8"), np.frombuffer(r["low"], "<u8")
                if (r["part"], r["key"], r["chunk"]) != group:
                    group, names, parts, rings, lows, sizes, ready = (r["part"], r["key"], r["chunk"]), [], [], [], [], [], None
                if r["centre"]:
                    names.append(r["vertex"])
                    parts.append(r["component"])
                    rings.append(ring)
                    lows.append(low)
                    sizes.append(r["size"])
                    continue
                if ready is None and parts:
                    ready = np.array(parts), _Index(lows, sizes, similarity) if r["part"] == EXACT else np.array(rings)
                other = np.flatnonzero(ready[0] != r["component"]) if parts else []
                if not len(other):
                    continue
                fits = ready[1].possible(low, r["size"])[other] if r["part"] == EXACT else on_the_ring(ready[1][other], ring[None], most)
                for i in other[fits].tolist():
                    if r["part"] == EXACT or _close(lows[i], low, max(sizes[i], r["size"]) <= LOW, similarity):
                        found.append((min(names[i], r["vertex"]), max(names[i], r["vertex"])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["u", "v"])

    return run


def _apart(left: DataFrame) -> DataFrame:
    """Members of buckets of several components: how many are ``apart`` from the largest, and whether this one ``may`` be a centre."""
    parts = left.groupBy("part", "key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("part", "key").agg((F.sum("n") - F.max("n")).alias("apart"), F.max(F.struct("n", "component")).alias("big"))
    found = left.join(parts.where("apart > 0"), ["part", "key"])
    return found.select("part", "key", "vertex", "component", "apart", (F.col("component") != F.col("big.component")).alias("may"))


def _joined(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """``vertex, component`` with new links: components are the vertices of the graph that the links are taken to."""
    if label is None:
        out = written(connected(links), "similar-labels")
        released(links)
        return out
    ends = links.select(F.col("u").alias("vertex")).union(links.select(F.col("v").alias("vertex"))).distinct()
    known = written(label.join(ends, "vertex", "full").select("vertex", F.coalesce("component", "vertex").alias("component")), "similar-labels")
    of = lambda c: known.select(F.col("vertex").alias(c), F.col("component").alias(f"c{c}"))
    between = connected(links.join(of("u"), "u").join(of("v"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    new = between.select(F.col("vertex").alias("component"), F.col("component").alias("whole"))
    out = written(known.join(new, "component", "left").select("vertex", F.coalesce("whole", "component").alias("component")), "similar-labels")
    released(known, links)
    return out


def first_rows(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of similar texts: that of the smallest ``doc_id``, then of the smallest key; null ids come last.

    Rows are told apart by 128 bits of hash over all columns and their nulls, not by ``doc_id``; rows that are equal throughout are one.
    """
    values = [x for c in columns(docs) for x in (c.isNull(), c)]
    key = free(docs, "__k")
    hashed = {f"{key}1": F.xxhash64(*values), f"{key}2": F.xxhash64(F.lit(1), *values)}
    order = {"__none": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), **hashed}
    found = written(similar(docs.select("text", *[c.alias(k) for k, c in order.items()]), list(order), shingle, similarity), "similar-found")
    chosen = written(found.groupBy("label").agg(F.min(F.struct(*order)).alias("first")).select(*[f"first.{k}" for k in hashed]), "first-rows")
    kept = docs.withColumns(hashed).join(chosen, list(hashed), "left_semi")
    if found.groupBy(*hashed).count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(list(hashed))
    return kept.drop(*hashed)


def brute_force(texts: list[str | None], shingle: int = 5, similarity: float = 0.8) -> list[int]:
    """For each text the first one that links reach from it, by all pairs: for tests."""
    sets = []
    for t in texts:
        w = words_of((t or "").encode())
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))})
    out = list(range(len(texts)))

    def root(i: int) -> int:
        while out[i] != i:
            i = out[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((root(i), root(j)))
                out[b] = a
    return [root(i) for i in range(len(texts))]
