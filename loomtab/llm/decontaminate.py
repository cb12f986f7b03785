"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item gives its windows of ``window`` consecutive words (an item of fewer words, one window). As a set join
with containment 1, a window's necessary prefix in the order of rarity is its rarest word: a document that lacks it
can't hold the window. Rarity is the number of documents with the word, counted over all documents for the words of
the benchmark. The prefix words are the join keys; a match gives an alignment, which has to lie within the document (the length and
positional bounds), and is then compared word by word.

The benchmark is taken in blocks of about ``block_words`` words: only such a block is broadcast. A pass over the texts for each block but the last
writes what it finds, once for equal texts, by a 128-bit hash of the text: texts without finds leave nothing. The last block's pass joins these
and gives the rows. So no text is ever written, a benchmark of one block shuffles nothing, and any size is exact.
One item has to fit into memory, as one document has.

Results: null text has no words; items without words match nothing; equal windows of several items count for each;
null ``item_id`` is not counted among the items but its windows are hit.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import columns, pieces, small_batches, utf8, written

#: Words are runs of digits, letters a-z and all beyond ASCII, after A-Z are lower-cased: fixed by the contract.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []


def document_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """For each word of a bounded vocabulary, the number of documents that have it, over all documents."""
    known = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(sorted(vocabulary))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, total = known.value, Counter()
        for b in batches:
            for x in utf8(b["text"]):
                total.update(names.keys() & set(words_of(x)))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([names[w] for w in total], pa.int32()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    found = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    names = sorted(vocabulary)
    return {names[r.word]: r.n for r in found}


def prefix_index(windows: list[tuple[bytes, ...]], rarity: dict[bytes, int]) -> dict[bytes, list[tuple[int, int]]]:
    """Rarest word -> (its first place in the window, window)."""
    index: dict[bytes, list[tuple[int, int]]] = {}
    for k, w in enumerate(windows):
        rarest = min(w, key=lambda x: (rarity.get(x, 0), x))
        if rarest in rarity or not rarity:  # a word that no document has needs no search
            index.setdefault(rarest, []).append((w.index(rarest), k))
    return index


def _find(words: list[bytes], index: dict[bytes, list[tuple[int, int]]], windows: list[tuple[bytes, ...]]) -> list[tuple[int, int]]:
    """(start, window) of each occurrence."""
    if index.keys().isdisjoint(words):
        return []
    n, out = len(words), []
    for i in [i for i, w in enumerate(words) if w in index]:
        for o, k in index[words[i]]:
            w, s = windows[k], i - o
            if s >= 0 and s + len(w) <= n and words[s] == w[0] and tuple(words[s : s + len(w)]) == w:
                out.append((s, k))
    return out


FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, spans array<long>, items array<string>"
FINDS = "__k1 long, __k2 long, spans array<long>, items array<string>"


def _runs(spans: list[int]) -> list[int]:
    """Spans as start and end words in turn, in order and joined where they meet."""
    out: list[int] = []
    for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _in_block(words: list[bytes], block) -> tuple[list[int], set[str]]:
    """Runs of words hit by a block's windows, and the items of these."""
    index, windows, items = block
    found = _find(words, index, windows)
    return _runs([x for s, k in found for x in (s, s + len(windows[k]))]), {i for _, k in found for i in items[k]}


def _search(block):
    """The texts that hold any of a block's windows, by key, and what they hold; a batch gives equal texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {}
            for k1, k2, x in zip(b["__k1"].to_pylist(), b["__k2"].to_pylist(), utf8(b["text"]), strict=True):
                if (k1, k2) not in found:
                    found[k1, k2] = _in_block(words_of(x), block.value)
            rows = [(*k, spans, sorted(items)) for k, (spans, items) in found.items() if spans]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["__k1", "__k2", "spans", "items"])

    return run


def _summed(block):
    """Adds the last block's finds to those of the others, and sums them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, ids, counts = [], [], []
            for x, old_spans, old_ids in zip(utf8(b["text"]), b["spans"].to_pylist(), b["items"].to_pylist(), strict=True):
                words = words_of(x)
                new, items = _in_block(words, block.value)
                spans.append(_runs(old_spans + new) if old_spans else new)
                ids.append(sorted(items.union(old_ids or [])))
                counts.append(len(words))
            hits = [sum(x[1::2]) - sum(x[::2]) for x in spans]
            sums = [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([b["doc"], *sums, pa.array(spans, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))], ["doc", *[x.split()[0] for x in FOUND.split(", ")]])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 500_000) -> DataFrame:
    """``docs`` in ``doc`` (all columns), with ``n_words, n_hit, n_items, items_sha256, spans, items``.

    ``spans``: start and end words of hit runs, in turn; ``items``: the ids as sorted strings.
    """
    spark = docs.sparkSession
    small_batches(spark)
    total = benchmark.agg(F.coalesce(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))), F.lit(0))).first()[0]
    n_blocks = pieces(total, block_words)
    key = {"__k1": F.xxhash64("text"), "__k2": F.xxhash64(F.lit(1), "text")}
    rows = docs.select(F.struct(*columns(docs)).alias("doc"), docs["text"].alias("text"))
    earlier = []
    for k in range(n_blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).select(F.col("item_id").cast("string").alias("i"), "text")
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for r in part.toLocalIterator():  # a block: block_words words
            for w in windows_of(words_of((r.text or "").encode()), window):
                owners.setdefault(w, set()).update([] if r.i is None else [r.i])
        windows = list(owners)
        rarity = document_counts(docs, {x for w in windows for x in w})
        block = spark.sparkContext.broadcast((prefix_index(windows, rarity or {b"": 0}), windows, [sorted(owners[w]) for w in windows]))
        if k + 1 < n_blocks:
            once = docs.select("text").withColumns(key).mapInArrow(_search(block), FINDS).groupBy("__k1", "__k2").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
            earlier.append(written(once, "decontaminate"))  # a worker then holds one block at a time
    if earlier:
        finds = reduce(DataFrame.union, earlier).groupBy("__k1", "__k2").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items")])  # a row per block
        rows = rows.withColumns(key).join(finds, list(key), "left").drop(*key)
    else:
        rows = rows.withColumns({"spans": F.lit(None).cast("array<long>"), "items": F.lit(None).cast("array<string>")})
    return rows.mapInArrow(_summed(block), StructType([rows.schema["doc"], *StructType.fromDDL(FOUND).fields]))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc.doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT item, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s, w FROM b WHERE len(w) > 0),
bx AS (SELECT DISTINCT item, k, array_to_string(w[s : s + k - 1], ' ') AS win FROM bw),
ks AS (SELECT DISTINCT k FROM bx),
dw AS (
  SELECT r, k, s, array_to_string(w[s : s + k - 1], ' ') AS win
  FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
m AS (SELECT r, dw.k, s, item FROM dw JOIN bx ON dw.k = bx.k AND dw.win = bx.win),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN i ON d.r = i.r
"""
