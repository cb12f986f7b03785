"""Substring deduplication by difference-cover anchors.

A set ``D`` of residues is a difference cover modulo ``v`` if every residue is a difference of two of its members.
Then two equal word sequences, wherever they start, have an offset ``k < v`` at which both positions are in ``D``
modulo ``v``. So it is enough to hash short windows ("anchors") at cover positions alone: a match of
``window`` words shares an aligned anchor of ``window - v + 1`` words. With 20 words, ``v = 13`` and four residues,
31 % of the positions are hashed.

1. Documents are dealt into blocks by ``doc_id`` and text, so rows that share an id are spread. Each block sends the anchors it has, each once, to buckets by hash.
2. A bucket tells each block which of its anchors other blocks have too.
3. Around these the block extends: each full window that holds a repeated anchor is a candidate, hashed to 96 bits.
   A block sends its earliest occurrence of each to buckets.
4. A bucket tells each block which of its occurrences are not the earliest of all. Covered words go.

A hot passage is sent once by each block, so no bucket gets more rows of it than there are blocks, and no pairs are
made. The text is shuffled once; the second and third use of the blocks reuse that exchange.

Results: null text has no words. Rows that share a ``doc_id`` share its place in the order, so
neither of two such rows makes the other lose a window at the same start. Null ``doc_id`` comes first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import extent, packed, pieces, small_batches, utf8, word_offsets

#: Difference covers, fixed values: period -> residues.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}

FIRST_ID = np.iinfo(np.int64).min


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, residues and anchor length for matches of ``window`` words."""
    period = 13 if window >= 20 else 7 if window >= 10 else 3 if window >= 5 else 1
    return period, COVERS[period], window - period + 1


def anchors(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Cover positions and hashes of the anchors there; the joined words and their offsets."""
    period, cover, length = cover_for(window)
    joined, at = word_offsets(words)
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), joined, at
    where = np.arange(len(words) - length + 1)
    where = where[np.isin(where % period, cover)]
    hashes = np.fromiter((xxh3_64_intdigest(joined[a:b]) for a, b in zip(at[where].tolist(), (at[where + length] - 1).tolist(), strict=True)), np.uint64, len(where))
    return where, hashes, joined, at


def candidates(n: int, where: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that hold one of the anchors at ``where``."""
    period = cover_for(window)[0]
    edge = np.zeros(n - window + 2, np.int64)
    np.add.at(edge, np.maximum(where - period + 1, 0), 1)
    np.add.at(edge, np.minimum(where, n - window) + 1, -1)
    return np.flatnonzero(np.cumsum(edge[:-1]))


def _rows(t: pa.Table) -> list[tuple[int, int | None, bytes]]:
    """A block's rows in an order that each pass finds again: (order of doc_id, doc_id, text)."""
    return sorted(((FIRST_ID if d is None else d, d, x) for d, x in zip(t["doc_id"].to_pylist(), utf8(t["text"]), strict=True)), key=lambda r: (r[0], r[2]))


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _by_bucket(buckets: np.ndarray):
    """Order by bucket, and each bucket with its slice."""
    order = np.argsort(buckets, kind="stable")
    names, starts = np.unique(buckets[order], return_index=True)
    ends = np.append(starts[1:], len(order))[: len(names)]
    return order, zip(names.tolist(), starts.tolist(), ends.tolist(), strict=True)


def _send_anchors(window: int, n_buckets: int):
    def send(t: pa.Table) -> pa.Table:
        block = t["block"][0].as_py()
        found = [anchors(x.split(), window)[1] for _, _, x in _rows(t)]
        own = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]))
        order, parts = _by_bucket(own % np.uint64(n_buckets))
        own = own[order]
        out = [(b, packed(own[i:j])) for b, i, j in parts]
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "block": pa.array([block] * len(out), pa.int32()), "h": pa.array([h for _, h in out], pa.binary())})

    return send


def _shared_anchors(t: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, np.uint64) for x in t["h"].to_pylist()]
    names, counts = np.unique(np.concatenate(parts), return_counts=True)
    shared = names[counts > 1]
    kept = [(b, p[_among(p, shared)]) for b, p in zip(t["block"].to_pylist(), parts, strict=True)]
    kept = [(b, packed(p)) for b, p in kept if len(p)]
    return pa.table({"block": pa.array([b for b, _ in kept], pa.int32()), "h": pa.array([h for _, h in kept], pa.binary())})


WINDOW = np.dtype([("hi", "<u8"), ("lo", "<u4"), ("pos", "<u4"), ("doc", "<i8"), ("row", "<u4")])


def _not_first(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``w`` by window and place; for each, whether an earlier place has the same window."""
    w = w[np.lexsort((w["pos"], w["doc"], w["lo"], w["hi"]))]
    new = np.ones(len(w), bool)
    new[1:] = (w["hi"][1:] != w["hi"][:-1]) | (w["lo"][1:] != w["lo"][:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
    return w, (w["doc"] != w["doc"][lead]) | (w["pos"] != w["pos"][lead])


def _runs(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, last start) of each run of consecutive starts."""
    order = np.lexsort((starts, rows))
    rows, starts = rows[order].astype(np.int64), starts[order].astype(np.int64)
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (starts[1:] - starts[:-1] > 1)
    i = np.flatnonzero(new)
    return rows[i], starts[i], starts[np.append(i[1:], len(rows)) - 1] if len(rows) else starts


def _pack_runs(rows: np.ndarray, starts: np.ndarray) -> bytes:
    return packed(np.stack(_runs(rows, starts), 1).astype("<u4"))


_WINDOWS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("w", pa.binary()), ("gone", pa.binary())])


def _send_windows(window: int, n_buckets: int):
    def send(docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _WINDOWS.empty_table()
        block = docs["block"][0].as_py()
        each = [(k, d, anchors(x.split(), window)) for k, (d, _, x) in enumerate(_rows(docs))]
        own, counts = np.unique(np.concatenate([a[1] for _, _, a in each]), return_counts=True)
        repeated = np.union1d(own[counts > 1], np.concatenate([*(np.frombuffer(x, np.uint64) for x in shared["h"].to_pylist()), np.zeros(0, np.uint64)]))
        hits = _among(np.concatenate([a[1] for _, _, a in each]), repeated)
        ends = np.cumsum([len(a[1]) for _, _, a in each])
        found = []
        for (k, d, (where, _, joined, at)), end in zip(each, ends.tolist(), strict=True):
            where = where[hits[end - len(where) : end]]
            if not len(where):
                continue
            starts = candidates(len(at) - 1, where, window)
            digests = b"".join([xxh3_128_digest(joined[a:b]) for a, b in zip(at[starts].tolist(), (at[starts + window] - 1).tolist(), strict=True)])
            halves = np.frombuffer(digests, "<u8").reshape(-1, 2)
            w = np.empty(len(starts), WINDOW)
            w["hi"], w["lo"], w["pos"], w["doc"], w["row"] = halves[:, 0], halves[:, 1] >> np.uint64(32), starts, d, k
            found.append(w)
        if not found:
            return _WINDOWS.empty_table()
        w, late = _not_first(np.concatenate(found))
        gone, w = w[late], w[~late]
        order, parts = _by_bucket(w["hi"] % np.uint64(n_buckets))
        w = w[order]
        rows = [(b, packed(w[i:j]), None) for b, i, j in parts]
        if len(gone):
            rows.append((block % n_buckets, None, _pack_runs(gone["row"], gone["pos"])))
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], schema=_WINDOWS)

    return send


def _late_windows(t: pa.Table) -> pa.Table:
    blocks, sent = t["block"].to_pylist(), t["w"].to_pylist()
    out = [(b, g) for b, g in zip(blocks, t["gone"].to_pylist(), strict=True) if g is not None]
    sent = [(b, np.frombuffer(x, WINDOW)) for b, x in zip(blocks, sent, strict=True) if x is not None]
    if sent:
        w = np.concatenate([x for _, x in sent])
        of = np.repeat(np.array([b for b, _ in sent]), [len(x) for _, x in sent])
        order = np.lexsort((w["pos"], w["doc"], w["lo"], w["hi"]))
        w, late = _not_first(w[order])
        w, of = w[late], of[order][late]
        order, parts = _by_bucket(of)
        w = w[order]
        out += [(b, _pack_runs(w["row"][i:j], w["pos"][i:j])) for b, i, j in parts]
    return pa.table({"block": pa.array([b for b, _ in out], pa.int32()), "gone": pa.array([g for _, g in out], pa.binary())})


def _cut(window: int):
    def cut(docs: pa.Table, gone: pa.Table) -> pa.Table:
        rows = _rows(docs) if docs.num_rows else []
        runs: dict[int, list[tuple[int, int]]] = {}
        for x in gone["gone"].to_pylist():
            for r, a, b in np.frombuffer(x, "<u4").reshape(-1, 3).tolist():
                runs.setdefault(r, []).append((a, b))
        out = []
        for k, (_, d, x) in enumerate(rows):
            words = x.split()
            if k in runs:
                edge = np.zeros(len(words) + 1, np.int64)
                for a, b in runs[k]:
                    edge[a] += 1
                    edge[b + window] -= 1
                keep = np.cumsum(edge[:-1]) == 0
                kept = [w for w, ok in zip(words, keep.tolist(), strict=True) if ok]
            else:
                kept = words
            out.append((d, len(words), len(words) - len(kept), b" ".join(kept).decode()))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "n_words", "n_removed", "kept"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)})

    return cut


def remove_repeated_windows(docs: DataFrame, window: int = 20, block_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: each document without the words that an earlier window has.

    ``block_bytes``: text of a block on average; it bounds what a task holds.
    """
    small_batches(docs.sparkSession)
    n_rows, size = extent(docs, "text")
    n_blocks = pieces(size, block_bytes, min(max(n_rows, 1), 24))
    n_buckets = n_blocks
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"))
    by_block = docs.groupBy("block")
    shared = by_block.applyInArrow(_send_anchors(window, n_buckets), "bucket int, block int, h binary").groupBy("bucket").applyInArrow(_shared_anchors, "block int, h binary")
    late = by_block.cogroup(shared.groupBy("block")).applyInArrow(_send_windows(window, n_buckets), "bucket int, block int, w binary, gone binary").groupBy("bucket").applyInArrow(_late_windows, "block int, gone binary")
    return by_block.cogroup(late.groupBy("block")).applyInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string")


def digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], window: int = 20) -> dict[int, tuple[int, int, str]]:
    """The contract, read literally: for tests."""
    first: dict[tuple[bytes, ...], tuple[int, int]] = {}
    split = {d: (x or "").encode().split() for d, x in docs}
    for d in sorted(split):
        for i in range(len(split[d]) - window + 1):
            first.setdefault(tuple(split[d][i : i + window]), (d, i))
    out = {}
    for d, words in split.items():
        gone = {j for i in range(len(words) - window + 1) if first[tuple(words[i : i + window])] != (d, i) for j in range(i, i + window)}
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        out[d] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
v AS (SELECT r, doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) AS win FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
late AS (
  SELECT r, s FROM (SELECT r, s, rank() OVER (PARTITION BY win ORDER BY doc_id NULLS FIRST, s) AS k FROM v) WHERE k > 1),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 20)) AS p FROM late),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
