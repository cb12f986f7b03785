"""Token-ID files with a minimal perfect hash index.

Documents are range-sorted by ``doc_id`` into shards. A shard is two files in the shared folder:

``*.bin``  the raw ids of its documents, end id included, back to back, little-endian (16 bit where the vocabulary fits)
``*.idx``  a header and the index: a BBHash-style cascade of bit vectors with ranks maps a key to a slot in 0..n-1;
           the slot holds a 32-bit fingerprint of the key, the record number, and the record's first id and length

A lookup hashes the key, walks at most a few levels, and checks the fingerprint: constant time, and a key that is not there
is refused but for one in 2^32. A key is (doc_id, occurrence), so repeated ids have an entry each.

A task encodes ``BATCH_CHARS`` characters at a time and appends their ids to the file, so its memory grows by the index alone, not by the shard's
text. It writes under a name of its own and reports it; only reported names are in the manifest, a table in the shared
folder, so retries and speculative copies leave files that nobody reads.

Encoding takes the distinct chunks between ASCII white space of a batch of texts, and puts each through the library once. That is exact for
tokenizers of the style of ``word_bpe_49k.json``: no pre-token spans white space, normalisation neither composes nor reorders over it,
and white space gives no ids. The file is checked for that style; any other tokenizer gets whole texts.

Results: null text is empty and gives the end id alone; null ``doc_id`` comes first; repeated ``doc_id`` in order of text.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import extent, pieces, shared_dir, small_batches, written

MAGIC = b"LTIX0001"
MIX = np.uint64(0x9E3779B97F4A7C15)
BATCH_CHARS = 4 << 20


# --- minimal perfect hash -------------------------------------------------------------------------------------------


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser over the keys, one hash function per salt."""
    with np.errstate(over="ignore"):
        x = keys + MIX * np.uint64(salt + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(doc_id: np.ndarray, null: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """One 64-bit word for (doc_id or null, occurrence)."""
    return mixed(mixed(doc_id.astype(np.int64).view(np.uint64), 101) ^ mixed(occurrence.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64), 103), 107)


class PerfectHash:
    """Levels of bit vectors; a key's slot is the rank of its bit over all levels."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = []
        done = 0
        for bits in levels:
            counts = np.bitwise_count(bits).astype(np.int64)
            self.before.append(done + np.concatenate([[0], np.cumsum(counts)[:-1]]))
            done += int(counts.sum())
        self.size = done

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            n = max(1, int(np.ceil(gamma * len(left) / 64)))
            at = mixed(left, len(levels)) % np.uint64(n * 64)
            names, first, counts = np.unique(at, return_index=True, return_counts=True)
            alone = names[counts == 1]
            bits = np.zeros(n, np.uint64)
            np.bitwise_or.at(bits, (alone >> np.uint64(6)).astype(np.int64), np.uint64(1) << (alone & np.uint64(63)))
            levels.append(bits)
            left = np.delete(left, first[counts == 1])
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for keys that were not built in, any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        for salt, (bits, before) in enumerate(zip(self.levels, self.before, strict=True)):
            open_ = np.flatnonzero(out < 0)
            at = mixed(keys[open_], salt) % np.uint64(len(bits) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = (bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[here]] = (before[word] + below)[here]
        return out


RECORD = np.dtype([("print", "<u4"), ("count", "<u4"), ("start", "<i8"), ("record", "<u4"), ("null", "<u4"), ("doc_id", "<i8"), ("occurrence", "<u8")])


def index_bytes(hashes: np.ndarray, records: np.ndarray, width: int) -> bytes:
    """``*.idx``: magic, id width, records, levels; then each level's words; then the slots."""
    mph = PerfectHash.build(hashes)
    slots = np.empty(len(records), RECORD)
    slots[mph.slots(hashes)] = records
    head = MAGIC + struct.pack("<III", width, len(records), len(mph.levels)) + b"".join(struct.pack("<I", len(x)) for x in mph.levels)
    return head + b"".join(x.astype("<u8").tobytes() for x in mph.levels) + slots.tobytes()


class Shard:
    """A shard's two files, read back; ``get`` is keyed access, ``records`` the keys in file order."""

    def __init__(self, payload: bytes, index: bytes):
        if index[:8] != MAGIC:
            raise ValueError("not an index file")
        width, n, n_levels = struct.unpack_from("<III", index, 8)
        sizes = struct.unpack_from(f"<{n_levels}I", index, 20)
        at, levels = 20 + 4 * n_levels, []
        for k in sizes:
            levels.append(np.frombuffer(index, "<u8", k, at))
            at += 8 * k
        self.ids = np.frombuffer(payload, f"<u{width}")
        self.mph, self.slots = PerfectHash(levels), np.frombuffer(index, RECORD, n, at)

    def find(self, doc_id: np.ndarray, null: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 where the fingerprint says that a key is not here."""
        h = key_hash(doc_id, null, occurrence)
        slots = self.mph.slots(h)
        if len(self.slots):
            slots[self.slots["print"][slots] != (h >> np.uint64(32)).astype(np.uint32)] = -1
        return slots

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of a document, or None."""
        slot = self.find(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([occurrence]))[0]
        if slot < 0:
            return None
        r = self.slots[slot]
        return self.ids[r["start"] : r["start"] + r["count"]]

    def records(self) -> np.ndarray:
        return self.slots[np.argsort(self.slots["record"])]


# --- encoding -------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Lower-case letters of Latin-1, as bytes; a full stop or comma after one, at a word's end, is a pre-token of its own.
LETTERS = bytes([*range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)])
NUMBERS = bytes([*range(48, 58), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE])
PRE_TOKEN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[" + LETTERS + rb"]+|[" + NUMBERS + rb"]|[^\x09-\x0D\x20\x85\xA0" + LETTERS + NUMBERS + rb"]+")
POINT = re.compile(rb"[.,](?<=[" + LETTERS + rb"][.,])(?=[ \t-\r]|\Z)")

#: The normaliser and pre-tokeniser of a lower-casing tokenizer with word ends, for which all of this is exact.
WORD_STYLE = (
    [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)],
    [("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), ("ByteLevel", None)],
)


def word_style(path: str) -> bool:
    """Whether a tokenizer file is of that style, special tokens without white space around them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pattern = lambda x: (x.get("pattern") or {}).get("Regex")
    parts = tuple([(x["type"], pattern(x)) for x in (spec[k] or {}).get(m, [])] for k, m in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or "<|" not in t["content"] or t["content"].split() != [t["content"]] for t in spec["added_tokens"])
    return parts == WORD_STYLE and plain and spec["model"]["type"] == "BPE" and bool(spec["model"].get("end_of_word_suffix")) and not spec["model"].get("dropout")


WHITE, LETTER = np.zeros(256, bool), np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LETTER[list(LETTERS)] = True
AT_ONCE = 20_000


class Encoder:
    """Texts as raw id bytes, the end id appended.

    Texts of Latin-1 characters without a special token are lower-cased here and cut at white space, and points are split off; all of a batch
    become one Arrow array, whose distinct chunks are encoded once. Chunks of letters go through the library's merges together, and their ids are
    cut apart at the tokens that end a word; other chunks go to the library together too, cut apart by their numbers of pre-tokens.
    Texts of other alphabets go chunk by chunk as they are.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.chunked = tokenizer(path), word_style(path)
        self.width = 2 if max(self.tok.get_vocab_size(True), end_id + 1) <= 1 << 16 else 4
        self.type = np.dtype(f"<u{self.width}")
        self.end = np.array([end_id], self.type).tobytes()
        if self.chunked:
            self.merges = Tokenizer(self.tok.model)
            self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary, suffix = self.tok.get_vocab(), self.tok.model.end_of_word_suffix
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _ids(self, tok, text: str) -> np.ndarray:
        return np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)

    def _letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks of letters, one after the other, and how many each has."""
        at, data = _binary(words)
        ids = [self._ids(self.merges, data[at[i] : at[min(i + AT_ONCE, len(words))]].tobytes().decode("latin-1")) for i in range(0, len(words), AT_ONCE)]
        flat = np.concatenate([*ids, np.zeros(0, self.type)])
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != len(words):
            raise ValueError("chunks and word ends differ")
        return flat, np.diff(ends, prepend=0)

    def _mixed(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for other chunks of Latin-1."""
        counts = np.array([len(PRE_TOKEN.findall(c.encode("latin-1"))) for c in chunks], np.int64)
        flat = np.concatenate([*(self._ids(self.tok, " ".join(chunks[i : i + AT_ONCE])) for i in range(0, len(chunks), AT_ONCE)), np.zeros(0, self.type)])
        ends, at = np.concatenate([[0], np.flatnonzero(self.last[flat]) + 1]), np.cumsum(counts)
        if len(at) and len(ends) - 1 != at[-1]:
            each = [self._ids(self.tok, c) for c in chunks]
            return np.concatenate(each), np.array([len(x) for x in each])
        return flat, np.diff(ends[at], prepend=0)

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks in some order; for each chunk where its ids start, and how many it has."""
        at, data = _binary(chunks)
        plain = np.add.reduceat(~LETTER[data], at[:-1]) == 1  # but for the space at its end
        ids, n = self._letters(chunks.filter(pa.array(plain)))
        others, m = self._mixed([c[:-1].decode("latin-1") for c in chunks.filter(pa.array(~plain)).to_pylist()])
        sizes = np.empty(len(chunks), np.int32)
        sizes[plain], sizes[~plain] = n, m
        starts = np.empty(len(chunks), np.int32)
        starts[plain], starts[~plain] = np.cumsum(n) - n, np.cumsum(m) - m + len(ids)
        return np.concatenate([ids, others]), starts, sizes

    def _latin(self, texts: list[bytes]) -> list[bytes]:
        """Lower-cased Latin-1 texts, all at once."""
        texts = [POINT.sub(rb" \g<0>", t) + b" " for t in texts]
        data = np.frombuffer(b"".join(texts), np.uint8)
        white = WHITE[data]
        keep = ~white
        keep[1:] |= keep[:-1].copy()  # the first white space after a chunk ends it, the rest goes
        begins = np.cumsum([0, *(len(t) for t in texts[:-1])])
        ends = np.cumsum(np.add.reduceat(keep.view(np.uint8), begins, dtype=np.int64))
        del texts
        data = data[keep]
        cuts = np.flatnonzero(WHITE[data]).astype(np.int32) + np.int32(1)
        del keep, white
        if not len(cuts):
            return [self.end] * len(ends)
        at = np.concatenate([np.zeros(1, np.int32), cuts])
        coded = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        flat, starts, sizes = self._distinct(coded.dictionary)
        which = coded.indices.to_numpy()
        del coded, data
        n = sizes[which]
        upto = np.concatenate([np.zeros(1, np.int32), np.cumsum(n, dtype=np.int32)])
        place = np.repeat(starts[which] - upto[:-1], n)
        place += np.arange(len(place), dtype=np.int32)
        raw = flat[place].tobytes()
        del place
        bounds = (upto[np.searchsorted(cuts, ends, side="right")] * self.width).tolist()
        return [raw[a:b] + self.end for a, b in zip([0, *bounds], bounds, strict=False)]

    def _other(self, texts: list[str]) -> list[bytes]:
        split = [t.encode().split() for t in texts]
        chunks = list(set().union(*split))
        ids = {c: np.array(e.ids, self.type).tobytes() for c, e in zip(chunks, self.tok.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False), strict=True)}
        return [b"".join([ids[c] for c in x]) + self.end for x in split]

    def batch(self, texts: list[str]) -> list[bytes]:
        if not self.chunked:
            return [np.array(e.ids, self.type).tobytes() + self.end for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        latin, other, out = [], [], [b""] * len(texts)
        for i, t in enumerate(texts):
            try:
                if "<|" in t:
                    raise ValueError
                latin.append((i, t.lower().encode("latin-1")))
            except ValueError:  # UnicodeEncodeError is one
                other.append((i, t))
        for rows, encode in ((latin, self._latin), (other, self._other)):
            for (i, _), x in zip(rows, encode([x for _, x in rows]) if rows else [], strict=True):
                out[i] = x
        return out


def _binary(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0, and bytes, of a binary array without nulls."""
    if not len(x):
        return np.zeros(1, np.int32), np.zeros(0, np.uint8)
    _, at, data = x.buffers()
    at = np.frombuffer(at, np.int32)[x.offset : x.offset + len(x) + 1]
    return at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]]


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


# --- writing and reading --------------------------------------------------------------------------------------------

MANIFEST = "shard int, path string, n_docs long, n_tokens long"


def _put(uri: str, parts: Iterable[bytes]) -> None:
    where, path = fs.FileSystem.from_uri(uri)
    with where.open_output_stream(path) as out:
        for x in parts:
            out.write(x)


def _read(uri: str) -> bytes:
    where, path = fs.FileSystem.from_uri(uri)
    with where.open_input_stream(path) as f:
        return f.read()


def _groups(batches: Iterator[pa.RecordBatch], ids: list[int | None]) -> Iterator[list[str]]:
    """The texts in runs of ``BATCH_CHARS`` characters or one text more; their ids go to ``ids``. A batch is decoded text by text."""
    held, chars = [], 0
    for b in batches:
        ids += b["doc_id"].to_pylist()
        for x in b["text"]:
            held.append(x.as_py() or "")
            chars += len(held[-1])
            if chars > BATCH_CHARS:
                yield held
                held, chars = [], 0
    if held:
        yield held


def _write_shard(folder: str, path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id)
        ids, counts = [], []

        def encoded(texts: list[str]) -> bytes:
            raw = enc.batch(texts)
            counts.extend([len(x) // enc.width for x in raw])
            return b"".join(raw)

        parts = map(encoded, _groups(batches, ids))
        first = next(parts, None)
        if first is None:
            return
        name = f"{folder}/shard-{uuid.uuid4().hex}"
        _put(f"{name}.bin", chain([first], parts))
        records = np.zeros(len(ids), RECORD)
        records["doc_id"], records["null"], records["record"] = [d or 0 for d in ids], [d is None for d in ids], np.arange(len(ids))
        again = np.zeros(len(ids), bool)
        again[1:] = (records["doc_id"][1:] == records["doc_id"][:-1]) & (records["null"][1:] == records["null"][:-1])
        records["occurrence"] = np.arange(len(ids)) - np.maximum.accumulate(np.where(again, 0, np.arange(len(ids))))
        records["count"] = counts
        records["start"][1:] = np.cumsum(records["count"][:-1], dtype=np.int64)
        hashes = key_hash(records["doc_id"], records["null"], records["occurrence"])
        records["print"] = hashes >> np.uint64(32)
        _put(f"{name}.idx", [index_bytes(hashes, records, enc.width)])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([int(records["count"].sum())], pa.int64())], ["shard", "path", "n_docs", "n_tokens"])

    return write


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, shard_bytes: int = 24 << 20) -> DataFrame:
    """Writes the shards; returns the manifest ``shard, path, n_docs, n_tokens, first`` (ids of all shards before).

    ``shard_bytes``: text of a shard on average; a task that writes holds ``BATCH_CHARS`` of it, one that reads holds its ids.
    """
    small_batches(docs.sparkSession)
    folder = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    _, size = extent(docs, "text")
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(pieces(size, shard_bytes, 12), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(rows.mapInArrow(_write_shard(folder, tokenizer_path, end_id), MANIFEST), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, first in zip(b["path"].to_pylist(), b["first"].to_pylist(), strict=True):
            shard = Shard(_read(f"{name}.bin"), _read(f"{name}.idx"))
            keys = shard.records()
            slots = shard.find(keys["doc_id"], keys["null"], keys["occurrence"])
            if (slots < 0).any():
                raise ValueError(f"{name}: a key is not in its index")
            found = shard.slots[slots]
            crc = [zlib.crc32(shard.ids[s : s + n].astype("<u4").tobytes()) for s, n in zip(found["start"].tolist(), found["count"].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys["doc_id"], mask=keys["null"] == 1), pa.array(found["start"] + first, pa.int64()), pa.array(found["count"].astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files, through their indexes."""
    small_batches(manifest.sparkSession)
    n = max(1, manifest.count())
    return manifest.select("path", "first").repartition(n).mapInArrow(_read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")
