"""TIFF columns: texts or other bytes stored as pages, and any TIFF walked and decoded.

``encode`` writes 8-bit grey pages of ``width`` samples a row in either byte order: strips or tiles, raw, PackBits, LZW or deflate, with
horizontal differencing or without. ``to_media`` chooses among these by a hash of the payload, so a corpus holds all of them.
``directories`` follows the chain of image directories and takes strips and tiles, uncompressed, PackBits, LZW or deflate,
with no predictor or horizontal differencing, samples of 1 to 32 bits, any number of samples a pixel, and chunky or separate planes.
``pages`` gives one row per page; ``media_digest`` puts payloads together again from these rows, which come in order within a partition.

A strip or tile is expanded to the size that its directory says and no further, and only if its stored bytes can hold that much.

Results: null text is empty; an empty payload is padded like any other. Equal texts give equal bytes. Damaged directories give
rows with the error, whatever the damage, and intact ones beside them their pages; ``decode`` and ``media_digest`` raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8

UNIT, WIDTH, PAGE_ROWS, STRIP_ROWS = 576, 576, 4096, 64
#: A file's choices, by bits of its payload's hash.
PAGES_OF, TILES = (2, 4, 16, 64), (None, None, (16, 32), (32, 192))

#: Field types of the TIFF 6.0 specification, fixed values: type -> (struct code, bytes).
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8)}

#: Tags, fixed values.
TAG = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strips": 273, "samples": 277, "rows": 278, "strip_sizes": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tiles": 324, "tile_sizes": 325}
RAW, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
CODECS = (DEFLATE, DEFLATE, DEFLATE, DEFLATE, DEFLATE, PACKBITS, LZW, RAW)
#: The most bytes that one stored byte expands to, above what each format allows (deflate 1032, LZW 4096 / 1.125, PackBits 64).
GROWTH = {RAW: 1, DEFLATE: 1033, DEFLATE_OLD: 1033, LZW: 3700, PACKBITS: 128}


class Page(NamedTuple):
    width: int
    height: int
    compression: int
    predictor: int
    samples: np.ndarray  # height, width, samples a pixel


# --- codecs ---------------------------------------------------------------------------------------------------------


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 - (n == 128)
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more as runs, all else as literals."""
    v = np.frombuffer(data, np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1, [len(v)]]) if len(v) else np.zeros(1, np.int64)
    long_ = np.flatnonzero(np.diff(edges) >= 3)
    out, last = bytearray(), 0

    def literals(upto: int) -> None:
        for i in range(last, upto, 128):
            part = data[i : min(i + 128, upto)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, end in zip(edges[long_].tolist(), edges[long_ + 1].tolist(), strict=True):
        literals(start)
        for i in range(start, end, 128):
            n = min(128, end - i)
            out += bytes([257 - n if n > 1 else 0, data[i]])
        last = end
    literals(len(data))
    return bytes(out)


#: Width of the j-th code after a clear code: 9 to 12 bits, grown one code early, as TIFF has it.
LZW_LAST = 4093 - 258
LZW_WIDTHS = np.array([9 + (k > 511) + (k > 1023) + (k > 2047) for k in range(258, 258 + LZW_LAST + 2)], np.int64)
LZW_FROM = np.concatenate([[0], np.cumsum(LZW_WIDTHS)])
FRESH = [bytes([i]) for i in range(256)] + [b"", b""]


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first. Where each code after a clear code begins is known beforehand."""
    wide = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    at, end, done, out = 0, len(data) * 8, 0, []
    while at + 9 <= end and done < size:
        n = int(np.searchsorted(LZW_FROM[1:], end - at, side="right"))  # codes that fit; a longer table is no code's
        begins, widths = at + LZW_FROM[:n], LZW_WIDTHS[:n]
        i = begins >> 3
        codes = ((wide[i] << 24 | wide[i + 1] << 16 | wide[i + 2] << 8 | wide[i + 3]) >> (32 - (begins & 7) - widths)) & ((1 << widths) - 1)
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        stop = int(stops[0]) if len(stops) else n
        table, last = list(FRESH), b""
        for code in codes[:stop].tolist():
            if code < len(table):
                entry = table[code]
            elif last and code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            out.append(entry)
            done += len(entry)
            if done >= size:
                return b"".join(out)
            if last:
                table.append(last + entry[:1])
            last = entry
        if stop == n or codes[stop] == 257:
            break
        at = int(begins[stop] + widths[stop])
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, breaks = [256], [0]  # a clear code starts a series of widths anew
    codes: dict[int, int] = {}
    following, word = 258, -1
    for byte in data:
        if word < 0:
            word = byte
            continue
        key = word << 8 | byte
        longer = codes.get(key)
        if longer is not None:
            word = longer
            continue
        out.append(word)
        codes[key] = following
        following += 1
        word = byte
        if following > 4093:
            breaks.append(len(out))
            out.append(256)
            codes, following = {}, 258
    if word >= 0:
        out.append(word)
    out.append(257)
    v = np.array(out, np.int64)
    since = np.arange(len(v)) - np.repeat(breaks, np.diff([*breaks, len(v)])) - 1
    widths = LZW_WIDTHS[since]
    widths[breaks[0]], widths[breaks[1:]] = 9, 12
    bits = np.unpackbits(v.astype(">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - widths[:, None]]).tobytes()


def _expand(data: bytes, compression: int, size: int) -> bytes:
    if compression == RAW:
        return data
    if compression in (DEFLATE, DEFLATE_OLD):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise ValueError(str(e)) from e
    if compression == LZW:
        return unpack_lzw(data, size)
    if compression == PACKBITS:
        return unpack_bits(data, size)
    raise ValueError(f"compression {compression}")


def compress(data: bytes, compression: int) -> bytes:
    return {RAW: lambda: data, DEFLATE: lambda: zlib.compress(data, 1), LZW: lambda: pack_lzw(data), PACKBITS: lambda: pack_bits(data)}[compression]()


# --- directories ----------------------------------------------------------------------------------------------------


def _following(data: bytes, at: int, order: str) -> int:
    """Where the directory after the one at ``at`` is; 0 after the last."""
    (n,) = struct.unpack_from(order + "H", data, at)
    return struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _fields(data: bytes, at: int, order: str) -> dict[int, tuple]:
    """A directory's fields."""
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in TYPES:
            continue
        code, size = TYPES[kind]
        where = at + 10 + 12 * i
        if size * count > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        if where + size * count > len(data):
            raise ValueError(f"tag {tag} lies beyond the file")
        fields[tag] = struct.unpack_from(order + (f"{count}s" if kind == 2 else code * count if len(code) > 1 else f"{count}{code}"), data, where)
    return fields


def _page(data: bytes, f: dict[int, tuple], order: str) -> Page:
    one = lambda name, default=None: f.get(TAG[name], (default,))[0]
    width, height, samples = one("width"), one("height"), one("samples", 1)
    bits, compression, predictor, planar = one("bits", 1), one("compression", RAW), one("predictor", 1), one("planar", 1)
    if not width or not height or bits not in (1, 2, 4, 8, 16, 32) or predictor not in (1, 2) or (predictor == 2 and bits < 8):
        raise ValueError(f"{width} x {height}, {bits} bit, predictor {predictor}")
    kind = np.dtype(f"{order}u{max(bits, 8) // 8}")
    if tiled := TAG["tiles"] in f:
        w, h, where, sizes = one("tile_width"), one("tile_height"), f[TAG["tiles"]], f[TAG["tile_sizes"]]
    else:
        w, h, where, sizes = width, min(one("rows", height), height), f[TAG["strips"]], f[TAG["strip_sizes"]]
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    across, down = -(-width // w), -(-height // h)
    if min(w, h, samples) < 1 or len(where) != planes * across * down:
        raise ValueError(f"{len(where)} strips or tiles of {w} x {h} for {width} x {height}")
    line = -(-w * deep * bits // 8)  # rows begin at whole bytes
    if any(start + size > len(data) for start, size in zip(where, sizes, strict=True)) or height * line > sum(sizes) * GROWTH.get(compression, 1):
        raise ValueError("a strip or tile is too short")
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k, (start, size) in enumerate(zip(where, sizes, strict=True)):
        plane, k = divmod(k, across * down)
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, height - y)
        raw = _expand(data[start : start + size], compression, rows * line)
        if len(raw) < rows * line:
            raise ValueError("a strip or tile is too short")
        if bits < 8:
            each = np.unpackbits(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line), axis=1)[:, : w * deep * bits]
            part = np.packbits(each.reshape(rows, w, deep, bits), axis=3)[..., 0] >> (8 - bits)
        else:
            part = np.frombuffer(raw, kind, rows * w * deep).reshape(rows, w, deep)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=out.dtype)
        part = part[: height - y, : width - x]
        out[y : y + len(part), x : x + part.shape[1], plane : plane + deep] = part
    return Page(width, height, compression, predictor, out)


def directories(data: bytes) -> Iterator[Page | ValueError]:
    """The page of each directory, or its error; directories after one that can't be passed are out of reach."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,), seen = struct.unpack_from(order + "I", data, 4), set()
    if not at:
        yield ValueError("no pages")
    while at:
        try:
            if at in seen:
                raise ValueError("directories form a loop")
            seen.add(at)
            here, at = at, 0
            at = _following(data, here, order)
            yield _page(data, _fields(data, here, order), order)
        except (ValueError, struct.error, LookupError, TypeError, ArithmeticError, MemoryError) as e:
            yield ValueError(str(e) or type(e).__name__)


def decode(data: bytes) -> list[Page]:
    """All pages of a file; the first error is raised."""
    pages = []
    for p in directories(data):
        if isinstance(p, ValueError):
            raise p
        pages.append(p)
    return pages


def _one_page(image: np.ndarray, base: int, compression: int, predictor: int, order: str, tile: tuple[int, int] | None) -> tuple[bytes, int, int]:
    """A page's strips or tiles, then its directory; where in the file that is, and where the next one's offset goes."""
    height, width = image.shape
    h, w = tile or (min(STRIP_ROWS, height), width)
    parts = []
    for y in range(0, height, h):
        for x in range(0, width, w):
            part = image[y : y + h, x : x + w]
            if tile and part.shape != tile:
                whole = np.zeros(tile, np.uint8)
                whole[: part.shape[0], : part.shape[1]] = part
                part = whole
            if predictor == 2:
                steps = part.copy()
                steps[:, 1:] -= part[:, :-1]
                part = steps
            parts.append(compress(part.tobytes(), compression))
    sizes = [len(p) for p in parts]
    body = b"".join(parts)
    body += b"\0" * (len(body) % 2)
    starts = (base + np.concatenate([[0], np.cumsum(sizes)[:-1]])).tolist()
    names = ("tiles", "tile_sizes") if tile else ("strips", "strip_sizes")
    fields = [("width", 4, [width]), ("height", 4, [height]), ("bits", 3, [8]), ("compression", 3, [compression]), ("photometric", 3, [1]), (names[0], 4, starts), ("samples", 3, [1]), (names[1], 4, sizes), ("predictor", 3, [predictor])]
    fields += [("tile_width", 4, [w]), ("tile_height", 4, [h])] if tile else [("rows", 4, [h])]
    fields.sort(key=lambda f: TAG[f[0]])
    at = base + len(body)
    extra_at, extra, rows = at + 2 + 12 * len(fields) + 4, b"", b""
    for name, kind, values in fields:
        value = struct.pack(order + TYPES[kind][0] * len(values), *values)
        if len(value) > 4:
            value, extra = struct.pack(order + "I", extra_at + len(extra)), extra + value
        rows += struct.pack(order + "HHI", TAG[name], kind, len(values)) + value.ljust(4, b"\0")
    directory = struct.pack(order + "H", len(fields)) + rows
    return body + directory + b"\0" * 4 + extra + b"\0" * (len(extra) % 2), at, at + len(directory)


def encode(payload: bytes, width: int = WIDTH, page_rows: int = PAGE_ROWS, compression: int = DEFLATE, predictor: int = 2, order: str = "<", tile: tuple[int, int] | None = None) -> bytes:
    """A payload of whole rows as a file of one or more pages."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for y in range(0, len(rows), page_rows):
        page, directory, following = _one_page(rows[y : y + page_rows], len(out), compression, predictor, order, tile)
        out += page
        struct.pack_into(order + "I", out, link, directory)
        link = following
    return bytes(out)


# --- Spark ----------------------------------------------------------------------------------------------------------


def padded(text: bytes) -> bytes:
    """The text and bytes 255 up to a positive multiple of 576."""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


class Feature:
    """Pages, rows, mean and deviation of all samples, share of padding, and mean step between neighbours, rounded."""

    def __init__(self):
        self.pages, self.rows, self.steps, self.n_steps, self.counts = 0, 0, 0, 0, np.zeros(256, np.int64)

    def add(self, rows: np.ndarray) -> None:
        steps = np.abs(np.diff(rows.astype(np.int16), axis=1))
        self.pages, self.rows, self.steps, self.n_steps = self.pages + 1, self.rows + len(rows), self.steps + int(steps.sum()), self.n_steps + steps.size
        self.counts += np.bincount(rows.ravel(), minlength=256)

    def __str__(self) -> str:
        n, levels = int(self.counts.sum()), np.arange(256)
        mean = float((self.counts * levels).sum() / n)
        deviation = float(np.sqrt((self.counts * (levels - mean) ** 2).sum() / n))
        return f"pages={self.pages};rows={self.rows};mean={mean:.4f};sd={deviation:.4f};pad={self.counts[255] / n:.4f};step={self.steps / max(1, self.n_steps):.4f}"


def chosen(payload: bytes) -> bytes:
    """The payload's file, of the codec, layout, page size, predictor and byte order that its hash says."""
    h = zlib.crc32(payload)
    tile = TILES[h >> 7 & 3]
    return encode(payload, WIDTH, max(PAGES_OF[h >> 3 & 3], tile[0] if tile else 1), CODECS[h & 7], 1 + (h >> 5 & 1), "<>"[h >> 6 & 1], tile)


def to_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text as a TIFF file."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b["text"])
            for i in range(0, len(texts), 512):
                part = texts[i : i + 512]
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, len(part)), pa.array([len(x) for x in part], pa.int64()), pa.array([chosen(padded(x)) for x in part], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def pages(media: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """One row per directory, a page or its error, and one per file that is no TIFF file.

    ``doc_id``, the columns ``carried``, ``page, width, height, samples, compression, predictor, data, error``, and of the file
    ``media_bytes, media_sha256``. A file's rows follow one another, page 0 first (null for no TIFF file).
    """
    own = ["doc_id", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, of, size = [], [], 0
            for i, m in enumerate(b["media"].to_pylist()):
                m = m or b""
                whole = (len(m), hashlib.sha256(m).hexdigest())
                try:
                    for k, p in enumerate(directories(m)):
                        held.append((k, *[None] * 6, str(p), *whole) if isinstance(p, ValueError) else (k, p.width, p.height, p.samples.shape[2], p.compression, p.predictor, p.samples.tobytes(), None, *whole))
                        of.append(i)
                        size += len(held[-1][6] or b"")
                        if size > PAGE_BATCH:
                            yield _page_rows(b, own, of, held)
                            held, of, size = [], [], 0
                except ValueError as e:
                    held.append((*[None] * 7, str(e), *whole))
                    of.append(i)
            if held:
                yield _page_rows(b, own, of, held)

    kinds = ", ".join(f"{c} {media.schema[c].dataType.simpleString()}" for c in own)
    return media.select(*own, "media").mapInArrow(run, f"{kinds}, {PAGE_COLUMNS}")


PAGE_COLUMNS = "page int, width int, height int, samples int, compression int, predictor int, data binary, error string, media_bytes long, media_sha256 string"
PAGE_BATCH = 4 << 20


def _page_rows(b: pa.RecordBatch, own: list[str], of: list[int], held: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int32()] * 6, pa.binary(), pa.string(), pa.int64(), pa.string()]
    columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*(b[c].take(pa.array(of)) for c in own), *columns], [*own, *(x.split()[0] for x in PAGE_COLUMNS.split(", "))])


def media_digest(found: DataFrame) -> DataFrame:
    """Per file, from its page rows: the payload's size and hashes, the file's, and the feature string. Rows have to come as ``pages`` gives them."""
    columns = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = [found.schema["doc_id"].dataType.simpleString(), "long"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, open_ = [], None

        def close() -> None:
            d, n, whole, size, sha, tail, seen = open_
            done.append((d, n, size, sha.hexdigest(), zlib.crc32(tail), *whole, str(seen)))

        def batch(t: pa.DataType) -> pa.RecordBatch:
            types = [t, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), types, strict=True)], ["doc_id", "n_bytes", *(x.split()[0] for x in columns.split(", "))])

        for b in batches:
            kind = b.schema.field("doc_id").type
            for r in b.to_pylist():
                if r["error"] is not None:
                    raise ValueError(r["error"])
                if r["page"] == 0:
                    if open_:
                        close()
                    open_ = [r["doc_id"], r["n_bytes"], (r["media_bytes"], r["media_sha256"]), 0, hashlib.sha256(), b"", Feature()]
                open_[3] += len(r["data"])
                open_[4].update(r["data"])
                open_[5] = (open_[5] + r["data"])[-32:]
                open_[6].add(np.frombuffer(r["data"], np.uint8).reshape(r["height"], -1))
            if done:
                yield batch(kind)
                done = []
        if open_:
            close()
            yield batch(kind)

    return found.mapInArrow(run, f"doc_id {kinds[0]}, n_bytes {kinds[1]}, {columns}")


def round_trip(docs: DataFrame) -> DataFrame:
    """Texts to files, and the files read back."""
    return media_digest(pages(to_media(docs), ["n_bytes"])).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("feature"))
