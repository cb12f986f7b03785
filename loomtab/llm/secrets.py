"""Secret scans: known patterns, and a randomness test battery over the rest.

Base patterns have a fixed form: ``assign`` (a keyword set to a long value), ``access`` (an access-key id) and ``hex`` (a long hex run).

Other candidates are runs of the characters that encodings use. Padding (``=``) isn't part
of a run. The narrowest encoding that fits is inferred, the run becomes a
sequence of symbol values, and four tests ask whether it looks drawn at random: chi-squared uniformity over the alphabet (binned in its
order so that each bin expects four symbols, and binned by the kinds of symbols that words have many or few of: vowels, common and rare
consonants, capitals, others), Wald-Wolfowitz runs about the middle of the alphabet, and lag-1 serial
correlation. The smallest p-value counts, corrected for the number of tests (Tippett). Words and identifiers give small ones; random strings spread
evenly.

False-discovery control is by class of encoding and length (powers of two), as short runs say less: over all documents the
p-values of a class's distinct runs are counted in bins (copies count once), the number of random runs is bounded from the upper half (its count and
a standard error of it, so that a few runs don't condemn each other), and the lowest threshold is taken above
which at most ``rate`` of the runs are surely not random. Runs above it are ``random`` spans. No threshold is below the first edge: evenly drawn
strings are that uneven once in a thousand times. None is above ``CEILING``: it is the share of random strings that a threshold loses, so nine in ten
are found in any class, however many identifiers it has. What goes to the driver is the bins' counts: a few hundred numbers for any corpus.

A run with ``/``, ``-``, ``_`` or ``+`` may be a secret with words or path segments glued to it. Its parts are tested too: what is left without word-like
segments at either end, the parts between slashes, those between slashes and hyphens, and those between any of the four. A part is a
span where nothing around it in the same run is. Runs and parts have 16 characters at least, and a digit or both cases: letters of
one case can't be told from words by these tests at such lengths.

Results: null text is empty; empty text has no spans; a run within a base span isn't a candidate. Offsets are code points, end
exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from xxhash import xxh64_intdigest

from .common import small_batches, written

#: Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")

#: Shorter runs have under four symbols for each of four bins, and no test has power.
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST)
#: What glues words and path segments to a run, weakest bond first.
GLUE = (re.compile(r"[^/]+"), re.compile(r"[^/-]+"), re.compile(r"[^/_+-]+"))

#: Encodings, narrowest first: name, alphabet in order of value, and what a run has to contain.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("hex", DIGITS + "abcdef", (DIGITS, LOWER)),
    ("HEX", DIGITS + "ABCDEF", (DIGITS, UPPER)),
    ("base32", UPPER + "234567", (DIGITS, UPPER)),
    ("base36", DIGITS + LOWER, (DIGITS, LOWER)),
    ("BASE36", DIGITS + UPPER, (DIGITS, UPPER)),
    ("base52", UPPER + LOWER, (UPPER, LOWER)),
    ("base62", DIGITS + UPPER + LOWER, (DIGITS, UPPER, LOWER)),
    ("base64", UPPER + LOWER + DIGITS + "+/", (DIGITS, UPPER, LOWER)),
    ("base64url", UPPER + LOWER + DIGITS + "-_", (DIGITS, UPPER, LOWER)),
)
#: Consonants that words have many of, fixed values.
VOWELS, COMMON = "aeiou", "tnsrhldcm"
CEILING = 0.1


def _kinds(alphabet: str) -> np.ndarray:
    """The kind of each symbol of an alphabet: other, capital (where there are small letters too), vowel, common or rare consonant."""
    both = any(c.islower() for c in alphabet) and any(c.isupper() for c in alphabet)
    return np.array([0 if not c.isalpha() else 1 if both and c.isupper() else 2 if c.lower() in VOWELS else 3 if c.lower() in COMMON else 4 for c in alphabet])


KIND_OF = {name: _kinds(a) for name, a, _ in ENCODINGS}
_TABLES = [(name, frozenset(a), {c: i for i, c in enumerate(a)}, [frozenset(x) for x in need]) for name, a, need in ENCODINGS]
#: Lower edges of the bins of p-values but the first, which is never kept; closer where thresholds of a clear class lie.
EDGES = (0.001, 0.002, 0.005, 0.01, 0.02, *(k / 20 for k in range(1, 11)))


def infer(run: str) -> tuple[str, list[int], int] | None:
    """Encoding, symbol values and alphabet size of a run; None if it is of no encoding."""
    have = set(run)
    for name, alphabet, values, need in _TABLES:
        if have <= alphabet:
            return (name, [values[c] for c in run], len(alphabet)) if all(have & x for x in need) else None
    return None


def _chi_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared with ``k`` degrees, by Wilson and Hilferty."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)) if x > 0 else -9.0
    return 0.5 * math.erfc(z / math.sqrt(2))


def _uniformity(v: np.ndarray, bin_of: np.ndarray) -> float:
    """p-value of the chi-squared test for symbols ``v`` drawn evenly, counted by the bin of each."""
    share = np.bincount(bin_of) / len(bin_of)
    counts = np.bincount(bin_of[v], minlength=len(share))
    have = share > 0
    expected = len(v) * share[have]
    return _chi_tail(float(((counts[have] - expected) ** 2 / expected).sum()), len(expected) - 1)


def battery(values: list[int], size: int, kinds: np.ndarray | None = None) -> float:
    """Joint p-value of the tests for ``values`` being drawn evenly from 0..size-1; ``kinds``: each symbol's."""
    v, n = np.array(values), len(values)
    bins = max(2, min(size, n // 4))
    p = [_uniformity(v, np.arange(size) * bins // size)]
    if kinds is not None:
        p.append(_uniformity(v, kinds))
    high = v * 2 >= size
    a, b = int(high.sum()), int((~high).sum())
    if a and b and n > 2:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * a * b / n
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        p.append(math.erfc(abs(runs - mean) / spread / math.sqrt(2)))
    else:
        p.append(2.0 ** (1 - n))
    d = v - v.mean()
    p.append(math.erfc(abs(float((d[1:] * d[:-1]).sum() / (d * d).sum())) * math.sqrt(n) / math.sqrt(2)) if d.any() else 2.0 ** (1 - n))
    return -math.expm1(len(p) * math.log1p(-min(*p, 1 - 1e-16)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if ":" in text or "=" in text else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def parts(run: str) -> list[tuple[int, int]]:
    """(start, end) of a run and of its parts, each before those within it; any two are nested or apart."""
    out = {(0, len(run)): None}
    segments = [m.span() for m in GLUE[0].finditer(run)]
    odd = [(a, b) for a, b in segments if infer(run[a:b])]
    if odd:
        out[odd[0][0], odd[-1][1]] = None
    for glue in GLUE:
        out.update(dict.fromkeys(m.span() for m in glue.finditer(run)))
    return [(a, b) for a, b in out if b - a >= LEAST]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[list[dict]]:
    """Runs of an encoding outside base spans, each a list of itself and its parts with their classes and bins of p-values."""
    out, starts, ends = [], [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for m in CANDIDATE.finditer(text):
        found = []
        for a, b in parts(m[0]):
            start, end, run = m.start() + a, m.start() + b, m[0][a:b]
            before = bisect_left(starts, end)
            if before and ends[before - 1] > start:
                continue
            if fits := infer(run):
                name, values, size = fits
                found.append({"start": start, "end": end, "class": f"{name}/{len(run).bit_length()}", "run": xxh64_intdigest(run.encode()) - (1 << 63), "bin": bisect_right(EDGES, battery(values, size, KIND_OF[name]))})
        if found:
            out.append(found)
    return out


def thresholds(bins: dict[tuple[str, int], int], rate: float) -> dict[str, int]:
    """For each class the lowest bin from which on at most ``rate`` of the distinct runs surely aren't random, or that of ``CEILING``."""
    out = {}
    for name in {c for c, _ in bins}:
        counts = np.array([bins.get((name, b), 0) for b in range(len(EDGES) + 1)], float)
        even = (counts[-1] + 0.5 + math.sqrt(counts[-1] + 0.25)) / (1 - EDGES[-1])  # random runs for a width of 1, at most
        for b, edge in enumerate(EDGES, 1):
            kept = counts[b:].sum()
            if kept - even * (1 - edge) <= rate * kept or edge >= CEILING:
                out[name] = b
                break
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    run = pa.list_(pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.string()), ("run", pa.int64()), ("bin", pa.int32())])))
    for b in batches:
        base, runs = [], []
        for t in b["text"].to_pylist():
            base.append(base_spans(t or ""))
            runs.append(candidates(t or "", base[-1]))
        sha = [hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in x).encode()).hexdigest() for x in base]
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in base], span), pa.array(sha), pa.array(runs, run)], ["doc_id", "base", "base_sha256", "runs"])


def outermost(run: list[dict], lowest: dict[str, int]) -> list[dict]:
    """The parts of a run that pass, without those inside another that does: parts lie in each other or apart, so one pass in order of start tells."""
    out, end = [], -1
    for r in sorted((r for r in run if r["bin"] >= lowest.get(r["class"], len(EDGES) + 1)), key=lambda r: (r["start"], -r["end"])):
        if r["end"] > end:
            out.append(r)
            end = r["end"]
    return out


def _passed(lowest: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            more = [[{"start": r["start"], "kind": 3, "end": r["end"]} for x in runs for r in outermost(x, lowest)] for runs in b["runs"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["base"], b["base_sha256"], pa.array(more, b.schema.field("base").type)], ["doc_id", "base", "base_sha256", "more"])

    return run


def scan(docs: DataFrame, rate: float = 0.1) -> DataFrame:
    """``doc_id, base_sha256, found``: every span as (start, kind, end), kind an index of ``KINDS``, in order."""
    small_batches(docs.sparkSession)
    columns = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base array<struct<start:long,kind:int,end:long>>, base_sha256 string, runs array<array<struct<start:long,end:long,class:string,run:long,bin:int>>>"
    rows = written(docs.select("doc_id", "text").mapInArrow(_scan, columns), "secret-candidates")
    distinct = rows.select(F.explode(F.flatten("runs")).alias("r")).select("r.class", "r.run", "r.bin").distinct()
    lowest = thresholds({(r["class"], r.bin): r["count"] for r in distinct.groupBy("class", "bin").count().collect()}, rate)
    kept = rows.mapInArrow(_passed(lowest), StructType([*rows.drop("runs").schema.fields, StructField("more", rows.schema["base"].dataType)]))
    return kept.select("doc_id", "base_sha256", F.array_sort(F.concat("base", "more")).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    def count(k: int):
        return F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")

    names = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base_sha256", spans.alias("spans"))
