"""Token counts with a whole-token shortcut.

For a byte-level BPE tokenizer, ``prove`` finds offline, once on the driver, which vocabulary strings encode alone as one
token: each is put through the library by itself. The list is no longer than the vocabulary and is broadcast. Texts are split into pre-tokens here; those on the proven list count one
without any merging, and only the others go through the library's merges, each distinct one once while a bounded memo has it.

The pre-token pattern is the published one of byte-level BPE. Before it is used, its character classes are compared
with the library's own over every code point (in the same proof); a text with a code point on which the two differ goes
to the library whole. So does every text where the tokenizer is of another kind.
Strings of special tokens inside a text count as the library takes them by default: one token that splits the text.

Results: null text is empty and has no tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO, LONGEST = 300_000, 64


class Proof(NamedTuple):
    """What is known of a tokenizer before any text is seen; ``whole`` is None where the library has to do everything."""

    whole: frozenset[str] | None
    special: tuple[str, ...] = ()
    odd: str = ""  # a character class
    lowest_odd: str = ""


def _load(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _lengths(tok, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def _char_class(points: list[int]) -> str:
    """The code points as a class of ranges."""
    ends = [i for i, p in enumerate(points) if i + 1 == len(points) or points[i + 1] != p + 1]
    starts = [0, *(i + 1 for i in ends[:-1])]
    return "[" + "".join(f"\\U{points[i]:08x}-\\U{points[j]:08x}" for i, j in zip(starts, ends, strict=True)) + "]" if points else ""


@lru_cache(maxsize=4)
def prove(path: str) -> Proof:
    """Vocabulary strings that are one pre-token and one token, and code points on which the library's classes differ."""
    from tokenizers import Regex, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
    if not (plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec["normalizer"] is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")):
        return Proof(None)
    tok = _load(path)
    ids = sorted(tok.get_vocab(with_added_tokens=False).values())
    texts = [t for t in tok.decode_batch([[i] for i in ids], skip_special_tokens=False) if t and "\ufffd" not in t]
    whole = frozenset(t for t, n in zip(texts, _lengths(tok, texts), strict=True) if n == 1 and regex.fullmatch(PATTERN, t))
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    odd: set[str] = set()
    for cls in (r"\p{L}", r"\p{N}", r"\s"):
        theirs = pre_tokenizers.Split(Regex(cls + "+"), "removed", invert=True).pre_tokenize_str(every)
        odd |= set("".join(x for x, _ in theirs)) ^ set("".join(regex.findall(cls + "+", every)))
    return Proof(whole, tuple(sorted((t["content"] for t in added), key=len, reverse=True)), _char_class(sorted(map(ord, odd))), min(odd, default=""))


class WholeTokens:
    """Counts the tokens of texts as the tokenizers library gives them."""

    def __init__(self, path: str, proof: Proof):
        self.tok, self.proof = _load(path), proof
        if proof.whole is not None:
            self.pattern = regex.compile(PATTERN)
            self.odd = re.compile(proof.odd) if proof.odd else None
            self.split = re.compile("|".join(map(re.escape, proof.special))) if proof.special else None
            self.counts = dict.fromkeys(proof.whole, 1)

    def library(self, texts: list[str]) -> list[int]:
        return _lengths(self.tok, texts)

    def batch(self, texts: list[str]) -> list[int]:
        if self.proof.whole is None:
            return self.library(texts)
        if len(self.counts) > MEMO + len(self.proof.whole):
            self.counts = dict.fromkeys(self.proof.whole, 1)
        counts, out, whole_texts = self.counts, [0] * len(texts), []
        parts: list[tuple[int, list[str]]] = []
        for i, t in enumerate(texts):
            if self.odd and max(t, default="") >= self.proof.lowest_odd and self.odd.search(t):
                whole_texts.append(i)
                continue
            segments = self.split.split(t) if self.split else [t]
            out[i] = len(segments) - 1
            parts += [(i, self.pattern.findall(s)) for s in segments]
        new = list(set().union(*(p for _, p in parts)).difference(counts))
        fresh = dict(zip(new, self.library(new), strict=True))
        counts.update((k, v) for k, v in fresh.items() if len(k) <= LONGEST)
        look = counts if all(len(k) <= LONGEST for k in new) else counts | fresh
        for i, p in parts:
            out[i] += sum(map(look.__getitem__, p))
        for i, n in zip(whole_texts, self.library([texts[i] for i in whole_texts]), strict=True):
            out[i] = n
        return out


class Pieces:
    """The same for a sentencepiece model: the library alone."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def batch(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


_own: dict[str, WholeTokens | Pieces] = {}


def _cached(path: str, proof: Broadcast) -> WholeTokens | Pieces:
    """One counter for each worker process."""
    if path not in _own:
        _own.clear()
        _own[path] = Pieces(path) if path.endswith(".model") else WholeTokens(path, proof.value)
    return _own[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each document."""
    small_batches(docs.sparkSession)
    proof = docs.sparkSession.sparkContext.broadcast(None if tokenizer_path.endswith(".model") else prove(tokenizer_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _cached(tokenizer_path, proof)
        for b in batches:
            raw = utf8(b["text"])
            n = [k for i in range(0, len(raw), 256) for k in own.batch([x.decode() for x in raw[i : i + 256]])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(x) for x in raw], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
