"""Toxicity by maximum-scoring segment search.

Learning. Over a bounded sample of labelled documents (``sample`` of them, those with the smallest hash of ``doc_id``), each
word gets the log-odds of its document frequencies in the two classes, with a Dirichlet prior in proportion to the word's
frequency in both, shrunk by ``r / (r + c)``: r is the word's likelihood ratio, c what is significant for the size of the vocabulary. So rare
words count a little, and all of them count. Words that come to next to nothing score as unknown ones: a small negative drift, so that the expected
score of clean text is negative.

Scoring. A linear-time scan finds every maximal scoring segment of a document: the passages whose score no extension or cut raises.
The maximum over clean text of n words follows an extreme-value law with rate ``lambda`` (the root of E[exp(lambda * s)] = 1 over clean
text) and location log(K n) / lambda; ``lambda * S - log(K n)`` makes documents of all lengths comparable, and passages above the
location are significant. A logistic fit of that excess and of the significant passages' number to the
sample's labels gives the score. Every word of every text counts; there are no prefixes.

Learning takes only labels with ``crc32(doc_id) mod 5`` other than 0. Inputs of a score are words alone.

Results: null text has no words; texts without any passage, empty ones included, are scored by their length alone, never above the location; several labels of a
``doc_id`` count as toxic if one is, and of rows that share one the smallest text is learnt from; null labels and null ``doc_id`` are not learnt from (a null ``doc_id`` counts as held out);
without labels of both classes every score is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import columns, small_batches, utf8, written
from .decontaminate import WORD_BYTES

SAMPLE, PRIOR, DRIFT = 20_000, 1.0, 0.05


class Model(NamedTuple):
    words: dict[bytes, float]
    drift: float
    rate: float
    location: float  # log K
    weights: tuple[float, float, float]  # of the excess, the number of passages, and the constant


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    Candidates are kept with the cumulative score before and at their end. A new positive score is a candidate of its own; as long
    as an earlier candidate begins lower than it and ends no higher, the two and all between become one.
    """
    open_: list[list[float]] = []  # start, end, left, right, nearest earlier candidate with a smaller left
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total, len(open_) - 1]
        while True:
            j = int(new[4])
            while j >= 0 and open_[j][2] >= new[2]:
                j = int(open_[j][4])
            if j < 0 or open_[j][3] >= new[3]:
                new[4] = j
                open_.append(new)
                break
            new = [open_[j][0], new[1], open_[j][2], new[3], open_[j][4]]
            del open_[j:]
    return [(int(c[0]), int(c[1]), c[3] - c[2]) for c in open_]


def passages(words: list[bytes], model: Model) -> list[tuple[int, int, float]]:
    """A document's maximal segments as word spans; runs of plain words between known ones are one step of the scan."""
    known = model.words
    if known.keys().isdisjoint(words):
        return []
    at = [i for i, w in enumerate(words) if w in known]
    scores, starts, last = [], [], 0
    for i in at:
        if i > last:
            scores.append(-model.drift * (i - last))
            starts.append(last)
        scores.append(known[words[i]])
        starts.append(i)
        last = i + 1
    starts.append(last)
    return [(starts[a], starts[b - 1] + 1, s) for a, b, s in maximal_segments(scores)]


def features(words: list[bytes], model: Model) -> tuple[float, float, list[tuple[int, int, float]]]:
    """Excess of the best passage over the extreme-value location, on a scale that is linear at 0 and logarithmic far from it; log of the number of significant passages, and those."""
    found = passages(words, model)
    location = max(0.0, model.location + math.log(len(words) + 1))  # so no text without passages is above it
    significant = [p for p in found if model.rate * p[2] > location]
    best = max((p[2] for p in found), default=0.0)
    return math.asinh(model.rate * best - location), math.log1p(len(significant)), significant


def _rate(steps: np.ndarray, probabilities: np.ndarray) -> float:
    """The positive root of E[exp(rate * step)] = 1 for steps of negative mean."""
    low, high = 0.0, 1.0
    mean = lambda x: float((probabilities * np.exp(np.minimum(x * steps, 500))).sum()) - 1
    while mean(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton steps on a slightly penalised logistic loss; each class has half of the weight."""
    x = np.column_stack([x, np.ones(len(x))])
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (each * (y - p)) - 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document and word counts by class, of each batch."""
    for b in batches:
        docs, words, n = (Counter(), Counter()), Counter(), [0, 0, 0]
        for x, label in zip(utf8(b["text"]), b["label"].to_pylist(), strict=True):
            found = x.translate(WORD_BYTES).split()
            docs[label].update(set(found))
            n[label] += 1
            if not label:
                words.update(found)
                n[2] += len(found)
        names = sorted(docs[0].keys() | docs[1].keys())
        rows = [(w, docs[0][w], docs[1][w], words[w]) for w in names] + [(None, *n)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3))], ["word", "clean", "toxic", "n"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model; at most ``sample`` labelled documents are read for it, which bounds the vocabulary too."""
    small_batches(docs.sparkSession)
    empty = Model({}, DRIFT, 1.0, 0.0, (0.0, 0.0, -1e9))
    ids = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "__id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).groupBy("__id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    rows = written(rows.select("text", "label"), "toxicity-sample")  # at most ``sample`` rows: the corpus is read once for learning
    counts = rows.mapInArrow(_count, "word binary, clean long, toxic long, n long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "n")])
    totals = counts.where("word IS NULL").first()
    if totals is None or not totals.clean or not totals.toxic:
        return empty
    c, t, n = totals.clean, totals.toxic, totals.n
    share = t / (c + t)
    prior = F.lit(PRIOR) * (F.col("clean") + F.col("toxic")) / (c + t) + 0.5
    odds = F.log((F.col("toxic") + prior * share) / (t + PRIOR + 0.5)) - F.log((F.col("clean") + prior * (1 - share)) / (c + PRIOR + 0.5))
    both = F.col("clean") + F.col("toxic")

    def term(k, of):
        return F.when(k > 0, k * F.log(k / (both * of))).otherwise(0.0)

    ratio = 2 * (term(F.col("toxic"), F.lit(share)) + term(F.col("clean"), F.lit(1 - share)))
    vocabulary = counts.where("word IS NOT NULL").count()
    known = counts.where(F.col("word").isNotNull()).select("word", (odds * ratio / (ratio + 2 * math.log(max(vocabulary, 2)) + 4)).alias("s"), "n").where(F.abs("s") > DRIFT).collect()
    words = {bytes(r.word): r.s for r in known}
    if not any(s > 0 for s in words.values()):
        return empty
    p = np.array([max(r.n, 0.5) / max(n, 1) for r in known])
    steps = np.array([*words.values(), -DRIFT])
    p = np.append(p, max(1 - p.sum(), 1e-6))
    if float((steps * p).sum()) >= 0:  # the drift has to outweigh known words in clean text
        steps[-1] = -(float((steps[:-1] * p[:-1]).sum()) / p[-1] + DRIFT)
    model = Model(words, -float(steps[-1]), _rate(steps, p), 0.0, (0.0, 0.0, 0.0))
    out = rows.mapInArrow(_measure(docs.sparkSession.sparkContext.broadcast(model)), "best double, n long, label int").toPandas()
    clean = out[out.label == 0]
    located = model.rate * clean.best - np.log(clean.n + 1)
    model = model._replace(location=float(located[clean.best > 0].quantile(0.5)) if (clean.best > 0).any() else 0.0)
    seen = rows.mapInArrow(_learn(docs.sparkSession.sparkContext.broadcast(model)), "x double, k double, label int").toPandas()
    return model._replace(weights=_logistic(seen[["x", "k"]].to_numpy(), seen.label.to_numpy()))


def _measure(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x.translate(WORD_BYTES).split() for x in utf8(b["text"])]
            best = [max((p[2] for p in passages(w, model.value)), default=0.0) for w in found]
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.float64()), pa.array([len(w) for w in found], pa.int64()), b["label"]], ["best", "n", "label"])

    return run


def _learn(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(x.translate(WORD_BYTES).split(), model.value) for x in utf8(b["text"])]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64()), b["label"]], ["x", "k", "label"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` in ``doc`` (all columns), with ``score`` and ``passages`` (start, end, score of the significant ones)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*columns(docs)).alias("doc"), docs["text"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores, found = [], []
            for x in utf8(b["text"]):
                excess, k, significant = features(x.translate(WORD_BYTES).split(), m)
                z = m.weights[0] * excess + m.weights[1] * k + m.weights[2]
                scores.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
                found.append([{"start": s, "end": e, "score": v} for s, e, v in significant])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b["doc"], pa.array(scores, pa.float64()), pa.array(found, kind)], ["doc", "score", "passages"])

    return rows.mapInArrow(run, StructType([rows.schema["doc"], *StructType.fromDDL("score double, passages array<struct<start:int,end:int,score:double>>").fields]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc, score, passages`` by a model learnt from ``labels (doc_id, toxic)``."""
    return score(docs, train(docs, labels, sample))


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc.doc_id", held_out("doc.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
