"""A full-text index: postings with positions and documents as Parquet, ranked search by BM25.

Terms are maximal runs of letters, digits and underscores, lower-cased. An index is a folder of segments, each with its postings sorted by term, its documents and its
counts, and of numbered manifests that say which segments there are. A segment is written whole before a manifest names it, so a failed or running append
isn't seen; ``optimize`` puts all segments into one. A search reads the row groups of its terms alone (the terms are in the scan's filter), and the corpus' counts from the segments'.

Searches are words (documents with any of them), or made of ``Words``, ``Phrase``, ``Prefix``, ``All``, ``AnyOf`` and ``Without``. ``fieldboosts`` weighs fields' terms, and
leaves out fields that it doesn't name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import Table, as_table, col, method, session
from ..plans.shipping import ship

K1, B = 1.2, 0.75
#: Fields of documents whose words are grouped at once.
ROWS = 256


class Words(NamedTuple):
    """Documents with any of the words."""

    text: str


class Phrase(NamedTuple):
    """Documents with the words next to each other, in one field."""

    text: str


class Prefix(NamedTuple):
    """Documents with a word that begins so; each such word is scored as one of the search."""

    text: str


class All(NamedTuple):
    """Documents that every part finds."""

    parts: tuple[Any, ...]


class AnyOf(NamedTuple):
    """Documents that any part finds."""

    parts: tuple[Any, ...]


class Without(NamedTuple):
    """Documents of the first search that the second doesn't find."""

    kept: Any
    gone: Any


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def terms_of(text: str) -> list[str]:
    """The terms of a search, as those of documents are found."""
    return session().range(1).select(terms(F.lit(text)).alias("w")).first().w


def postings(df: DataFrame, docnum: str, fields: list[str]) -> DataFrame:
    """``term, doc, field, length, positions``: where each field has each term; ``length``: the document's terms."""
    none = F.array().cast("array<string>")
    words = df.select(col(docnum).alias("doc"), F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(terms(col(f)), none).alias("w")) for f in fields]).alias("fs"))
    words = words.withColumn("length", F.aggregate("fs", F.lit(0), lambda n, x: n + F.size(x["w"])))
    each = words.select("doc", "length", F.inline("fs")).where(F.size("w") > 0)
    schema = T.StructType([T.StructField("term", T.StringType()), *[each.schema[n] for n in ("doc", "field", "length")], T.StructField("positions", T.ArrayType(T.IntegerType(), False))])
    ship(df.sparkSession)
    return each.mapInArrow(_grouped, schema)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's words as a row for each term, with its positions: a document's terms are all in its row, so nothing is shuffled."""
    for batch in batches:
        for b in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
            words = b.column("w")
            begins, sizes = words.offsets.to_numpy()[:-1], np.diff(words.offsets.to_numpy())
            row = np.repeat(np.arange(len(words)), sizes)
            at = np.arange(len(row)) - np.repeat(begins - begins[0], sizes)
            each = pa.table({"row": row, "term": words.flatten(), "pos": at.astype(np.int32)})
            found = each.group_by(["row", "term"], use_threads=False).aggregate([("pos", "list")]).combine_chunks()  # in the words' order
            row, term, positions = (found[n].combine_chunks() for n in ("row", "term", "pos_list"))
            yield pa.RecordBatch.from_arrays([term, *[b.column(n).take(row) for n in ("doc", "field", "length")], positions], ["term", "doc", "field", "length", "positions"])


# --- segments -------------------------------------------------------------------------------------------------------


def _files(path: str):
    """The Hadoop file system of a path, and a function that makes paths below it."""
    spark = session()
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), lambda *parts: at("/".join([path, *parts]))


def _manifest(path: str) -> tuple[int, list[str]]:
    """The newest manifest that is whole: its number, and the names of its segments."""
    fs, at = _files(path)
    names = sorted((s.getPath().getName() for s in fs.globStatus(at("manifests", "*.json")) or []), reverse=True)
    for n in names:
        text = "".join(r.value for r in session().read.text(f"{path}/manifests/{n}").collect())
        if text.endswith("}"):
            return int(n.removesuffix(".json")), json.loads(text)["segments"]
    return 0, []


def _publish(path: str, version: int, segments: list[str]) -> None:
    """A manifest under its number; fails if another writer has taken it, so that none is lost."""
    fs, at = _files(path)
    out = fs.create(at("manifests", f"{version:08d}.json"), False)
    try:
        out.write(bytearray(json.dumps({"segments": segments}).encode()))
    finally:
        out.close()


def _segment(df: DataFrame, found: DataFrame, path: str) -> str:
    """Writes a segment of documents (with ``__doc``) and their postings; nothing refers to it yet."""
    name = uuid.uuid4().hex
    at = f"{path}/segments/{name}"
    found.repartitionByRange("term", "doc").sortWithinPartitions("term", "doc").write.parquet(f"{at}/postings")
    df.write.parquet(f"{at}/documents")
    first = F.col("positions")[0] == 0  # a row for each field of a document, not for each of its terms
    written = session().read.parquet(f"{at}/postings").where(first).select("doc", "length").distinct()
    written.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).coalesce(1).write.parquet(f"{at}/counts")
    return name


def _read(path: str, what: str) -> DataFrame:
    _, segments = _manifest(path)
    if not segments:
        raise FileNotFoundError(f"no text index at {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [session().read.parquet(f"{path}/segments/{s}/{what}") for s in segments])


def _add(t: Any, path: str, docnum: str, fields: list[str] | None, append: bool, optimize: bool = False) -> None:
    t = as_table(t)
    fields = fields or [f.name for f in t.df.schema if f.dataType.simpleString() == "string"]
    version, before = _manifest(path)
    new = _segment(t.df.withColumn("__doc", col(docnum)), postings(t.df, docnum, fields), path)
    _publish(path, version + 1, [*(before if append else []), new])
    if optimize and append and before:
        optimizetextindex(path)


@method
def totextindex(t: Table, path: str, docnum: str, fields: list[str] | None = None) -> None:
    """Indexes every row as a document, in place of what the index had; ``docnum`` is a unique field."""
    _add(t, path, docnum, fields, False)


@method
def appendtextindex(t: Table, path: str, docnum: str, fields: list[str] | None = None, optimize: bool = False) -> None:
    """Adds documents to an index; readers see all of them or none."""
    _add(t, path, docnum, fields, True, optimize)


def optimizetextindex(path: str) -> None:
    """All segments of an index as one."""
    version, segments = _manifest(path)
    if len(segments) > 1:
        _publish(path, version + 1, [_segment(_read(path, "documents"), _read(path, "postings"), path)])


def fromtextindex(path: str, docnum_field: str | None = None) -> Table:
    """All documents of an index."""
    df = _read(path, "documents")
    return Table(df.withColumnRenamed("__doc", docnum_field) if docnum_field else df.drop("__doc"))


# --- search ---------------------------------------------------------------------------------------------------------


class _Search:
    """An index's postings and counts, and the weights of its fields."""

    def __init__(self, path: str, fieldboosts: dict[str, float] | None):
        self.boosts = fieldboosts
        self.postings = _read(path, "postings")
        self.n, length = _read(path, "counts").agg(F.sum("documents"), F.sum("length")).first()
        self.mean = (length / self.n) if self.n else 1.0

    def weighed(self, found: DataFrame) -> DataFrame:
        """Postings of the fields that count, with how much an occurrence weighs."""
        if self.boosts is None:
            return found.withColumn("boost", F.lit(1.0))
        weights = [F.when(F.col("field") == f, F.lit(float(w))) for f, w in self.boosts.items()]
        return found.where(F.col("field").isin(list(self.boosts))).withColumn("boost", F.coalesce(*weights))

    def ranked(self, hits: DataFrame) -> DataFrame:
        """``doc, score`` by BM25 of ``term, doc, length, tf``, a row for each document of a term."""
        df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        idf = F.log(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(self.mean)))
        return hits.join(df, "term").groupBy("doc").agg(F.sum(idf * tf).alias("score"))

    def found(self, wanted: Column) -> DataFrame:
        hits = self.weighed(self.postings.where(wanted))
        return hits.groupBy("term", "doc", "length").agg(F.sum(F.size("positions") * F.col("boost")).alias("tf"))

    def phrase(self, words: list[str]) -> DataFrame:
        """``term, doc, length, tf`` of a phrase: positions at which each word stands in its place."""

        def shifted(k: int, w: str) -> Column:
            return F.transform(F.col("at").getItem(w), lambda p: p - k)

        place = [shifted(k, w) for k, w in enumerate(words)]
        hits = self.weighed(self.postings.where(F.col("term").isin(words)))
        fields = hits.groupBy("doc", "field", "length", "boost").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
        both = fields.where(F.size("at") == len(set(words))).withColumn("n", F.size(reduce(F.array_intersect, place))).where("n > 0")
        return both.groupBy("doc", "length").agg(F.sum(F.col("n") * F.col("boost")).alias("tf")).withColumn("term", F.lit(" ".join(words)))

    def scores(self, q: Any) -> DataFrame:
        """``doc, score`` of the documents that a search finds."""
        if isinstance(q, (All, AnyOf)):
            parts = [self.scores(p).withColumn("part", F.lit(k)) for k, p in enumerate(q.parts)]
            sums = reduce(DataFrame.union, parts).groupBy("doc").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))
            return sums.where(F.col("n") == (len(parts) if isinstance(q, All) else F.col("n"))).select("doc", "score")
        if isinstance(q, Without):
            return self.scores(q.kept).join(self.scores(q.gone).select("doc"), "doc", "left_anti")
        if isinstance(q, Prefix):
            return self.ranked(self.found(F.col("term").startswith("".join(terms_of(q.text)))))
        words = terms_of(q if isinstance(q, str) else q.text)
        if isinstance(q, Phrase) and len(words) > 1:
            return self.ranked(self.phrase(words))
        return self.ranked(self.found(F.col("term").isin(words)))


def searchtextindex(path: str, query: Any, limit: int | None = 10, docnum_field: str | None = None, score_field: str | None = None, offset: int = 0, fieldboosts: dict[str, float] | None = None) -> Table:
    """The best documents for a search: words, or one of the searches of this module."""
    best = _Search(path, fieldboosts).scores(query).orderBy(F.desc("score"), "doc")
    best = best.offset(offset) if offset else best
    best = best.limit(limit) if limit is not None else best
    docs = _read(path, "documents")
    out = docs.join(best, docs["__doc"] == best["doc"]).withColumn("__s", -F.col("score"))
    shown = [col(c) for c in docs.columns if c != "__doc"] + ([F.col("__doc").alias(docnum_field)] if docnum_field else []) + ([F.col("score").alias(score_field)] if score_field else [])
    return Table(Table(out, order=["__s", "doc"]).keep(*shown).frame)


def searchtextindexpage(path: str, query: Any, pagenum: int, pagelen: int = 10, **kwargs: Any) -> Table:
    """A page, from 1, of the ranked documents."""
    return searchtextindex(path, query, pagelen, offset=(pagenum - 1) * pagelen, **kwargs)
