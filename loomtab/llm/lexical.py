"""Ranked lexical search: every document scored against each item of a stated query set.

``index`` writes the postings, a row for each document and term that it holds, as a table of term buckets: a bucket is a folder, its files are sorted by term, so a search reads
only the buckets of its terms and, in them, the row groups. Documents are dealt over a bucket's files by their text, so a frequent term is never in one task. The table also has the
corpus' counts of documents and terms, a row for each task's part. Texts are read once; where all that will be asked is known, and its terms are few enough to be broadcast,
the index holds these terms alone.

``search`` joins the items' terms to the postings, scores each match in integers, sums by item and document, and numbers the best by a window. Postings are
dealt by document before that join: a match for each item of a frequent term never moves, a document's sums are complete in its task, and what leaves the task is ``k``
rows of each item. Items are taken in blocks of about ``block_pairs`` terms, which bounds what is broadcast; their results don't depend on each other, so any number of items is exact.

Results: null texts, and texts without a term, have no postings and don't count as documents. Rows are documents of their own, also those that share a ``doc_id`` or
are equal: each is ranked. Rows of one ``item_id`` are one item with all their terms, null too; an item without a term, or whose terms no document holds, has
no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import ascii_lower, extent, pieces, small_batches, utf8, written

#: Terms are runs of digits, letters and all beyond ASCII, after A-Z are lower-cased: fixed by the contract.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Term buckets; bytes of text to a file of each bucket; terms that an index is narrowed to by a broadcast; item terms of one broadcast.
BUCKETS, FILE_BYTES, KNOWN_TERMS, BLOCK_PAIRS = 16, 256 << 20, 200_000, 500_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``: each item's terms, once each."""
    return items.select("item_id", F.explode(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))).alias("term")).distinct()


def _postings(known: Broadcast | None, salts: int):
    """A row for each term of a document; ``row`` tells documents apart. A task's last row has no term: the documents and terms that it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, row, documents, length = known and known.value, TaskContext.get().partitionId() << 36, 0, 0
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        names, none = ["term", "row", "n", "tf", "salt", "doc_id"], None
        for b in batches:
            owner, columns = [], [[], [], [], [], []]
            none = b["doc_id"].slice(0, 0) if none is None else none
            for i, x in enumerate(utf8(b["text"])):
                found, row = terms_of(x), row + 1
                documents, length = documents + bool(found), length + len(found)
                count = Counter(found)
                held = list(count if only is None else only & count.keys())
                owner += [i] * len(held)
                for column, values in zip(columns, ([t.decode() for t in held], [row] * len(held), [len(found)] * len(held), [count[t] for t in held], [xxh64_intdigest(x) % salts] * len(held)), strict=True):
                    column += values
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds), b["doc_id"].take(pa.array(owner, pa.int32()))], names)
        if none is not None:
            yield pa.RecordBatch.from_arrays([*[pa.array([v], k) for v, k in zip((None, row, length, documents, 0), kinds, strict=True)], pa.nulls(1, none.type)], names)

    return run


def index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Written postings ``term, row, n, tf, doc_id, bucket`` of all terms, or of those of ``terms``, and the corpus' counts."""
    small_batches(docs.sparkSession)
    known = None
    if terms is not None:
        few = terms.select("term").distinct().limit(KNOWN_TERMS + 1).toArrow()["term"]  # bounded; beyond it all terms are indexed
        known = docs.sparkSession.sparkContext.broadcast(frozenset(utf8(few))) if len(few) <= KNOWN_TERMS else None
    salts = pieces(extent(docs, "text")[1], FILE_BYTES)
    found = docs.select("doc_id", "text").mapInArrow(_postings(known, salts), f"term string, row long, n long, tf long, salt int, doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    bucketed = found.withColumn("bucket", bucket(F.col("term"))).repartition(salts * BUCKETS, "bucket", "salt").drop("salt").sortWithinPartitions("bucket", "term")
    return written(bucketed, "postings", "bucket")


def bucket(term):
    return F.coalesce(F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int"), F.lit(-1))


def _block(postings: DataFrame, pairs: DataFrame, corpus: tuple[int, int], tasks: int, k: int) -> DataFrame:
    n_docs, length = corpus
    asked = [r[0] for r in pairs.select(bucket(F.col("term"))).distinct().collect()]  # at most BUCKETS
    held = postings.where(F.col("bucket").isin(asked))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0)))
    wanted = pairs.join(df, "term").select("item_id", "term", weight.alias("w"))
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {length}L")
    matches = held.repartition(tasks, "doc_id", "row").withColumn("m", m).join(F.broadcast(wanted), "term")  # a block: BLOCK_PAIRS rows
    scored = matches.groupBy("item_id", "doc_id", "row").agg(F.sum(F.expr("w * ((1000000000 * tf) div (1000 * tf + 20 * m))")).alias("score")).where("score > 0")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "row")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(postings: DataFrame, items: DataFrame, k: int = 50, block_pairs: int = BLOCK_PAIRS, task_rows: int = 500_000) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents of an ``index``."""
    pairs = item_terms(items)
    totals = postings.agg(F.sum(F.when(F.col("term").isNull(), F.col("tf"))), F.sum(F.when(F.col("term").isNull(), F.col("n"))), F.count("term")).first()
    corpus, tasks, n_blocks = (totals[0] or 0, totals[1] or 1), pieces(totals[2], task_rows), pieces(pairs.count(), block_pairs)
    of = F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(n_blocks))
    return reduce(DataFrame.union, [_block(postings, pairs.where(of == b) if n_blocks > 1 else pairs, corpus, tasks, k) for b in range(n_blocks)])


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
c AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(t)) AS BIGINT) AS ll FROM d WHERE len(t) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
m AS (SELECT r, doc_id, 50 + (50 * len(t) * nn) // ll AS m FROM d, c),
s AS (
  SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM b JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, doc_id, r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
