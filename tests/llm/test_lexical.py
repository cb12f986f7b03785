"""Ranked lexical search against brute force and SQL."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomtab.llm import lexical, queries

from ..helpers import SF, matches

TEXTS = ["The cat, the CAT and the dog", "dog dog dog", "Ärger über Köln cat", None, "", "--- !!", "a" * 5000 + " cat", "cat dog", "cat dog", "bird 12 twelve", "İstanbul ümit", "cat " * 2000]


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in zip(ids or range(len(texts)), texts, strict=True)], "doc_id long, text string, term int, n int, bucket string, `a.b` string")


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "item_id long, text string, score int, row int")


def brute(docs, items, k=50):
    """(item, rank, doc_id, score) from (doc_id, text) and (item, text)."""
    terms = [(d, lexical.terms_of((t or "").encode())) for d, t in docs]
    held = [x for x in terms if x[1]]
    n, length = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(lexical.terms_of((t or "").encode()))
    out = []
    for i, words in asked.items():
        found = []
        for d, t in held:
            m = 50 + 50 * len(t) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * t.count(w) // (1000 * t.count(w) + 20 * m)) for w in words if w in df and w in t)
            if s > 0:
                found.append((-s, d is not None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


ITEMS = [(1, "CAT dog"), (2, "köln"), (3, None), (4, "nowhere"), (5, "the bird"), (1, "twelve"), (None, "cat")]


@pytest.mark.parametrize("narrow", [True, False])
def test_matches_brute_force(spark, narrow):
    docs, items = docs_of(spark, TEXTS).repartition(3), items_of(spark, ITEMS)
    index = lexical.index(docs, lexical.item_terms(items) if narrow else None)
    expected = brute(list(enumerate(TEXTS)), ITEMS)
    assert got(lexical.search(index, items)) == expected
    assert got(lexical.search(index, items, block_pairs=2, task_rows=3)) == expected
    assert got(lexical.search(index, items, k=1)) == [r for r in expected if r[1] == 1]


def test_random_corpora(spark):
    r = random.Random(4)
    texts = [" ".join(r.choices("abcdefghijklmnop", [k + 1 for k in range(16)], k=r.randrange(0, 30))) for _ in range(150)]
    rows = [(k, " ".join(r.sample("abcdefghijklmnopqr", 4))) for k in range(20)]
    index = lexical.index(docs_of(spark, texts).repartition(5))
    assert got(lexical.search(index, items_of(spark, rows), k=7)) == brute(list(enumerate(texts)), rows, 7)


def test_repeated_ids_and_rows(spark):
    texts, ids = ["cat one", "cat one", "cat two three", "cat", None, "dog"], [5, 5, 5, None, 5, 6]
    rows = [(1, "cat dog")]
    assert got(lexical.search(lexical.index(docs_of(spark, texts, ids)), items_of(spark, rows))) == brute(list(zip(ids, texts)), rows)


def test_empty_tables(spark):
    docs, items = docs_of(spark, TEXTS), items_of(spark, ITEMS)
    assert got(lexical.search(lexical.index(docs.where("false")), items)) == []
    assert got(lexical.search(lexical.index(docs, lexical.item_terms(items.where("false"))), items.where("false"))) == []
    assert got(lexical.search(lexical.index(docs_of(spark, [None, ""])), items)) == []


def test_index_is_bucketed_by_term_and_searches_read_their_buckets(spark):
    docs = docs_of(spark, [f"common w{k} v{k % 7}" for k in range(400)])
    index = lexical.index(docs)
    at = index.where("term is not null").select("term", "bucket").distinct()
    assert at.where(lexical.bucket(F.col("term")) != F.col("bucket")).count() == 0
    assert at.groupBy("term").count().where("count > 1").count() == 0
    assert at.select("bucket").distinct().count() == lexical.BUCKETS
    plan = lexical.search(index, items_of(spark, [(1, "w17")]))._jdf.queryExecution().executedPlan().toString()
    own = next(iter(at.where("term = 'w17'").collect())).bucket
    assert all(f"{own}" in part[:80] and "INSET" not in part[:80] for part in plan.split("PartitionFilters: [")[1:] if "bucket" in part[:80])
    assert sum("bucket" in part[:80] for part in plan.split("PartitionFilters: [")[1:]) == 2


def test_one_document_is_in_one_task_and_no_match_moves(spark):
    """The plan shuffles postings, then only what the first limit leaves."""
    docs = docs_of(spark, [f"common w{k}" for k in range(50)])
    plan = lexical.search(lexical.index(docs), items_of(spark, [(1, "common w3")]), task_rows=10)._jdf.queryExecution().executedPlan().toString()
    top, below = plan.split("HashAggregate(keys=[item_id", 1)
    assert "WindowGroupLimit" in top and top.count("Exchange hashpartitioning(item_id") == 1
    assert "Exchange hashpartitioning(doc_id" in below and "Exchange hashpartitioning(item_id#" not in below.split("Exchange hashpartitioning(doc_id")[0]


def test_sql(spark):
    matches(queries.op12_lexical_search(spark, SF), lexical.ORACLE)
