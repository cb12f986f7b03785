"""Columns with any names go through operators and stages; long runs of secrets in one pass."""

import random

import pytest

import corpus_pipeline
from loomtab.llm import decontaminate, mixing, secrets, similar, toxicity

from ..helpers import SF

EXTRA = ["a.b", "__k1", "__k2", "__id", "__none", "doc", "spans", "items", "score", "at", "tie", "src", "bucket", "size", "w`x"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(["alpha", "beta", "gamma", "idiot"], k=30)), "en", r.choice("st"), 1, *[f"v{k}" for k in range(len(EXTRA))]) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in EXTRA))


def whole(df, docs):
    assert df.columns == docs.columns
    for r in df.collect():
        assert [r[c] for c in EXTRA] == [f"v{k}" for k in range(len(EXTRA))]


def test_operators_keep_columns_of_any_name(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    whole(decontaminate.find_contamination(docs, items).select("doc.*"), docs)
    whole(toxicity.toxicity(docs, labels).select("doc.*"), docs)
    whole(mixing.mix_sources(docs).select("doc.*"), docs)
    first = similar.first_rows(docs)
    whole(first, docs)
    assert first.count() >= 1


def test_stages_keep_columns_of_any_name(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        whole(stage(spark, docs, SF), docs)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 30


def test_outermost_is_what_all_pairs_give():
    r = random.Random(3)
    lowest = {"x": 2}
    for _ in range(200):
        run = []

        def nest(a, b):
            if b - a < 2 or len(run) > 12:
                return
            run.append({"start": a, "end": b, "class": r.choice("xxy"), "bin": r.randrange(5)})
            cut = r.randrange(a, b)
            nest(a, cut)
            nest(cut + 1, b)

        nest(0, r.randrange(2, 60))
        passed = [p for p in run if p["class"] == "x" and p["bin"] >= 2]
        plain = [p for p in passed if not any(q["start"] <= p["start"] and q["end"] >= p["end"] and q["end"] - q["start"] > p["end"] - p["start"] for q in passed)]
        assert secrets.outermost(run, lowest) == sorted(plain, key=lambda p: p["start"])


def test_a_long_encoded_line_takes_time_in_proportion(spark):
    import base64
    import time

    r = random.Random(5)
    line = base64.b64encode(bytes(r.randrange(256) for _ in range(750_000))).decode()
    took = []
    for n in (250_000, 1_000_000):
        begin = time.time()
        rows = secrets.digest(secrets.scan(spark.createDataFrame([(1, f"x {line[:n]} y")], "doc_id long, text string"))).collect()
        took.append(time.time() - begin)
        assert len(rows) == 1
    assert took[1] < 12 * took[0]
