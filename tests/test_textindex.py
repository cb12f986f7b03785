"""The text index: ranked words, phrases, prefixes, boolean and boosted searches against brute force; segments, appends and merges."""

import math
import re

import pytest

import loomtab as lt
from loomtab.sources import textindex as ti

DOCS = [("id", "title", "body"), (1, "The cat", "the cat sat on the mat, the cat"), (2, "Dogs", "dogs and cats; no dog sat"), (3, None, "sat on the cat"), (4, "cat cat cat", ""), (5, "Ünï", "über catalog 12"), (6, "", None)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}"
    lt.wrap(DOCS[:4]).totextindex(path, "id", ["title", "body"])
    lt.wrap([DOCS[0], *DOCS[4:]]).appendtextindex(path, "id", ["title", "body"])
    return path


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def brute(found, boosts=None):
    """Scores of documents from ``found(field words) -> {term: occurrences}``."""
    boosts = boosts or {"title": 1.0, "body": 1.0}
    docs = {d[0]: (words(d[1]), words(d[2])) for d in DOCS[1:]}
    held = {d: len(a) + len(b) for d, (a, b) in docs.items() if a or b}
    n, mean = len(held), sum(held.values()) / len(held)
    tf = {}
    for d, (a, b) in docs.items():
        for name, w in (("title", a), ("body", b)):
            for term, k in found(w).items():
                if k and name in boosts:
                    tf[term, d] = tf.get((term, d), 0) + k * boosts[name]
    out = {}
    for (term, d), f in tf.items():
        df = sum(t == term for t, _ in tf)
        out[d] = out.get(d, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * held[d] / mean))
    return out


def count(*wanted):
    return lambda w: {x: w.count(x) for x in wanted}


def phrase(*p):
    return lambda w: {" ".join(p): sum(tuple(w[i : i + len(p)]) == p for i in range(len(w)))}


def got(index, q, **kwargs):
    t = lt.searchtextindex(index, q, limit=None, score_field="score", **kwargs)
    return {r.id: r.score for r in t.df.collect()}


def test_words_phrases_prefixes(index):
    assert got(index, "cat SAT") == pytest.approx(brute(count("cat", "sat")))
    assert got(index, ti.Phrase("the cat")) == pytest.approx(brute(phrase("the", "cat")))
    assert got(index, ti.Phrase("cat cat")) == pytest.approx(brute(phrase("cat", "cat")))
    assert got(index, ti.Phrase("cat the")) == {}
    assert got(index, ti.Prefix("Cat")) == pytest.approx(brute(count("cat", "cats", "catalog")))
    assert got(index, "nothing") == {} == got(index, "")


def test_boolean_and_boosted(index):
    cat, sat = brute(count("cat")), brute(count("sat"))
    assert got(index, ti.All((ti.Words("cat"), ti.Words("sat")))) == pytest.approx({d: cat[d] + sat[d] for d in cat.keys() & sat.keys()})
    assert got(index, ti.AnyOf(("cat", ti.Phrase("dog sat")))).keys() == {1, 2, 3, 4}
    assert got(index, ti.Without("sat", ti.Phrase("the cat"))) == pytest.approx({2: sat[2]})
    assert got(index, "cat", fieldboosts={"title": 3.0, "body": 0.5}) == pytest.approx(brute(count("cat"), {"title": 3.0, "body": 0.5}))
    assert got(index, "cat", fieldboosts={"title": 1.0}) == pytest.approx(brute(count("cat"), {"title": 1.0}))


def test_pages_follow_each_other(index):
    pages = [list(lt.searchtextindexpage(index, "cat sat", k, 2))[1:] for k in (1, 2, 3)]
    assert [r[0] for p in pages for r in p] == [r[0] for r in list(lt.searchtextindex(index, "cat sat"))[1:]]
    assert [len(p) for p in pages] == [2, 2, 0]


def test_segments_merge_and_failed_appends_are_invisible(index, monkeypatch, tmp_path):
    before = got(index, "cat sat")
    assert len(ti._manifest(index)[1]) == 2
    monkeypatch.setattr(ti, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        lt.wrap([DOCS[0], (7, "cat", "cat")]).appendtextindex(index, "id", ["title", "body"])
    monkeypatch.undo()
    assert got(index, "cat sat") == before
    ti.optimizetextindex(index)
    assert len(ti._manifest(index)[1]) == 1
    assert got(index, "cat sat") == pytest.approx(before)
    assert lt.nrows(lt.fromtextindex(index)) == 6
    version, segments = ti._manifest(index)
    with pytest.raises(Exception, match="exist"):
        ti._publish(index, version, segments)
    with pytest.raises(FileNotFoundError):
        lt.searchtextindex(str(tmp_path / "none"), "x")


def test_terms_are_in_the_scan(index):
    plan = lt.searchtextindex(index, "cat sat").df._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [cat,sat])" in plan
    assert "StartsWith" in lt.searchtextindex(index, ti.Prefix("ca")).df._jdf.queryExecution().executedPlan().toString().replace("StringStartsWith", "StartsWith")


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "e")
    lt.Table(lt.from_rows(DOCS).df.where("false")).totextindex(path, "id")
    assert list(lt.searchtextindex(path, "cat")) == [("id", "title", "body")]


def test_postings_are_made_without_a_shuffle(spark):
    docs = [(i, " ".join(f"w{(i * j) % 7}" for j in range(i % 50)), None if i % 3 else "w1, W1 x") for i in range(700)]
    found = ti.postings(spark.createDataFrame(docs, "id long, title string, body string").repartition(2), "id", ["title", "body"])
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    expected = []
    for i, *texts in docs:
        length = sum(len(words(t)) for t in texts)
        for f, t in zip(("title", "body"), texts, strict=True):
            w = words(t)
            expected += [(x, i, f, length, [p for p, y in enumerate(w) if y == x]) for x in set(w)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
