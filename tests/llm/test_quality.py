"""Quality rules against brute force: the counts, the learner and the verdicts."""

import random

import pytest

from loomtab.llm import quality

from ..helpers import SF


def texts(n=400, seed=1):
    r = random.Random(seed)
    out = []
    for k in range(n):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randrange(3, 90))]
        kind = k % 8
        if kind == 0:
            words = [w + "#$" for w in words]
        elif kind == 1:
            words = [w.upper() for w in words]
        elif kind == 2:
            words = words[:6] * 4
        out.append(("\n" if k % 3 else " ").join(words))
    return out


EDGES = [None, "", " \n\t ", "a", "a b c d e", "a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n\n \nx", "#*$%&|<> é ß\x1f", "a b c d e f " * 3, "\n".join(["same line here"] * 30)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], "doc_id long, text string, rule string, n_words int, bad int, `a.b` string")


def test_counts_match_brute_force(spark):
    rows = list(enumerate([*EDGES, *texts(), " ".join(random.Random(2).choices("abcdefgh", k=1200)), "word " * 3000]))
    got = {r.doc_id: tuple(r[c] for c in quality.COUNTS) for r in quality.measured(table(spark, rows)).collect()}
    assert got == {i: quality.brute_force(t) for i, t in rows}


def rates(text):
    """The rates, and whether the base rule fails."""
    import re

    n, chars, symbols, dup, repeated = quality.brute_force(text)
    t = text or ""
    lines, words = sum(bool(x.split()) for x in t.split("\n")), t.split()
    w, c = max(n, 1), max(chars, 1)
    found = (n, chars / w, symbols / c, sum(x.isupper() for x in t) / c, len(re.findall("[0-9]", t)) / c, len(re.findall("[!?.,;:]", t)) / c, repeated / w, len(set(words)) / w, dup / max(lines, 1), n / max(lines, 1))
    return dict(zip(quality.RATES, found, strict=True)), n < 10 or 100 * repeated > 20 * n


def test_learner_matches_covering_in_python(spark, monkeypatch):
    """The same list comes from counting labelled rows one by one, and its verdicts are those of the rules read aloud."""
    rows = list(enumerate(texts(800)))
    labels = spark.createDataFrame([(i, int(i % 8 > 1), "z") for i, _ in rows if i % 5] + [(99999, 0, "z"), (7, None, "z"), (None, 0, "z")], "doc_id long, quality int, rule string")
    docs = table(spark, rows)
    known = quality.labelled(quality.measured(docs), labels)
    seen = {}
    real = quality.cover
    monkeypatch.setattr(quality, "cover", lambda thresholds, grow, prune: seen.setdefault("rules", real(seen.setdefault("thresholds", thresholds), grow, prune)))
    rules = quality.learn(known)
    data = [(r.bad, r.grows, {n: r[n] for n in quality.RATES}) for r in known.collect()]

    def fits(v, conditions):
        return all((v[c.name] > c.threshold) == c.above for c in conditions)

    def grow(done, conditions):
        out = {}
        for bad, grows, v in data:
            if grows and fits(v, conditions) and not any(fits(v, r.conditions) for r in done):
                for n, ts in seen["thresholds"].items():
                    key = (n, sum(t < v[n] for t in ts))
                    p, q = out.get(key, (0, 0))
                    out[key] = (p + bad, q + (not bad))
        return out

    def prune(done, conditions):
        left = [(bad, v) for bad, grows, v in data if not grows and not any(fits(v, r.conditions) for r in done)]
        return [(sum(b for b, v in left if fits(v, conditions[:k])), sum(not b for b, v in left if fits(v, conditions[:k]))) for k in range(1, len(conditions) + 1)]

    assert rules == real(seen["thresholds"], grow, prune)
    assert len(rules) >= 2
    monkeypatch.undo()
    got = {r.doc_id: (r.base_failed, r.kept, r.rule) for r in quality.digest(quality.judge(docs, labels)).collect()}
    for i, t in rows:
        v, failed = rates(t)
        first = next((str(r) for r in rules if fits(v, r.conditions)), None)
        assert got[i] == (failed, not failed and first is None, "base" if failed else first), (i, t)
    clean = [i for i, t in rows if i % 8 > 2 and not got[i][0]]
    assert sum(got[i][1] for i in clean) >= 0.99 * len(clean)


def test_conditions_gain_and_ties():
    stats = {("n_words", 0): (10, 0), ("n_words", 1): (0, 30), ("symbols", 0): (10, 30)}
    best = quality.best_condition(stats, {"n_words": [5.0], "symbols": [0.0], "digits": []})
    assert (best.name, best.above, best.threshold) == ("n_words", False, 5.0)
    assert quality.best_condition({}, {"n_words": [5.0]}) is None


def test_edges(spark):
    docs = table(spark, [(None, "a"), (1, None), (1, "b c " * 30), (1, "b c " * 30)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.digest(quality.judge(docs, none)).collect()
    assert len(got) == 4 and all(r.base_failed and not r.kept and r.rule == "base" for r in got)
    assert quality.judge(docs.where("false"), none).collect() == []
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.learn(quality.labelled(quality.measured(table(spark, [(1, " ".join(map(str, range(20))))])), one)) == []


def test_very_long_text(spark):
    t = " ".join(str(k) for k in range(400_000)) + " x y z u v x y z u v"
    r = quality.measured(table(spark, [(1, t)])).first()
    assert (r.n_words, r.n_repeat_words) == (400_010, 10)


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = quality.measured(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_clean_documents_are_kept(spark, folder):
    at = f"{SF.rsplit('/', 1)[0]}/{folder}"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    found = quality.judge(spark.read.parquet(f"{at}/documents.parquet"), labels).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in found}
    assert n.get((1, False), 0) <= 0.005 * n[1, True]
    assert n.get((0, False), 0) >= 0.9 * (n.get((0, False), 0) + n.get((0, True), 0))
