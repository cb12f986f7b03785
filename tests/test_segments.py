"""Groups of any size: scans in parts, folds that stream, neighbours of opaque queries, and intervals of any length."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

import loomtab as lt
from loomtab import Table
from loomtab.plans import numbering

from .helpers import rows, same


def table(seed, n=80, keys=3):
    r = random.Random(seed)
    return [("k", "v", "i")] + [(r.choice([None, "a", "b"][:keys]), r.choice([None, None, 1, 2, 3]), i) for i in range(n)]


@pytest.mark.parametrize("block", [1, 9, 100_000])
def test_keyed_scans_in_parts_of_any_size(monkeypatch, block):
    monkeypatch.setattr(numbering, "BLOCK", block)
    t = table(3)
    last, filled = {}, []
    for k, v, i in t[1:]:
        last[k] = v if v is not None else last.get(k)
        filled.append((k, last[k], i))
    same(lt.filldown(t, "v", by="k"), [t[0], *filled])
    before = {}
    steps = []
    for k, v, i in t[1:]:
        steps.append((i, before.get(k)))
        before[k] = i
    same(lt.cut(lt.addfieldusingcontext(t, "p", lambda p, c, n: p.i, by="k"), "i", "p"), [("i", "p"), *steps])
    same(lt.cut(lt.addfieldusingcontext(t, "p", lambda p, c, n: None if p is None else int(str(p["i"])), by="k", returns="long"), "i", "p"), [("i", "p"), *steps])
    spans = [("k", "s", "e")] + [(k, i * 3, i * 3 + random.Random(i).randrange(12)) for k, _, i in t[1:]]
    merged = {}
    for k, s, e in spans[1:]:
        runs = merged.setdefault(k, [])
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    same(lt.collapsedintervals(spans, "s", "e", key="k"), [("k", "s", "e"), *((k, s, e) for k, runs in merged.items() for s, e in runs)])


def test_opaque_context_equals_the_traced_one():
    t = table(5)
    for by in (None, "k"):
        traced = lt.selectusingcontext(t, lambda p, c, n: c.i > n.v, by=by)
        opaque = lt.selectusingcontext(t, lambda p, c, n: n is not None and n.v is not None and bool([x for x in (c.i,) if x > n.v]), by=by)
        assert rows(traced) == rows(opaque)


def test_a_key_with_all_rows_takes_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(numbering, "BLOCK", 1000)
    t = Table(spark.range(20_000).select(F.lit(1).alias("k"), F.when(F.col("id") % 100 == 0, F.col("id")).alias("v"), "id"), order="id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        out = lt.filldown(t, "v", by="k")
        assert out.frame.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.df.where("v != id - id % 100").count() == 0
    assert "__part" in out.frame._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_are_those_of_one_run(spark):
    """Rows of equal order keep their numbers when the plan runs again, its shuffle in another order."""
    n = numbering.numbered(Table(spark.range(3000).withColumn("o", F.lit(0)).repartition(7), order="o"), "n").frame
    first = {r.id: r.n for r in n.collect()}
    assert sorted(first.values()) == list(range(3000))
    assert {r.id: r.n for r in n.repartition(3).collect()} == first
    assert "InMemory" not in n._jdf.queryExecution().executedPlan().toString()


FOLDS = [(lambda a, b: (a + b) / 2, False), (lambda a, b: a + b, True), (lambda a, b: a * 10 + b, False), (lambda a, b: max([a, b]), True), (lambda a, b: b, True), (lambda a, b: a - b / 2, False)]


@pytest.mark.parametrize("which", range(len(FOLDS)))
def test_folds_are_those_of_python(which):
    f, associative = FOLDS[which]
    r = random.Random(which)
    t = [("k", "v")] + [(r.choice("abc"), r.randrange(5)) for _ in range(40)] + [("d", 7), (None, 1), (None, 2), (None, 2)]
    groups = {}
    for k, v in t[1:]:
        groups.setdefault(k, []).append(v)
    expected = {k: reduce(f, vs) for k, vs in groups.items()}
    for parts in {False, associative}:
        got = {x[0]: x[1] for x in rows(lt.fold(t, "k", f, "v", associative=parts))}
        assert got == pytest.approx(expected)


def test_folds_of_narrow_integers_and_texts(spark):
    t = Table(spark.range(3).selectExpr("1 AS k", "CAST(2000000000 AS INT) AS v", "CAST(id AS STRING) AS s", "id"), order="id")
    assert rows(lt.fold(t, "k", lambda a, b: a + b, "v")) == [(1, 6_000_000_000)]
    assert rows(lt.fold(t, "k", lambda a, b: f"{a}/{b}", "s")) == [(1, "0/1/2")]
    assert rows(lt.fold(t, "k", lambda a, b: a + b, "v", returns="decimal(38,0)"))[0][1] == 6_000_000_000
    assert rows(lt.fold(Table(t.frame.where("false")), "k", lambda a, b: a + b, "v")) == []
    assert rows(lt.fold(t, ("k", "id"), lambda a, b: a, "s"))[0][1] == "0"


def test_a_large_group_streams(spark):
    t = Table(spark.range(400_000).selectExpr("0 AS k", "id AS v"), order="v")
    assert rows(lt.fold(t, "k", lambda a, b: a + b, "v", associative=True)) == [(0, 400_000 * 399_999 // 2)]
    assert rows(lt.fold(t, "k", lambda a, b: b - a, "v")) == [(0, 200_000)]


def test_extremes_take_the_first_of_ties():
    t = [("k", "v", "i"), (1, 5, 0), (1, 5, 1), (1, None, 2), (1, None, 3), (2, None, 4), (2, None, 5)]
    same(lt.groupselectmax(t, "k", "v"), [t[0], (1, 5, 0), (2, None, 4)])
    same(lt.groupselectmin(t, "k", "v"), [t[0], (1, None, 2), (2, None, 4)])


def spans(seed, n, longest):
    r = random.Random(seed)
    return [(s := r.randrange(1000), s + r.choice([0, 1, 3, 20, longest]), r.choice("xy")) for _ in range(n)]


@pytest.mark.parametrize("include", [False, True])
def test_intervals_of_all_lengths(include):
    left, right = spans(1, 60, 700) + spans(1, 5, 1), spans(2, 60, 10**9) + spans(2, 5, 1) + [(None, 4, "x"), (9, 3, "y")]
    over = [(a, b) for a in left for b in right if b[0] is not None and b[0] <= b[1] and ((a[0] <= b[1] and a[1] >= b[0]) if include else (a[0] < b[1] and a[1] > b[0]))]
    lt_, rt = [("start", "stop", "f"), *left], [("start", "stop", "g"), *right]
    assert rows(lt.intervaljoin(lt_, rt, include_stop=include)) == sorted([(*a, *b) for a, b in over], key=repr)
    facet = [(*a, *b) for a, b in over if a[2] == b[2]]
    assert rows(lt.intervaljoin(lt_, rt, lkey="f", rkey="g", include_stop=include)) == sorted(facet, key=repr)
    alone = [a for a in left if a not in [x for x, _ in over]]
    assert rows(lt.intervalantijoin(lt_, rt, include_stop=include)) == sorted(alone, key=repr)
    assert rows(lt.intervalleftjoin(lt_, rt, include_stop=include)) == sorted([(*a, *b) for a, b in over] + [(*a, None, None, None) for a in alone], key=repr)
    values = lt.intervaljoinvalues(lt_, rt, "g", include_stop=include)
    assert sorted((r[:3], sorted(r[3])) for r in rows(values)) == sorted((a, sorted(b[2] for x, b in over if x is a)) for a in left)


def test_subtraction_keeps_repeated_rows():
    left, right = [("start", "stop", "x"), (0, 10, "a"), (0, 10, "a"), (20, 30, "b"), (40, 41, "c"), (50, 60, "d")], [("start", "stop"), (2, 3), (2, 4), (9, 25), (39, 45)]
    same(lt.intervalsubtract(left, right), [left[0], (0, 2, "a"), (4, 9, "a"), (0, 2, "a"), (4, 9, "a"), (25, 30, "b"), (50, 60, "d")])
    same(lt.intervalsubtract(lt.cut(Table(lt.from_rows(left).df), "start", "stop", "x"), right), [left[0], (0, 2, "a"), (4, 9, "a"), (0, 2, "a"), (4, 9, "a"), (25, 30, "b"), (50, 60, "d")])


def test_one_long_interval_doesnt_widen_the_bins(spark):
    """10^5 short intervals and one of 10^9: the candidates of the plan's join stay near the pairs that there are."""
    short = spark.range(100_000).selectExpr("id * 10 AS start", "id * 10 + 4 AS stop", "id")
    outlier = spark.createDataFrame([(0, 10**9, -1)], "start long, stop long, id long")
    points = Table(spark.range(50_000).selectExpr("id * 20 + 1 AS a", "id * 20 + 3 AS b", "id AS p"))
    found = lt.intervaljoin(Table(short.union(outlier)), points, rstart="a", rstop="b")
    assert found.df.where("id >= 0").count() == 50_000
    assert found.df.where("id < 0").count() == 50_000


def test_candidates_of_the_bins_grow_with_the_pairs(spark):
    """A hundredth of the intervals is 10,000 times as long: what meets in a bin is no multiple of what overlaps, and bins are dealt out."""
    from loomtab.operators.intervals import _Sides

    left = Table(spark.range(200_000).selectExpr("id AS start", "id + IF(id % 100 = 7, 10000, 1) * (id % 17) AS stop"))
    right = Table(spark.range(30_000).selectExpr("id * 7 AS a", "id * 7 + id % 9 AS b"))
    sides = _Sides(left, right, "start", "stop", "a", "b", None, None, False)
    n = [df.groupBy(F.col(f"__{s}_v").alias("v"), F.col(f"__{s}_b").alias("b")).count() for s, df in zip("lr", sides.bins(), strict=True)]
    met = n[0].toDF("v", "b", "l").join(n[1].toDF("v", "b", "r"), ["v", "b"]).agg(F.sum(F.col("l") * F.col("r"))).first()[0]
    pairs = sides.pairs()
    assert met < 2 * pairs.count()
    assert "SortMergeJoin" in pairs._jdf.queryExecution().executedPlan().toString()


def test_dates_and_times_as_intervals():
    import datetime as dt

    d = dt.datetime(2020, 1, 1)
    left = [("start", "stop"), (d, d + dt.timedelta(days=2)), (d + dt.timedelta(days=5), d + dt.timedelta(days=6))]
    right = [("start", "stop"), (d + dt.timedelta(days=1), d + dt.timedelta(days=9))]
    assert len(rows(lt.intervaljoin(left, right))) == 2
    days = [("start", "stop"), (dt.date(2020, 1, 1), dt.date(2020, 1, 3))]
    assert len(rows(lt.intervaljoin(days, days))) == 1


def test_recurrent_context_in_batches_keeps_integers_and_neighbours(spark):
    rows = [(i, i % 3 if i % 7 else None, (1 << 60) + i if i % 4 else None) for i in range(500)]
    t = Table(spark.createDataFrame(rows, "id long, k int, n long"), "id")
    query = lambda p, c, n: (p["x"] if p else 0) + (n["id"] if n else 1000) + (0 if c["n"] is None else c["n"] - (1 << 60))
    for by in (None, "k"):
        expected = []
        for k in {r[1] for r in rows} if by else (0,):
            mine, x = [r for r in rows if by is None or r[1] == k], 0
            for i, r in enumerate(mine):
                x += (mine[i + 1][0] if i + 1 < len(mine) else 1000) + (0 if r[2] is None else r[2] - (1 << 60))
                expected.append((*r, x))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        try:
            got = lt.addfieldusingcontext(t, "x", query, by=by, recurrent=True, returns="long").df.collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(expected)
