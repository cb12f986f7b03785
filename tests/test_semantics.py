"""Semantics that the driver tables can't show: nulls, empty tables, ragged rows, names, order and errors."""

import datetime
import sqlite3

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import loomtab as lt
from loomtab import Table

from .helpers import rows, same

pytestmark = pytest.mark.usefixtures("spark")
LEFT = [("id", "colour"), (1, "blue"), (2, "red"), (None, "grey"), (3, "purple")]
RIGHT = [("id", "shape"), (1, "circle"), (1, "square"), (None, "ellipse"), (4, "triangle")]


def test_joins_match_nulls():
    same(lt.join(LEFT, RIGHT), [("id", "colour", "shape"), (1, "blue", "circle"), (1, "blue", "square"), (None, "grey", "ellipse")])
    same(lt.leftjoin(LEFT, RIGHT), [("id", "colour", "shape"), (None, "grey", "ellipse"), (1, "blue", "circle"), (1, "blue", "square"), (2, "red", None), (3, "purple", None)], ordered=True)
    same(lt.outerjoin(LEFT, RIGHT, missing="?"), [("id", "colour", "shape"), (None, "grey", "ellipse"), (1, "blue", "circle"), (1, "blue", "square"), (2, "red", "?"), (3, "purple", "?"), (4, "?", "triangle")])
    same(lt.antijoin(LEFT, RIGHT), [("id", "colour"), (2, "red"), (3, "purple")])
    same(lt.hashantijoin(LEFT, RIGHT), [("id", "colour"), (2, "red"), (3, "purple")])
    same(lt.lookupjoin(LEFT, RIGHT), [("id", "colour", "shape"), (1, "blue", "circle"), (2, "red", None), (3, "purple", None), (None, "grey", "ellipse")])


def test_join_names_and_keys():
    right = [("key", "colour"), (1, "white")]
    same(lt.join(LEFT, right, lkey="id", rkey="key", lprefix="l_", rprefix="r_"), [("l_id", "l_colour", "r_colour"), (1, "blue", "white")])
    same(lt.join(LEFT, right, lkey="id", rkey="key"), [("id", "colour", "colour_2"), (1, "blue", "white")])
    same(lt.rightjoin(LEFT, [("key", "x"), (9, "y")], lkey="id", rkey="key"), [("id", "colour", "x"), (9, None, "y")])
    with pytest.raises(lt.ArgumentError):
        lt.join(LEFT, [("a", "b"), (1, 2)])


@pytest.mark.parametrize("f", [lt.join, lt.leftjoin, lt.rightjoin, lt.outerjoin, lt.hashjoin, lt.hashleftjoin, lt.hashrightjoin, lt.lookupjoin, lt.hashlookupjoin])
def test_joins_of_empty_tables(f):
    none = Table(lt.from_rows(RIGHT).df.where("false"))
    n = {"join": 0, "hashjoin": 0, "rightjoin": 0, "hashrightjoin": 0}.get(f.__name__, 4)
    assert len(rows(f(LEFT, none, key="id"))) == n


def test_null_is_lowest_in_filters():
    t = [("x",), (1,), (None,), (3,)]
    assert rows(lt.selectlt(t, "x", 2)) == sorted([(1,), (None,)], key=repr)
    assert rows(lt.selectge(t, "x", 2)) == [(3,)]
    assert rows(lt.selecteq(t, "x", None)) == [(None,)]
    assert rows(lt.selectin(t, "x", [1, None])) == sorted([(1,), (None,)], key=repr)
    assert rows(lt.selectnotin(t, "x", [1])) == sorted([(3,), (None,)], key=repr)
    assert rows(lt.select(t, lambda r: r.x > 2, complement=True)) == sorted([(1,), (None,)], key=repr)
    assert rows(lt.selecttrue([("s",), ("",), ("a",), (None,)], "s")) == [("a",)]
    assert rows(lt.search([("s",), ("abc",), (None,)], "None")) == [(None,)]


def test_callables_are_traced_or_run_as_they_are():
    t = lt.from_rows([("a", "b"), (1, "xy"), (2, None)])
    assert "PythonUDF" not in lt.addfield(t, "c", lambda r: r.a * 2 + 1).df._jdf.queryExecution().toString()
    same(lt.addfield(t, "c", lambda r: f"{r.a}-{r.b}"), [("a", "b", "c"), (1, "xy", "1-xy"), (2, None, "2-None")])
    same(lt.addfield(t, "c", lambda r: len(r.b)), [("a", "b", "c"), (1, "xy", 2), (2, None, None)])
    same(lt.select(t, "{a} % 2 == 1 and {b} in ['xy', 'z']"), [("a", "b"), (1, "xy")])
    with pytest.raises(lt.ArgumentError):
        lt.select(t, "__import__('os').system({b})")
    with pytest.raises(lt.FieldSelectionError):
        lt.cut(t, "nope")
    with pytest.raises(lt.FieldSelectionError):
        lt.cut(t, -1)


def test_set_operations_are_multisets_with_nulls():
    a = [("x", "y"), (1, None), (1, None), (2, "b"), (3, "c")]
    b = [("x", "y"), (1, None), (3, "c"), (3, "c")]
    same(lt.complement(a, b), [("x", "y"), (1, None), (2, "b")])
    same(lt.complement(a, b, strict=True), [("x", "y"), (2, "b")])
    same(lt.intersection(a, b), [("x", "y"), (1, None), (3, "c")])
    added, removed = lt.diff(a, b)
    same(added, [("x", "y"), (3, "c")])
    same(removed, [("x", "y"), (1, None), (2, "b")])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.sampled_from(["a", None])), min_size=1, max_size=8), st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.sampled_from(["a", None])), min_size=1, max_size=8))
def test_complement_and_intersection_part_a_table(x, y):
    a, b = [("p", "q"), (1, "a"), *x], [("p", "q"), (1, "a"), *y]
    both = rows(lt.complement(a, b)) + rows(lt.intersection(a, b))
    assert sorted(both, key=repr) == sorted(a[1:], key=repr)


def test_aggregates():
    t = [("k", "v"), ("a", 1), ("a", None), ("b", 3), ("a", 5)]
    same(lt.aggregate(t, "k", {"n": len, "s": ("v", sum), "l": ("v", list)}), [("k", "n", "s", "l"), ("a", 3, 6, [1, None, 5]), ("b", 1, 3, [3])], ordered=True)
    same(lt.aggregate(t, None, {"n": len}), [("n",), (4,)])
    assert rows(lt.aggregate(Table(lt.from_rows(t).df.where("false")), None, {"n": len})) == []
    same(lt.aggregate(t, "k", lambda vs: float(sum(v or 0 for v in vs)), "v"), [("k", "value"), ("a", 6.0), ("b", 3.0)])
    same(lt.groupcountdistinctvalues(t, "k", "v"), [("k", "value"), ("a", 3), ("b", 1)])
    same(lt.groupselectmin(t, "k", "v"), [("k", "v"), ("a", None), ("b", 3)])
    same(lt.groupselectmax(t, "k", "v"), [("k", "v"), ("a", 5), ("b", 3)])
    same(lt.groupselectfirst(t, "k"), [("k", "v"), ("a", 1), ("b", 3)])
    same(lt.groupselectlast(t, "k"), [("k", "v"), ("a", 5), ("b", 3)])
    same(lt.fold(t[:2] + t[3:], "k", lambda a, b: a * 10 + b, "v"), [("key", "value"), ("a", 15), ("b", 3)])


def test_merge_and_conflicts():
    t = [("k", "x", "y"), (1, "a", None), (1, None, 2), (2, "b", 3), (2, "c", 3)]
    same(lt.mergeduplicates(t, "k"), [("k", "x", "y", "x_conflict", "y_conflict"), (1, "a", 2, None, None), (2, None, 3, ["b", "c"], None)])
    same(lt.conflicts(t, "k"), [("k", "x", "y"), (2, "b", 3), (2, "c", 3)])
    same(lt.merge([("k", "x"), (1, "a")], [("k", "y"), (1, 2)], key="k"), [("k", "x", "y", "x_conflict", "y_conflict"), (1, "a", 2, None, None)])


def test_order_dependent_operators():
    t = [("g", "v"), ("a", 1), ("a", None), ("b", None), ("b", 4)]
    same(lt.filldown(t, "v"), [("g", "v"), ("a", 1), ("a", 1), ("b", 1), ("b", 4)], ordered=True)
    same(lt.filldown(t, "v", by="g"), [("g", "v"), ("a", 1), ("a", 1), ("b", None), ("b", 4)])
    same(lt.addrownumbers(t), [("row", "g", "v"), (1, "a", 1), (2, "a", None), (3, "b", None), (4, "b", 4)], ordered=True)
    same(lt.head(t, 1), [("g", "v"), ("a", 1)])
    same(lt.tail(t, 1), [("g", "v"), ("b", 4)])
    same(lt.rowslice(t, 1, None, 2), [("g", "v"), ("a", None), ("b", 4)], ordered=True)
    same(lt.sort(t, "v", reverse=True), [("g", "v"), ("b", 4), ("a", 1), ("a", None), ("b", None)], ordered=True)
    assert not lt.issorted(t, "v")
    assert lt.issorted(t, "g")
    assert not lt.issorted(t, "g", strict=True)
    same(lt.fillright([("a", "b"), (1, None), (None, 2)]), [("a", "b"), (1, 1), (None, 2)])
    same(lt.fillleft([("a", "b"), (1, None), (None, 2)]), [("a", "b"), (1, None), (2, 2)])
    assert [len(r[1]) for r in lt.rowgroupby(t, "g").df.collect()] == [2, 2]
    for f in (lt.filldown, lt.addrownumbers, lt.head):
        assert rows(f(Table(lt.from_rows(t).df.where("false")))) == []


def test_recurrence_sees_its_own_field():
    t = [("foo", "bar"), ("a", 1), ("b", 2), ("c", 5)]
    out = lt.addfieldusingcontext(t, "baz", lambda p, c, n: float(c.bar + (p.baz if p is not None else 0)), recurrent=True)
    same(out, [("foo", "bar", "baz"), ("a", 1, 1.0), ("b", 2, 3.0), ("c", 5, 8.0)])


def test_reshape():
    t = [("id", "x", "y"), (1, 10, None), (2, 30, 40)]
    long = lt.melt(t, "id")
    same(long, [("id", "variable", "value"), (1, "x", 10), (1, "y", None), (2, "x", 30), (2, "y", 40)], ordered=True)
    same(lt.recast(long), t)
    same(lt.recast([("id", "variable", "value"), (1, "x", 1), (1, "x", 2)]), [("id", "x"), (1, [1, 2])])
    same(lt.transpose(t), [("id", "1", "2"), ("x", "10", "30"), ("y", None, "40")], ordered=True)
    same(lt.unflatten(lt.flatten([("a", "b"), (1, 2), (3, 4)]), 3, missing=0), [("f0", "f1", "f2"), (1, 2, 3), (4, 0, 0)], ordered=True)
    same(lt.pivot([("r", "c", "v"), ("a", "x", 1), ("a", "x", 2), ("b", "y", 3)], "r", "c", "v", sum, missing=0), [("r", "x", "y"), ("a", 3, 0), ("b", 0, 3)])


def test_convert_policies():
    t = [("a", "b"), ("1", "x"), ("x", "y"), (None, "z"), ("1_000", "w")]
    same(lt.convert(t, "a", int), [("a", "b"), (1, "x"), (None, "y"), (None, "z"), (1000, "w")])
    same(lt.convert(t, "a", int, errorvalue=-1), [("a", "b"), (1, "x"), (-1, "y"), (None, "z"), (1000, "w")])
    got = {r["b"]: r["a"] for r in lt.convert(t, "a", int, failonerror="inline").df.collect()}
    assert got["x"]["value"] == 1
    assert "x" in got["y"]["error"]
    with pytest.raises(Exception, match="conversion of a failed"):
        lt.convert(t, "a", int, failonerror=True).df.collect()
    same(lt.convert(t, {"a": ("replace", "1", "2"), "b": {"x": "q", "z": None}}), [("a", "b"), ("2", "q"), ("x", "y"), (None, None), ("2_000", "w")])
    same(lt.replace(t, "a", None, "none"), [("a", "b"), ("1", "x"), ("x", "y"), ("none", "z"), ("1_000", "w")])
    same(lt.convertnumbers([("a", "b"), ("1", "1.5"), ("2", "x")]), [("a", "b"), (1, "1.5"), (2, "x")])
    same(lt.format([("a",), (1.5,), (None,)], "a", "<{:.2f}>"), [("a",), ("<1.50>",), ("<None>",)])


def test_parsers():
    t = [("d",), ("31/12/2024",), ("bad",)]
    same(lt.convert(t, "d", lt.dateparser("%d/%m/%Y")), [("d",), (datetime.date(2024, 12, 31),), (None,)])
    same(lt.convert(t, "d", lt.dateparser("%d/%m/%Y", strict=False)), [("d",), ("2024-12-31",), ("bad",)])
    same(lt.convert([("b",), ("Yes",), ("0",), ("?",)], "b", lt.boolparser()), [("b",), (True,), (False,), (None,)])


def test_regex():
    t = [("id", "s"), (1, "a12-b3"), (2, "none")]
    same(lt.capture(t, "s", r"([a-z])(\d+)", ["l", "d"], fill=["", None]), [("id", "l", "d"), (1, "a", "12"), (2, "", None)])
    with pytest.raises(Exception, match="no match"):
        lt.capture(t, "s", r"([a-z])(\d+)").df.collect()
    same(lt.split(t, "s", "-", ["x", "y"]), [("id", "x", "y"), (1, "a12", "b3"), (2, "none", None)])
    same(lt.splitdown(t, "s", "-"), [("id", "s"), (1, "a12"), (1, "b3"), (2, "none")], ordered=True)
    same(lt.sub(t, "s", r"(\d)", r"<\1>", count=2), [("id", "s"), (1, "a<1><2>-b3"), (2, "none")])


def test_intervals():
    left = [("a", "b", "n"), (1, 4, "x"), (4, 4, "zero"), (10, 20, "y")]
    right = [("s", "e", "v"), (2, 3, 1), (4, 6, 2), (12, 13, 3), (15, 30, 4)]
    at = {"lstart": "a", "lstop": "b", "rstart": "s", "rstop": "e"}
    same(lt.intervaljoin(left, right, **at), [("a", "b", "n", "s", "e", "v"), (1, 4, "x", 2, 3, 1), (10, 20, "y", 12, 13, 3), (10, 20, "y", 15, 30, 4)])
    assert len(rows(lt.intervaljoin(left, right, **at, include_stop=True))) == 5
    same(lt.intervalantijoin(left, right, **at), [("a", "b", "n"), (4, 4, "zero")])
    same(lt.intervaljoinvalues(left, right, "v", **at), [("a", "b", "n", "v"), (1, 4, "x", [1]), (4, 4, "zero", []), (10, 20, "y", [3, 4])])
    same(lt.intervalsubtract(left, right, **at), [("a", "b", "n"), (1, 2, "x"), (3, 4, "x"), (10, 12, "y"), (13, 15, "y")])
    same(lt.collapsedintervals([("start", "stop"), (1, 3), (3, 5), (7, 8)]), [("start", "stop"), (1, 5), (7, 8)], ordered=True)
    assert lt.intervallookup(right, "s", "e", "v").search(2) == [1]
    with pytest.raises(lt.DuplicateKeyError):
        lt.intervallookupone(right, "s", "e", "v").search(0, 30)


def test_ragged_and_repeated_names():
    same(lt.fromcsv(lt.MemorySource("a,b\n1\n1,2,3\n"), ragged=True), [("a", "b", "f2"), ("1", None, None), ("1", "2", "3")])
    same(lt.from_rows([("a", "a"), (1, 2)]), [("a", "a_2"), (1, 2)])
    same(lt.cat([("a", "b"), (1, 2)], [("b", "c"), (3, 4)], missing=None), [("a", "b", "c"), (1, 2, None), (None, 3, 4)])
    same(lt.stack([("a", "b"), (1, 2)], [("c",), (3,)]), [("a", "b"), (1, 2), (3, None)])
    same(lt.annex([("a",), (1,), (2,)], [("b",), (3,)]), [("a", "b"), (1, 3), (2, None)], ordered=True)
    same(lt.skip([("x", "y"), ("a", "b"), ("1", "2")], 1), [("a", "b"), ("1", "2")])
    same(lt.pushheader([("a", "b"), ("1", "2")], ["x", "y"]), [("x", "y"), ("a", "b"), ("1", "2")], ordered=True)
    same(lt.from_rows([("m",), (1,), ("x",)]), [("m",), ("1",), ("x",)])


def test_validate():
    t = [("foo", "bar"), (1, "2020-01-01"), (2, "bad"), (None, None)]
    found = lt.validate(t, [{"name": "foo_int", "field": "foo", "assertion": lambda v: v < 2}, {"name": "bar_date", "field": "bar", "test": lt.dateparser("%Y-%m-%d")}, {"name": "gone", "field": "baz", "test": int}], header=("foo", "bar", "baz"))
    assert {(r[0], r[1]) for r in rows(found)} == {("__header__", 0), ("gone", 0), ("foo_int", 2), ("foo_int", 3), ("bar_date", 2), ("bar_date", 3)}


def test_lookups():
    t = [("k", "v"), ("a", 1), ("b", 2), ("a", 3)]
    assert lt.lookup(t, "k", "v") == {"a": [1, 3], "b": [2]}
    assert lt.lookupone(t, "k", "v") == {"a": 1, "b": 2}
    with pytest.raises(lt.DuplicateKeyError):
        lt.lookupone(t, "k", "v", strict=True)
    assert lt.dictlookupone(t, "k")["b"] == {"k": "b", "v": 2}
    assert lt.recordlookup(t, "k")["a"][1].v == 3
    assert lt.columns(t) == {"k": ["a", "b", "a"], "v": [1, 2, 3]}
    assert lt.listoflists(t)[0] == ["k", "v"]
    assert [r.v for r in lt.records(t)] == [1, 2, 3]
    assert list(lt.namedtuples(t))[0].k == "a"
    assert lt.valuecounter(t, "k") == {"a": 2, "b": 1}
    assert lt.valuecount(Table(lt.from_rows(t).df.where("false")), "k", "a") == (0, None)


def test_showing(capsys):
    t = [("a", "b"), (1, "<x>"), (2, None)]
    assert str(lt.look(t)).splitlines()[3] == "| 1 | '<x>' |"
    assert "..." in str(lt.look(t, 1))
    assert "&lt;x&gt;" in lt.displayall(t)
    assert lt.see(t).startswith("a: 1, 2")
    w = lt.clock(t)
    w.table.df.collect()
    assert w.rows == 2


@pytest.mark.parametrize("suffix", ["", ".gz", ".bz2"])
def test_files(tmp_path, suffix):
    t = lt.from_rows([("a", "b"), ("1", 'x "q", y'), ("2", ""), ("3", "línea\nnew")])
    path = str(tmp_path / f"x.csv{suffix}")
    lt.tocsv(t, path, encoding="utf-8")
    lt.appendcsv([("a", "b"), ("4", "z")], path)
    same(lt.fromcsv(path), [("a", "b"), ("1", 'x "q", y'), ("2", ""), ("3", "línea\nnew"), ("4", "z")])


def test_other_files(tmp_path):
    t = lt.from_rows([("a", "b"), (1, "x<y"), (2, None)])
    lt.tojson(t, str(tmp_path / "x.json"))
    same(lt.fromjson(str(tmp_path / "x.json")), [("a", "b"), (1, "x<y"), (2, None)])
    lt.tojsonarrays(t, m := lt.MemorySource(), output_header=True)
    assert m.getvalue() == b'[["a", "b"], [1, "x<y"], [2, null]]'
    for style in ("tag", "attribute", "name"):
        lt.toxml(t, str(tmp_path / f"{style}.xml"), style=style)
    same(lt.fromxml(str(tmp_path / "attribute.xml"), "row", {"a": "@a", "b": "@b"}), [("a", "b"), ("1", "x<y"), ("2", "")])
    lt.toxlsx(t, str(tmp_path / "x.xlsx"), "one")
    lt.toxlsx(t, str(tmp_path / "x.xlsx"), "two", mode="add")
    lt.appendxlsx(t, str(tmp_path / "x.xlsx"), "two")
    assert len(rows(lt.fromxlsx(str(tmp_path / "x.xlsx"), "two"))) == 4
    same(lt.fromxlsx(str(tmp_path / "x.xlsx"), range_string="A1:A3"), [("a",), (1,), (2,)])
    lt.topickle(t, str(tmp_path / "x.p"))
    same(lt.frompickle(str(tmp_path / "x.p")), [("a", "b"), (1, "x<y"), (2, None)])
    lt.tohtml(t, m := lt.MemorySource(), caption="c")
    assert b"x&lt;y" in m.getvalue()
    with pytest.raises(lt.Unavailable):
        lt.fromxls(str(tmp_path / "x.xls"))
    same(lt.teecsv(t, str(tmp_path / "tee.csv")), [("a", "b"), (1, "x<y"), (2, None)])


def test_unsafe_pickles_are_refused(tmp_path):
    import os
    import pickle

    class Bad:
        def __reduce__(self):
            return os.getcwd, ()

    (tmp_path / "bad.p").write_bytes(pickle.dumps(("a",)) + pickle.dumps((Bad(),)))
    with pytest.raises(pickle.UnpicklingError):
        lt.frompickle(str(tmp_path / "bad.p"))


def test_databases(tmp_path):
    t = lt.from_rows([("a", 'na"me'), (1, "x"), (None, "y")])
    with sqlite3.connect(tmp_path / "x.db") as c:
        lt.todb(t, c, "t", create=True)
        lt.todb(t, c, "t")
        lt.appenddb(t, c, "t")
        same(lt.fromdb(c, "SELECT * FROM t"), [("a", 'na"me'), (1, "x"), (1, "x"), (None, "y"), (None, "y")])
        lt.drop_table(c, "t")
    assert 'NOT NULL' in lt.make_create_table_statement(t, "t")
    assert "VARCHAR(1)" in lt.make_create_table_statement(t, "t", dialect="postgresql")


def test_stream_of_row_operators(spark, tmp_path):
    lt.toparquet([("a",), (1,), (2,), (3,)], str(tmp_path / "in"))
    stream = Table(spark.readStream.schema("a bigint").parquet(str(tmp_path / "in")))
    out = lt.addfield(lt.selectgt(stream, "a", 1), "b", lambda r: r.a * 10)
    q = out.df.writeStream.format("memory").queryName("s").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("s").collect()) == [(2, 20), (3, 30)]


def test_plans_push_down_and_stay_in_codegen(spark, tmp_path):
    lt.toparquet([("a", "b", "c"), (1, "x", 2.0), (2, "y", 3.0)], str(tmp_path / "p"))
    t = lt.cut(lt.selectgt(lt.fromparquet(str(tmp_path / "p"), order="a"), "a", 1), "b")
    plan = t.df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(a), GreaterThan(a,1)]" in plan
    assert "c:double" not in plan
    j = lt.join(t, t, key="b").df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in j
    assert F is not None


def test_types_of_opaque_callables_come_from_all_rows():
    t = [("n",), *((k,) for k in range(200))]
    seen = {"late": [0, 1, 2.5], "text": [0, 1, "x"], "nested": [[0], [1], [2.5]]}
    for name, values in seen.items():
        got = lt.addfield(t, name, lambda r, v=values: v[0 if r["n"] < 100 else 1 if r["n"] < 199 else 2] if int(r["n"]) >= 0 else None)
        first, last, kind = {"late": (0.0, 2.5, "double"), "text": ("0", "x", "string"), "nested": ([0.0], [2.5], "array<double>")}[name]
        assert dict(got.df.dtypes)[name] == kind
        assert {r.n: r[name] for r in got.df.collect() if r.n in (0, 199)} == {0: first, 199: last}
    late = lt.convert(t, "n", lambda v: int(v) if int(v) < 100 else float(v) + 0.5)
    assert dict(late.df.dtypes)["n"] == "double"
    assert late.df.agg(F.max("n")).first()[0] == 199.5


def test_results_that_do_not_fit_returns_are_errors_of_the_callable():
    t = [("n",), (1,), (2,), (3,)]
    opaque = lambda r: {1: 4.0, 2: 3.7, 3: "x"}[int(r["n"])]
    same(lt.addfield(t, "m", opaque, returns="bigint"), [("n", "m"), (1, 4), (2, None), (3, None)])


def test_sort_keywords_are_accepted():
    t, u = [("a", "b"), (2, "x"), (1, "y"), (1, "y")], [("a", "c"), (1, 3)]
    extra = {"presorted": False, "buffersize": 10, "tempdir": "/tmp", "cache": True}
    same(lt.join(t, u, key="a", **extra), [("a", "b", "c"), (1, "y", 3), (1, "y", 3)])
    same(lt.sort(t, "a", **extra), [("a", "b"), (1, "y"), (1, "y"), (2, "x")], ordered=True)
    same(lt.distinct(t, **extra), [("a", "b"), (1, "y"), (2, "x")])
    same(lt.wrap(t).aggregate("a", len, presorted=True), [("a", "value"), (1, 2), (2, 1)])
    for f in (lt.leftjoin, lt.rightjoin, lt.outerjoin, lt.antijoin, lt.lookupjoin):
        assert f(t, u, key="a", **extra).columns[0] == "a"
    with pytest.raises(TypeError):
        lt.join(t, u, key="a", nonsense=1)


def test_whole_table_windows_run_in_blocks(monkeypatch):
    """No window without a partition, and the same results whatever the blocks are."""
    import random

    from loomtab.plans import numbering

    r = random.Random(1)
    ranges = sorted((s := r.randrange(500), s + r.randrange(6)) for _ in range(150))
    merged = []
    for s, e in ranges:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    values = [r.randrange(9) for _ in range(60)]
    for block in (1, 7, 100_000):
        monkeypatch.setattr(numbering, "BLOCK", block)
        same(lt.collapsedintervals([("start", "stop"), *ranges]), [("start", "stop"), *map(tuple, merged)], ordered=True)
        t = lt.wrap([("i", "v"), *enumerate(values)])
        same(lt.selectusingcontext(t, lambda p, c, n: c.v > p.v), [("i", "v"), *((i, v) for i, v in enumerate(values) if i and v > values[i - 1])], ordered=True)
        added = lt.addfieldusingcontext(t, "d", lambda p, c, n: n.v - c.v)
        same(added, [("i", "v", "d"), *((i, v, values[i + 1] - v if i + 1 < 60 else None) for i, v in enumerate(values))], ordered=True)
    plan = lt.collapsedintervals([("start", "stop"), *ranges]).df._jdf.queryExecution().executedPlan().toString()
    assert "Window [" in plan
    assert "__part" in plan
