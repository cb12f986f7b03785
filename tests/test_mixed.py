"""Values of unlike types in one column and on both sides: a model in Python decides."""

import datetime
import random
from decimal import Decimal
from functools import cmp_to_key

import pytest

import loomtab as lt
from loomtab import Table

from .helpers import rows, same

#: Python types in the order of their kinds, numbers apart.
ORDER = [datetime.date, datetime.datetime, dict, list, bytes, datetime.time, str]
VALUES = [None, True, False, -3, 0, 1, 2, 3, 2**53, 2**53 + 1, float(2**53), 0.5, -1.0, 1e300, "", "1", "2", "a", "é", "True", b"", b"a", b"\xff", datetime.date(2020, 1, 2), datetime.datetime(2020, 1, 2), datetime.datetime(2020, 1, 2, 0, 0, 0, 5)]


def number(v):
    return isinstance(v, (bool, int, float, Decimal))


def less(a, b):
    """The order of values of any type."""
    if b is None or a is None:
        return a is None and b is not None
    if number(a) != number(b):
        return number(a)
    if number(a) or type(a) is type(b):
        return a < b
    return ORDER.index(type(a)) < ORDER.index(type(b))


def equal(a, b):
    return a is b or (a is not None and b is not None and (number(a) == number(b)) and (number(a) or type(a) is type(b)) and a == b)


def column(name, values):
    """A table of one field whose values keep their types, in their order, and of their numbers."""
    kinds = {}
    for i, v in enumerate(values):
        kinds.setdefault(type(v), [(name, "n")]).append((v, i))
    return lt.sort(lt.cat(*kinds.values()), "n")


@pytest.mark.parametrize("seed", range(3))
def test_sort_and_round_trip(spark, seed):
    values = random.Random(seed).choices(VALUES, k=14) if seed else [2**53 + 1, float(2**53), None, 1]
    values = [fit(v, values) for v in values]
    t = column("v", values)
    assert [(repr(r[0]), r[1]) for r in list(t)[1:]] == [(repr(v), i) for i, v in enumerate(values)]
    expected = sorted(enumerate(values), key=cmp_to_key(lambda a, b: -1 if less(a[1], b[1]) else 1 if less(b[1], a[1]) else a[0] - b[0]))
    assert [r[1] for r in list(lt.sort(t, "v"))[1:]] == [i for i, _ in expected]


def fit(v, values):
    """What a column of these values makes of one: all integers and floats make doubles."""
    kinds = {type(x) for x in values if x is not None}
    return float(v) if kinds == {int, float} and v is not None else v


@pytest.mark.parametrize("seed", range(2))
def test_joins_and_sets(spark, seed):
    r = random.Random(seed)
    xs, ys = r.choices(VALUES, k=12), r.choices(VALUES, k=12)
    a, b = column("k", xs), lt.rename(column("k", ys), {"n": "m"})
    xs, ys = [fit(x, xs) for x in xs], [fit(y, ys) for y in ys]
    pairs = sorted((i, j) for i, x in enumerate(xs) for j, y in enumerate(ys) if equal(x, y))
    assert sorted((r[1], r[2]) for r in rows(lt.join(a, b, key="k"))) == pairs
    assert sorted(r[1] for r in rows(lt.antijoin(a, b, key="k"))) == [i for i in range(len(xs)) if i not in {p for p, _ in pairs}]
    left = lt.leftjoin(a, b, key="k", missing="none")
    assert sorted(r[1] for r in rows(left)) == sorted([p for p, _ in pairs] + [i for i in range(len(xs)) if i not in {p for p, _ in pairs}])
    mine, theirs = lt.cut(a, "k"), lt.cut(b, "k")
    rest, both = list(ys), 0
    for x in xs:
        hit = next((k for k, y in enumerate(rest) if equal(x, y)), None)
        if hit is not None:
            rest.pop(hit)
            both += 1
    assert len(rows(lt.intersection(mine, theirs))) == both
    assert len(rows(lt.complement(mine, theirs))) == len(xs) - both
    classes = []
    for x in xs:
        if not any(equal(x, c) for c in classes):
            classes.append(x)
    assert len(rows(lt.distinct(mine))) == len(classes)
    assert lt.isunique(a, "k") == (len(classes) == len(xs))


def test_text_is_no_number():
    numbers, texts = [("k", "l"), (1, "a"), (2, "b"), (None, "c")], [("k", "r"), ("1", "x"), (None, "y")]
    same(lt.join(numbers, texts), [("k", "l", "r"), (None, "c", "y")])
    same(lt.hashjoin(numbers, texts), [("k", "l", "r"), (None, "c", "y")])
    same(lt.hashantijoin(numbers, texts), [("k", "l"), (1, "a"), (2, "b")])
    assert list(lt.outerjoin(numbers, texts, missing=0)) == [("k", "l", "r"), (None, "c", "y"), (1, "a", 0), (2, "b", 0), ("1", 0, "x")]
    same(lt.lookupjoin(numbers, texts), [("k", "l", "r"), (1, "a", None), (2, "b", None), (None, "c", "y")])
    assert rows(lt.selecteq(texts, "k", 1)) == []
    same(lt.selectlt(texts, "k", 1), [("k", "r"), (None, "y")])
    same(lt.selectin(texts, "k", [1, "1"]), [("k", "r"), ("1", "x")])


def test_unions_keep_each_value():
    a, b = [("x", "y"), (1, "p"), (2, None)], [("y", "z"), (3.5, True), ("q", False)]
    assert list(lt.cat(a, [("y", "z"), (3.5, True)], missing="-")) == [("x", "y", "z"), (1, "p", "-"), (2, None, "-"), ("-", 3.5, True)]
    assert list(lt.stack(a, [("u",), ("w",)], missing=0)) == [("x", "y"), (1, "p"), (2, None), ("w", 0)]
    assert list(lt.cat([("x",), (1,)], [("x",), (2.5,)])) == [("x",), (1.0,), (2.5,)]
    assert list(lt.cat([("x",), (None,)], [("x",), (2,)])) == [("x",), (None,), (2,)]
    assert list(lt.cat([("x",), ([1, 2],)], [("x",), ("a",)])) == [("x",), ([1, 2],), ("a",)]
    m = lt.cat([("x",), (1,), (True,)], [("x",), ("1",)], [("x",), (datetime.date(2020, 1, 1),)])
    assert lt.typecounter(m, "x") == {"int": 2, "str": 1, "date": 1}
    same(lt.convert(lt.selectisinstance(m, "x", (str, "date")), "x", str), [("x",), ("1",), ("2020-01-01",)])


def test_empty_sides():
    none, text = Table(lt.from_rows([("k",), (1,)]).df.where("false")), [("k",), ("a",)]
    assert list(lt.cat(none, text)) == [("k",), ("a",)]
    assert rows(lt.join(none, text)) == rows(lt.intersection(none, text)) == []
    same(lt.complement(text, none), [("k",), ("a",)])
