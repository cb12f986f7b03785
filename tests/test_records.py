"""Delimited text in splits against one parser over the whole file."""

import csv
import io
import random
import re

import pytest

import loomtab as lt
from loomtab.sources import records

from .helpers import rows


def serial(path, **args):
    with open(path, encoding="utf-8", newline="") as f:
        return [r for r in csv.reader(f, **args) if r]


def sample(seed, n, ragged=False, terminator="\n"):
    r = random.Random(seed)
    values = ["", "a", "b c", 'say "x"', "two\nlines", "three\n\n\nmore", "comma, here", 'q"', '"', "é日本", "crlf\r\nin", "x" * 300, '","', '\n"\n', "tab\t"]
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=terminator)
    w.writerow(["i", "p", "q"])
    for i in range(n):
        w.writerow([i, *(r.choice(values) for _ in range(r.randrange(0, 5) if ragged else 2))])
    return out.getvalue()


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("terminator", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", [1, 2])
def test_splits_give_what_one_parser_gives(small_splits, tmp_path, seed, terminator):
    path = tmp_path / "t.csv"
    path.write_text(sample(seed, 300, terminator=terminator), encoding="utf-8", newline="")
    assert records.lines(small_splits, str(path)).rdd.getNumPartitions() > 10
    assert any(records.begins(small_splits, str(path), ",", '"').values())
    t = lt.fromcsv(str(path))
    assert [list(r) for r in t] == serial(path)
    assert t.has_order


def test_ragged_rows_in_splits(small_splits, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(sample(3, 200, ragged=True), encoding="utf-8", newline="")
    expected = serial(path)
    width = max(map(len, expected))
    got = list(lt.fromcsv(str(path), ragged=True))
    assert got[0] == ("i", "p", "q", *(f"f{i}" for i in range(3, width)))
    assert got[1:] == [tuple(r + [None] * (width - len(r))) for r in expected[1:]]


def test_folders_and_headers(small_splits, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(sample(k, 60), encoding="utf-8", newline="")
    got = rows(lt.fromcsv(str(tmp_path)))
    assert got == sorted([tuple(r) for k in range(3) for r in serial(tmp_path / f"{k}.csv")[1:]], key=repr)
    one = tmp_path / "0.csv"
    assert [list(r) for r in lt.fromcsv(str(one), header=["x", "y", "z"])][1:] == serial(one)


def test_a_value_longer_than_splits(small_splits, tmp_path):
    path = tmp_path / "long.csv"
    long = "\n".join(f'line {i} with "quotes"' for i in range(400))
    with open(path, "w", encoding="utf-8", newline="") as f:
        csv.writer(f).writerows([["a", "b"], [1, long], [2, "x"], [3, long], [4, ""]])
    assert [list(r) for r in lt.fromcsv(str(path))] == serial(path)


def test_small_files_and_tabs(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text('a\tb\n1\t"x\ty"\n2\n', encoding="utf-8")
    assert rows(lt.fromtsv(str(path))) == [("1", "x\ty"), ("2", "")]
    assert list(lt.fromtsv(str(path), ragged=True)) == [("a", "b"), ("1", "x\ty"), ("2", None)]
    (tmp_path / "e.csv").write_text("a,b\n", encoding="utf-8")
    assert list(lt.fromcsv(str(tmp_path / "e.csv"), ragged=True)) == [("a", "b")]


def test_quotes_open_values_only_where_they_begin():
    begin = records.opener(",", '"')
    for line in ['a"b', 'a,"b', '"a""', '"a"",', '"a"b"c', 'x,"y"z,"w', '""', '"""', '""""', 'a,"",b', '","', '"a"\r"b', 'a\r"b']:
        for quoted in (False, True):
            text = ('"' if quoted else "") + line + "\nEND\n"
            inside = not any(r and r[0] == "END" for r in csv.reader(io.StringIO(text, newline="")))
            assert records.ends_quoted(line, quoted, begin, '"') == inside, (line, quoted)
    assert re.match(begin, '"x')
