import pytest

import loomtab as lt
from loomtab.__main__ import run

from .helpers import same


@pytest.mark.usefixtures("spark")
def test_chain_of_operators(tmp_path):
    lt.tocsv([("a", "b"), ("x", "1"), ("y", "5")], str(tmp_path / "x.csv"))
    out = run(["fromcsv", str(tmp_path / "x.csv"), "--", "convertnumbers", "--", "selectgt", "b", "3", "--", "addfield", "c", "{b} * 2"])
    same(out, [("a", "b", "c"), ("y", 5, 10)])
    assert run(["fromcsv", str(tmp_path / "x.csv"), "--", "head", "n=1", "--", "nrows"]) == 1
    for bad in ("__import__", "PopenSource", "Table"):
        with pytest.raises(lt.ArgumentError):
            run([bad, "x"])
