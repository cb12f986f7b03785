"""Every registered query against its SQL."""

import importlib.util

import pytest

import __spark_entry__ as entry
from loomtab import catalogue

from .helpers import SF, matches


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, name):
    matches(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name])


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_llm_queries_only_with_the_subpackage():
    there = importlib.util.find_spec("loomtab.llm") is not None and importlib.util.find_spec("loomtab.llm.queries") is not None
    assert any(n.startswith("op") and "_" in n for n in entry.queries() if n[2:3].isdigit()) == there
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_leftjoin_mixed_of_customers_without_orders(spark, tmp_path):
    """Customers of even and odd keys, each with orders and without."""
    spark.createDataFrame([(k, f"c{k}") for k in range(1, 7)], "c_custkey long, c_name string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(10, 1), (11, 2), (12, 2), (13, 6)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    (tmp_path / "flat").mkdir()
    for name in ("customer", "orders"):
        next((tmp_path / f"{name}.parquet").glob("part-*")).rename(tmp_path / "flat" / f"{name}.parquet")
    matches(catalogue.queries()["leftjoin_mixed"](spark, str(tmp_path / "flat")), catalogue.oracle_sql()["leftjoin_mixed"], str(tmp_path / "flat"))
