"""Data-quality checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import Table, as_table, col, method, resolve
from ..functions.expressions import opaque, record_column
from ..plans.numbering import numbered
from .convert import converted


def _test(t: Table, field: str, test: Any) -> Column:
    """Whether a field's value passes: a conversion that must work."""
    return converted(t, field, test, False, None).isNotNull()


@method
def validate(t: Table, constraints: Sequence[dict[str, Any]] = (), header: Sequence[str] | None = None) -> Table:
    """Problems as rows ``name, row, field, value, error``; ``row`` is 1-based, and 0 for the header.

    A constraint has a ``name``, and a ``field`` with a ``test`` (a conversion that must work) or an ``assertion`` (a predicate of the value or, without a field, of
    the record); ``optional`` lets a field be absent.
    """
    t = as_table(t)
    n = numbered(t, "__row")
    names = [c for c in t.columns]
    row, problems = F.col("__row") + 1, []
    problem = lambda bad, name, field, value, error: F.when(bad, F.struct(F.lit(name).cast("string").alias("name"), row.alias("row"), F.lit(field).cast("string").alias("field"), value.alias("value"), F.lit(error).alias("error")))
    top = []
    if header is not None and list(header) != names:
        top.append(("__header__", 0, None, None, "AssertionError"))
    for c in constraints:
        field = c.get("field")
        if field is not None and field not in names and not isinstance(field, int):
            if not c.get("optional"):
                top.append((c["name"], 0, field, None, "FieldSelectionError"))
            continue
        name = resolve(t, field) if field is not None else None
        value = (col(name) if name else F.lit(None)).cast("string")
        if "test" in c:
            problems.append(problem(~_test(n, name, c["test"]) | col(name).isNull(), c["name"], name, value, "ValueError"))
        if "assertion" in c:
            a: Callable = c["assertion"]
            ok = opaque(t, (lambda r, a=a, name=name: bool(a(r[name]))) if name else (lambda r, a=a: bool(a(r))), "boolean", False) if not isinstance(a, (str, Column)) and _opaque(t, a, name) else record_column(t, _of_value(a, name), "boolean")
            problems.append(problem(~F.coalesce(ok, F.lit(False)), c["name"], name, value, "AssertionError"))
    schema = "name string, row long, field string, value string, error string"
    out = n.frame.sparkSession.createDataFrame(top, schema)
    if problems:
        found = n.frame.select(F.filter(F.array(*problems), lambda x: x.isNotNull()).alias("p")).select(F.inline("p"))
        out = out.unionByName(found.select("name", "row", "field", "value", "error"))
    return Table(out, order=["row", "name", "field"])


def _of_value(a: Any, name: str | None) -> Any:
    return (lambda rec: a(rec[name])) if callable(a) and not isinstance(a, Column) and name else a


def _opaque(t: Table, a: Callable, name: str | None) -> bool:
    from ..functions.expressions import SymbolicRecord, traced

    return traced(_of_value(a, name), SymbolicRecord(t)) is None
