"""Parsers of text, usable on Columns and as converters; and small helpers on values."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..core import session
from .expressions import Symbol, _column

#: strptime directives and Spark's pattern letters, fixed values.
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "E", "A": "EEEE", "j": "DDD", "z": "xx", "Z": "z", "%": "%"}


def spark_pattern(fmt: str) -> str:
    """A strptime format as a Spark datetime pattern."""
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if fmt[i + 1] not in DIRECTIVES:
                raise ArgumentError(f"directive %{fmt[i + 1]}")
            out += DIRECTIVES[fmt[i + 1]]
            i += 2
            continue
        out += f"'{fmt[i]}'" if fmt[i].isalpha() else "''" if fmt[i] == "'" else fmt[i]
        i += 1
    return out


class Parser:
    """A function of a Column; ``strict`` makes what doesn't parse null (or an error, by the policy), otherwise it stays as text."""

    def __init__(self, parse: Callable[[Column], Column], strict: bool = True):
        self.parse, self.strict = parse, strict

    def column(self, c: Column) -> Column:
        found = self.parse(c)
        return found if self.strict else F.coalesce(found.cast("string"), c)

    def __call__(self, x: Any) -> Any:
        return Symbol(self.column(_column(x)))


def datetimeparser(fmt: str, strict: bool = True) -> Parser:
    return Parser(lambda c: F.try_to_timestamp(F.trim(c), F.lit(spark_pattern(fmt))).cast("timestamp_ntz"), strict)


def dateparser(fmt: str, strict: bool = True) -> Parser:
    return Parser(lambda c: F.try_to_date(F.trim(c), spark_pattern(fmt)), strict)


def timeparser(fmt: str, strict: bool = True) -> Parser:
    """Times of day; sessions have to be told that they may have columns of them."""
    session().conf.set("spark.sql.timeType.enabled", True)
    return Parser(lambda c: F.try_to_time(F.trim(c), F.lit(spark_pattern(fmt))), strict)


def boolparser(true_strings: Sequence[str] = ("true", "t", "yes", "y", "1"), false_strings: Sequence[str] = ("false", "f", "no", "n", "0"), case_sensitive: bool = False, strict: bool = True) -> Parser:
    def parse(c: Column) -> Column:
        x = F.trim(c) if case_sensitive else F.lower(F.trim(c))
        yes, no = ([s if case_sensitive else s.lower() for s in y] for y in (true_strings, false_strings))
        return F.when(x.isin(yes), True).when(x.isin(no), False)

    return Parser(parse, strict)


def numparser(strict: bool = False) -> Parser:
    """Numbers as double; text with a whole number and one with a fraction can't be of two types in one column."""
    return Parser(lambda c: F.trim(c).try_cast("double"), strict)


def nthword(n: int, sep: str | None = None) -> Parser:
    """The n-th word (0-based) of a text, split at white space or at ``sep``."""
    return Parser(lambda c: F.try_element_at(F.split(F.trim(c), r"\s+"), F.lit(n + 1)) if sep is None else F.split_part(c, F.lit(sep), F.lit(n + 1)))


def coalesce(*fields: str | int, missing: Any = None, default: Any = None) -> Callable[[Any], Symbol]:
    """A function of a record: the first of the fields that isn't missing."""

    def f(rec: Any) -> Symbol:
        each = [_column(rec[x]) for x in fields]
        each = [F.nullif(c, F.lit(missing)) for c in each] if missing is not None else each
        return Symbol(F.coalesce(*each, F.lit(default)))

    return f
