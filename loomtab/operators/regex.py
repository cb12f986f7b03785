"""Regular-expression operators (Java's dialect; ``\\1`` in replacements is taken as a back-reference)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import ORD, Table, as_table, col, method, resolve
from .filters import flagged


def _placed(t: Table, name: str, new: list[Column], include_original: bool) -> Table:
    return t.keep(*[col(c) for c in t.columns if c != name or include_original], *new)


@method
def capture(t: Table, field: str | int, pattern: str, newfields: Sequence[str] | None = None, include_original: bool = False, flags: int = 0, fill: Sequence | None = None) -> Table:
    """Groups of the first match as fields; a row without a match takes ``fill``, or raises when there is none."""
    t = as_table(t)
    name, p = resolve(t, field), flagged(pattern, flags)
    n = re.compile(pattern, flags).groups
    names = list(newfields or [f"{name}{i + 1}" for i in range(n)])
    text = col(name).cast("string")
    other = [F.lit(x) for x in fill] if fill is not None else [F.raise_error(F.concat(F.lit(f"no match in {name}: "), F.coalesce(text, F.lit("None"))))] * n
    matched = F.coalesce(text.rlike(p), F.lit(False))
    return _placed(t, name, [F.when(matched, F.regexp_extract(text, p, i + 1)).otherwise(other[i]).alias(x) for i, x in enumerate(names)], include_original)


@method
def split(t: Table, field: str | int, pattern: str, newfields: Sequence[str] | None = None, include_original: bool = False, maxsplit: int = 0, flags: int = 0) -> Table:
    """Parts between matches as fields; ``maxsplit`` is the most cuts."""
    t = as_table(t)
    name = resolve(t, field)
    parts = F.split(col(name).cast("string"), flagged(pattern, flags), maxsplit + 1 if maxsplit else -1)
    if newfields is None:
        return _placed(t, name, [parts.alias(f"{name}_parts")], include_original)
    return _placed(t, name, [F.try_element_at(parts, F.lit(i + 1)).alias(x) for i, x in enumerate(newfields)], include_original)


@method
def splitdown(t: Table, field: str | int, pattern: str, maxsplit: int = 0, flags: int = 0) -> Table:
    """A row for each part between matches."""
    t = as_table(t)
    name = resolve(t, field)
    parts = F.split(col(name).cast("string"), flagged(pattern, flags), maxsplit + 1 if maxsplit else -1)
    out = t.frame.select("*", F.posexplode_outer(parts).alias("__p", "__v"))
    order = [F.struct(F.col(ORD).alias("o"), F.col("__p").alias("p")).alias(ORD)] if t.has_order else []
    return Table(out.select(*[F.col("__v").alias(c) if c == name else col(c) for c in t.columns], *order))


@method
def sub(t: Table, field: str | int, pattern: str, repl: str, count: int = 0, flags: int = 0) -> Table:
    """Matches replaced, all or the first ``count``."""
    t = as_table(t)
    name, p = resolve(t, field), flagged(pattern, flags)
    text, to = col(name).cast("string"), re.sub(r"\\(\d)", r"$\1", repl.replace("$", "\\$"))
    if not count:
        out = F.regexp_replace(text, p, to)
    else:
        out, rest = F.lit(""), text
        for _ in range(count):
            at, found = F.regexp_instr(rest, F.lit(p)), F.regexp_substr(rest, F.lit(p))
            end = at + F.coalesce(F.length(found), F.lit(0))
            out = F.when(at > 0, F.concat(out, F.substring(rest, F.lit(1), at - 1), F.regexp_replace(found, p, to))).otherwise(out)
            rest = F.when(at > 0, F.substring(rest, end, F.length(rest))).otherwise(rest)
        out = F.concat(out, rest)
    return t.keep(*[out.alias(c) if c == name else col(c) for c in t.columns])
