"""Showing tables, and watching them run."""

from __future__ import annotations

import html
import logging
import sys
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Observation
from pyspark.sql import functions as F

from .. import config
from ..core import Table, as_table, method
from .sorts import head


def _shown(t: Table, limit: int | None) -> tuple[list[str], list[tuple], bool]:
    rows = [tuple(r) for r in (head(t, limit + 1).df if limit is not None else t.df).collect()]
    more = limit is not None and len(rows) > limit
    return t.columns, rows[:limit] if more else rows, more


class Look:
    """A text grid; rows are fetched when it's shown."""

    def __init__(self, t: Any, limit: int | None, vrepr: Callable[[Any], str], index_header: bool, style: str, truncate: int | None, width: int | None):
        self.t, self.limit, self.vrepr, self.index_header, self.style, self.truncate, self.width = as_table(t), limit, vrepr, index_header, style, truncate, width

    def __str__(self) -> str:
        names, rows, more = _shown(self.t, self.limit)
        cells = [[f"{i}|{n}" if self.index_header else n for i, n in enumerate(names)], *([self.vrepr(v) for v in r] for r in rows)]
        if self.truncate:
            cells = [[x[: self.truncate] for x in r] for r in cells]
        widths = [max(len(r[i]) for r in cells) for i in range(len(names))]
        number = [all(isinstance(r[i], (int, float)) for r in rows) and bool(rows) for i in range(len(names))]
        pad = lambda x, i: x.rjust(widths[i]) if number[i] else x.ljust(widths[i])
        if self.style == "grid":
            bar = lambda c: "+" + "+".join(c * (w + 2) for w in widths) + "+"
            line = lambda r: "| " + " | ".join(pad(x, i) for i, x in enumerate(r)) + " |"
            out = [bar("-"), line(cells[0]), bar("=")] + [y for r in cells[1:] for y in (line(r), bar("-"))]
        elif self.style == "simple":
            bar = "  ".join("=" * w for w in widths)
            out = [bar, "  ".join(pad(x, i) for i, x in enumerate(cells[0])), bar, *("  ".join(pad(x, i) for i, x in enumerate(r)) for r in cells[1:]), bar]
        else:
            out = ["  ".join(pad(x, i) for i, x in enumerate(r)) for r in cells]
        if self.width:
            out = [x[: self.width] for x in out]
        return "\n".join([*out, *(["..."] if more else [])]) + "\n"

    __repr__ = __str__


@method
def look(t: Table, limit: int = 0, vrepr: Callable[[Any], str] = repr, index_header: bool = False, style: str | None = None, truncate: int | None = None, width: int | None = None) -> Look:
    """The first rows as a text grid; styles grid, simple and minimal."""
    return Look(t, limit or config.look_limit, vrepr, index_header, style or config.look_style, truncate, width)


@method
def lookall(t: Table, **kwargs: Any) -> Look:
    out = look(t, **kwargs)
    out.limit = None
    return out


@method
def lookstr(t: Table, limit: int = 0, **kwargs: Any) -> Look:
    return look(t, limit, vrepr=str, **kwargs)


@method
def lookallstr(t: Table, **kwargs: Any) -> Look:
    return lookall(t, vrepr=str, **kwargs)


@method
def see(t: Table, limit: int = 0, vrepr: Callable[[Any], str] = repr, index_header: bool = False) -> str:
    """Each field with its first values."""
    names, rows, more = _shown(as_table(t), limit or config.see_limit)
    lines = [f"{f'{i}|{n}' if index_header else n}: {', '.join(vrepr(r[i]) for r in rows)}{'...' if more else ''}" for i, n in enumerate(names)]
    return "\n".join(lines) + "\n"


def html_table(names: list[str], rows: list[tuple], caption: str | None = None, vrepr: Callable[[Any], str] = str, index_header: bool = False, tr_style: Any = None, td_styles: Any = None, truncate: int | None = None, lineterminator: str = "\n") -> str:
    """An HTML table; values are escaped."""
    cell = lambda v: html.escape(vrepr(v)[:truncate] if truncate else vrepr(v))

    def style(s: Any, x: Any) -> str:
        s = s(x) if callable(s) else s
        return f' style="{html.escape(s)}"' if s else ""

    def td(r: tuple, n: str, v: Any) -> str:
        s = td_styles.get(n) if isinstance(td_styles, dict) else td_styles
        align = s if s else "text-align: right" if isinstance(v, (int, float)) and not isinstance(v, bool) else None
        return f"<td{style(align, v)}>{cell(v)}</td>"

    out = ["<table class='loomtab'>"] + ([f"<caption>{html.escape(caption)}</caption>"] if caption else [])
    out += ["<thead>", "<tr>", *(f"<th>{html.escape(f'{i}|{n}' if index_header else n)}</th>" for i, n in enumerate(names)), "</tr>", "</thead>", "<tbody>"]
    for r in rows:
        out += [f"<tr{style(tr_style, dict(zip(names, r, strict=True)) if callable(tr_style) else r)}>", *(td(r, n, v) for n, v in zip(names, r, strict=True)), "</tr>"]
    return lineterminator.join([*out, "</tbody>", "</table>"]) + lineterminator


@method
def display(t: Table, limit: int = 0, **kwargs: Any) -> str:
    """The first rows as HTML."""
    names, rows, more = _shown(as_table(t), limit or config.display_limit)
    return html_table(names, rows, **kwargs) + ("<p><strong>...</strong></p>\n" if more else "")


@method
def displayall(t: Table, **kwargs: Any) -> str:
    names, rows, _ = _shown(as_table(t), None)
    return html_table(names, rows, **kwargs)


class Watched:
    """A table whose rows are counted and timed by Spark's own observation, when an action runs it."""

    def __init__(self, t: Any):
        self.began, self.observation = time.time(), Observation()
        t = as_table(t)
        self.table = Table(t.frame.observe(self.observation, F.count(F.lit(1)).alias("rows"), F.max(F.lit(1)).alias("any")))

    @property
    def rows(self) -> int:
        """Rows that passed; waits for the action."""
        return self.observation.get["rows"]

    @property
    def seconds(self) -> float:
        return time.time() - self.began

    def message(self, prefix: str = "") -> str:
        n, s = self.rows, self.seconds
        return f"{prefix}{n} rows in {s:.2f}s ({n / s if s else 0:.0f} row/s)"


@method
def clock(t: Table) -> Watched:
    """The table with a count and a clock on it: ``.table`` goes on, ``.rows`` and ``.seconds`` tell after an action."""
    return Watched(t)


@method
def progress(t: Table, batchsize: int = 1000, prefix: str = "", out: Any = None) -> Table:
    """Counts rows as tasks pass them on; the driver's accumulator is reported at each ``batchsize`` by partition."""
    from ..streaming.progress import reporting

    return reporting(as_table(t), batchsize, lambda m: print(prefix + m, file=out or sys.stderr))


@method
def log_progress(t: Table, batchsize: int = 1000, prefix: str = "", logger: logging.Logger | None = None, level: int = logging.INFO) -> Table:
    from ..streaming.progress import reporting

    return reporting(as_table(t), batchsize, lambda m: (logger or logging.getLogger("loomtab")).log(level, prefix + m))


