"""Interval joins and lookups over half-open intervals.

Two intervals overlap if ``l.start < r.stop`` and ``l.stop > r.start`` (``<=`` and ``>=`` with ``include_stop``). Both sides are
cut into bins by classes of length, joined on facet, class and bin, and a pair is kept only in the bin where
the later of the two begins, so each pair comes once, no cross product is planned, and a few long intervals don't widen the bins of the short ones. Bins that hold
much of a side are split by adaptive skew handling.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import ORD, Table, as_table, col, method, resolve, resolve_all, unique_names
from ..errors import DuplicateKeyError
from ..plans.numbering import carried, segments
from .joins import _sided

#: Intervals of a class are up to this many times as long as those of the class below.
STEP = 4.0


def _overlap(ls: Column, le: Column, rs: Column, re: Column, include_stop: bool) -> Column:
    return (ls <= re) & (le >= rs) if include_stop else (ls < re) & (le > rs)


def _place(c: Column, to: T.DataType) -> Column:
    """A point as a number."""
    if isinstance(to, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return F.unix_date(c).cast("double") if isinstance(to, T.DateType) else c.cast("double")


class _Sides:
    """Both sides with columns by position, bins, and the overlap test."""

    def __init__(self, left: Any, right: Any, lstart: str, lstop: str, rstart: str, rstop: str, lkey: Any, rkey: Any, include_stop: bool):
        self.left, self.right = as_table(left), as_table(right)
        self.lk = resolve_all(self.left, lkey) if lkey is not None else []
        self.rk = resolve_all(self.right, rkey) if rkey is not None else []
        at = lambda t, c, side: f"__{side}{t.columns.index(c)}"
        self.l, self.r = _sided(self.left, "l"), _sided(self.right, "r")
        self.ls, self.le = at(self.left, resolve(self.left, lstart), "l"), at(self.left, resolve(self.left, lstop), "l")
        self.rs, self.re = at(self.right, resolve(self.right, rstart), "r"), at(self.right, resolve(self.right, rstop), "r")
        self.on = [F.col(at(self.left, a, "l")).eqNullSafe(F.col(at(self.right, b, "r"))) for a, b in zip(self.lk, self.rk, strict=True)]
        self.test = _overlap(F.col(self.ls), F.col(self.le), F.col(self.rs), F.col(self.re), include_stop)

    def bins(self, left: DataFrame | None = None) -> list[DataFrame]:
        """Both sides' intervals in classes of length, ``__l_v`` and ``__r_v``, and in bins of these, ``__l_b`` and ``__r_b``.

        Lengths of the lowest class are up to twice a side's median, which long intervals don't move; its bins are as long. A higher class has bins a ``STEP``-th as long as its longest interval,
        so that what meets there and doesn't overlap is about as much as what does, at most. A pair meets in the bins of its longer interval's
        class: each side is there with its own intervals of the class and with the shorter ones, which are binned in the classes that the other side has.
        """
        sides = [("l", self.l if left is None else left, self.ls, self.le), ("r", self.r, self.rs, self.re)]
        valid = {}
        for n, df, s, e in sides:
            start, stop = (_place(F.col(c), df.schema[c].dataType) for c in (s, e))
            valid[n] = df.where(F.col(s).isNotNull() & F.col(e).isNotNull() & (F.col(e) >= F.col(s))).withColumns({f"__{n}_s": start, f"__{n}_e": stop})
        lengths = [F.col(f"__{n}_e") - F.col(f"__{n}_s") for n in valid]
        found = [df.agg(F.percentile_approx(x, 0.5), F.avg(x)).first() for x, df in zip(lengths, valid.values(), strict=True)]
        width = 2 * max(float(min(middle or mean, mean) if mean else 0) for middle, mean in found) or 1.0

        def level(n: str) -> Column:
            ratio = (F.col(f"__{n}_e") - F.col(f"__{n}_s")) / width
            return F.when(ratio <= 1, 0).otherwise(F.ceil(F.log(ratio) / F.log(F.lit(STEP)))).cast("int")

        valid = {n: df.withColumn(f"__{n}_c", level(n)) for n, df in valid.items()}
        classes = {n: sorted(r[0] for r in df.select(f"__{n}_c").distinct().collect()) for n, df in valid.items()}  # some dozens: lengths grow by STEP

        def binned(n: str, other: str) -> DataFrame:
            own = F.col(f"__{n}_c")
            levels = F.explode(F.array_distinct(F.concat(F.array(own), F.filter(F.array(*map(F.lit, classes[other] or [0])), lambda c: c > own))))
            at = F.lit(width) * F.pow(F.lit(STEP), F.greatest(F.col(f"__{n}_v") - 1, F.lit(0)))
            df = valid[n].withColumn(f"__{n}_v", levels).withColumns({f"__{n}_0": F.floor(F.col(f"__{n}_s") / at), f"__{n}_1": F.floor(F.col(f"__{n}_e") / at)})
            return df.withColumn(f"__{n}_b", F.explode(F.sequence(f"__{n}_0", f"__{n}_1"))).drop(f"__{n}_1", f"__{n}_s", f"__{n}_e")

        return [binned("l", "r"), binned("r", "l")]

    def pairs(self, left: DataFrame | None = None) -> DataFrame:
        """All overlapping pairs, once each."""
        l, r = self.bins(left)  # noqa: E741
        once = (F.col("__l_b") == F.greatest("__l_0", "__r_0")) & (F.col("__l_v") == F.greatest("__l_c", "__r_c"))
        on = reduce(lambda x, y: x & y, [*self.on, F.col("__l_v") == F.col("__r_v"), F.col("__l_b") == F.col("__r_b"), once, self.test])
        # the work is in pairs, not in bytes: with a broadcast side it would stay in the splits of the other, however few
        return l.join(r.hint("merge"), on).drop(*[f"__{n}_{x}" for n in "lr" for x in "v0bc"])

    def named(self, df: DataFrame, lprefix: str | None = None, rprefix: str | None = None, missing: Any = None, right: bool = True) -> Table:
        shown = [(f"{lprefix or ''}{c}", F.col(f"__l{i}")) for i, c in enumerate(self.left.columns)]
        if right:
            fill = lambda c: c if missing is None else F.when(F.col("__r"), c).otherwise(F.lit(missing))
            shown += [(f"{rprefix or ''}{c}", fill(F.col(f"__r{i}"))) for i, c in enumerate(self.right.columns)]
        names = unique_names(n for n, _ in shown)
        order = [o for o in ("__lo", "__ro") if o in df.columns]
        return Table(df.select(*[c.alias(n) for (_, c), n in zip(shown, names, strict=True)], *([F.struct(*order).alias(ORD)] if order else [])))


@method
def intervaljoin(left: Table, right: Table, lstart: str = "start", lstop: str = "stop", rstart: str = "start", rstop: str = "stop", lkey: Any = None, rkey: Any = None, include_stop: bool = False, lprefix: str | None = None, rprefix: str | None = None) -> Table:
    """Pairs of overlapping intervals, of the same facet where keys are given; all columns of both sides."""
    s = _Sides(left, right, lstart, lstop, rstart, rstop, lkey, rkey, include_stop)
    return s.named(s.pairs(), lprefix, rprefix)


def _identified(s: _Sides) -> DataFrame:
    """The left side with an id made of each row's content: equal rows share it, and it is the same in every run of a plan."""
    content = [F.col(c) for c in s.l.columns]
    return s.l.withColumn("__id", F.struct(F.xxhash64(*content).alias("a"), F.xxhash64(F.lit(1), *content).alias("b")))


def _gathered(s: _Sides, found: Column) -> DataFrame:
    """Left rows, one for equal ones: ``l``, how often each is there, ``n``, and ``found`` of the right rows that each overlaps, once for each copy, sorted."""
    ids = _identified(s)
    left = F.struct(*[F.col(c) for c in s.l.columns])
    rows = ids.select("__id", left.alias("l"), F.lit(None).alias("x")).unionByName(s.pairs(ids).select("__id", F.lit(None).alias("l"), found.alias("x")), allowMissingColumns=True)
    return rows.groupBy("__id").agg(F.first("l", ignorenulls=True).alias("l"), F.count("l").alias("n"), F.sort_array(F.collect_list("x")).alias("x")).drop("__id")


def _copies(df: DataFrame) -> DataFrame:
    return df.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")


@method
def intervalleftjoin(left: Table, right: Table, lstart: str = "start", lstop: str = "stop", rstart: str = "start", rstop: str = "stop", lkey: Any = None, rkey: Any = None, include_stop: bool = False, missing: Any = None, lprefix: str | None = None, rprefix: str | None = None) -> Table:
    """As ``intervaljoin``, with the left rows that overlap nothing."""
    s = _Sides(left, right, lstart, lstop, rstart, rstop, lkey, rkey, include_stop)
    ids = _identified(s)
    found = s.pairs(ids)
    rest = ids.join(found.select("__id").distinct(), "__id", "left_anti")
    return s.named(found.unionByName(rest, allowMissingColumns=True), lprefix, rprefix, missing)


@method
def intervalantijoin(left: Table, right: Table, lstart: str = "start", lstop: str = "stop", rstart: str = "start", rstop: str = "stop", lkey: Any = None, rkey: Any = None, include_stop: bool = False) -> Table:
    """Left rows that overlap nothing."""
    s = _Sides(left, right, lstart, lstop, rstart, rstop, lkey, rkey, include_stop)
    ids = _identified(s)
    return s.named(ids.join(s.pairs(ids).select("__id").distinct(), "__id", "left_anti"), right=False)


@method
def intervaljoinvalues(left: Table, right: Table, value: str, lstart: str = "start", lstop: str = "stop", rstart: str = "start", rstop: str = "stop", lkey: Any = None, rkey: Any = None, include_stop: bool = False) -> Table:
    """Left rows with an array of the overlapping right rows' values, empty where there are none."""
    s = _Sides(left, right, lstart, lstop, rstart, rstop, lkey, rkey, include_stop)
    v = f"__r{s.right.columns.index(resolve(s.right, value))}"
    rows = _copies(_gathered(s, F.struct(F.col(s.rs).alias("s"), F.col(s.re).alias("e"), F.col(v).alias("v"))).withColumn("x", F.transform(F.filter("x", lambda x, i: i % F.col("n") == 0), lambda x: x["v"])))
    shown = [F.col(f"l.__l{i}").alias(c) for i, c in enumerate(s.left.columns)]
    return Table(rows.select(*shown, F.col("x").alias(unique_names([*s.left.columns, value])[-1]), *([F.col("l.__lo").alias(ORD)] if "__lo" in s.l.columns else [])))


@method
def collapsedintervals(t: Table, start: str = "start", stop: str = "stop", key: Any = None) -> Table:
    """Overlapping and touching intervals merged, within each key; a key of any size is swept in parts, with the furthest stop of the parts before."""
    t = as_table(t)
    keys, s, e = resolve_all(t, key) if key is not None else [], resolve(t, start), resolve(t, stop)
    frame, by, several = segments(Table(t.df, order=[s, e]), keys)
    within = Window.partitionBy(*by, "__part").orderBy(ORD)
    before = F.max(col(e)).over(within.rowsBetween(Window.unboundedPreceding, -1))
    if several:
        frame = carried(frame, by, {"__stop": F.max(col(e))}, {"__stop": F.max})
        before = F.greatest(before, F.col("__stop"))
    marked = frame.withColumn("__first", F.when(before.isNull() | (col(s) > before), F.col(ORD)))
    group = F.max("__first").over(within.rowsBetween(Window.unboundedPreceding, 0))
    if several:
        marked = carried(marked, by, {"__last": F.max("__first")}, {"__last": F.max})
        group = F.coalesce(group, F.col("__last"))
    out = marked.withColumn("__group", group).groupBy(*map(col, keys), "__group").agg(F.min(col(s)).alias(s), F.max(col(e)).alias(e)).drop("__group")
    return Table(out, order=[*keys, s])


@method
def intervalsubtract(left: Table, right: Table, lstart: str = "start", lstop: str = "stop", rstart: str = "start", rstop: str = "stop", lkey: Any = None, rkey: Any = None, include_stop: bool = False) -> Table:
    """What is left of each left interval outside all right ones, a row per remainder."""
    right = collapsedintervals(right, rstart, rstop, rkey)
    s = _Sides(left, right, lstart, lstop, rstart, rstop, lkey, rkey, include_stop)
    both = _gathered(s, F.struct(F.col(s.rs).alias("s"), F.col(s.re).alias("e"))).withColumn("h", F.array_distinct("x"))
    begins = F.concat(F.array(F.col(f"l.{s.ls}")), F.transform("h", lambda h: h["e"]))
    ends = F.concat(F.transform("h", lambda h: h["s"]), F.array(F.col(f"l.{s.le}")))
    out = both.withColumn("p", F.explode(F.arrays_zip(begins.alias("x"), ends.alias("y")))).where("p.x < p.y")
    rows = _copies(out).select("p", "l.*").withColumns({s.ls: F.col("p.x"), s.le: F.col("p.y")})
    return s.named(rows, right=False)


class IntervalLookup:
    """Search for the intervals that hold a point or overlap a range; each search is a filter pushed to the scan."""

    def __init__(self, t: Any, start: str = "start", stop: str = "stop", value: str | None = None, include_stop: bool = False, one: bool = False, strict: bool = True, records: bool = False, facet: tuple[list[str], Any] | None = None):
        self.t = as_table(t)
        self.start, self.stop, self.include_stop, self.one, self.strict, self.records = resolve(self.t, start), resolve(self.t, stop), include_stop, one, strict, records
        self.fields = self.t.columns if value is None else resolve_all(self.t, value)
        self.frame = self.t.df
        if facet:
            for k, v in zip(facet[0], facet[1] if len(facet[0]) > 1 else [facet[1]], strict=True):
                self.frame = self.frame.where(col(k).eqNullSafe(v))

    def search(self, start: Any, stop: Any = None) -> Any:
        s, e = col(self.start), col(self.stop)
        if stop is None:
            test = (s <= start) & ((e >= start) if self.include_stop else (e > start))
        else:
            test = _overlap(F.lit(start), F.lit(stop), s, e, self.include_stop)
        rows = self.frame.where(test).orderBy(s, e).select(*map(col, self.fields))
        found = [r if self.records else r[0] if len(self.fields) == 1 else tuple(r) for r in rows.collect()]
        if not self.one:
            return found
        if len(found) > 1 and self.strict:
            raise DuplicateKeyError((start, stop))
        return found[0] if found else None

    find = search


def intervallookup(t, start="start", stop="stop", value=None, include_stop=False):
    return IntervalLookup(t, start, stop, value, include_stop)


def intervallookupone(t, start="start", stop="stop", value=None, include_stop=False, strict=True):
    return IntervalLookup(t, start, stop, value, include_stop, True, strict)


def intervalrecordlookup(t, start="start", stop="stop", include_stop=False):
    return IntervalLookup(t, start, stop, None, include_stop, records=True)


def intervalrecordlookupone(t, start="start", stop="stop", include_stop=False, strict=True):
    return IntervalLookup(t, start, stop, None, include_stop, True, strict, True)


class FacetLookups:
    """A lookup for each value of a key, made when asked for."""

    def __init__(self, t: Any, key: Any, *args: Any, **kwargs: Any):
        self.t = as_table(t)
        self.keys, self.args, self.kwargs = resolve_all(self.t, key), args, kwargs

    def __getitem__(self, key: Any) -> IntervalLookup:
        return IntervalLookup(self.t, *self.args, facet=(self.keys, key), **self.kwargs)

    def keys_found(self) -> list[Any]:
        return [r[0] if len(self.keys) == 1 else tuple(r) for r in self.t.df.select(*map(col, self.keys)).distinct().collect()]


def facetintervallookup(t, key, start="start", stop="stop", value=None, include_stop=False):
    return FacetLookups(t, key, start, stop, value, include_stop)


def facetintervallookupone(t, key, start="start", stop="stop", value=None, include_stop=False, strict=True):
    return FacetLookups(t, key, start, stop, value, include_stop, True, strict)


def facetintervalrecordlookup(t, key, start="start", stop="stop", include_stop=False):
    return FacetLookups(t, key, start, stop, None, include_stop, records=True)


def facetintervalrecordlookupone(t, key, start="start", stop="stop", include_stop=False, strict=True):
    return FacetLookups(t, key, start, stop, None, include_stop, True, strict, True)


for _f in (intervallookup, intervallookupone, intervalrecordlookup, intervalrecordlookupone, facetintervallookup, facetintervallookupone, facetintervalrecordlookup, facetintervalrecordlookupone):
    method(_f)
