"""Quality rules: statistics of whole texts and a learned decision list over them, in DataFrame functions alone.

``measured`` gives each document's statistics, without a shuffle: words, lines and five-word windows are arrays of the row.
A window repeats if its hash (64 bits, within one text) occurs twice; only texts whose windows are not all distinct sort them.

``learn`` finds an ordered list of rules by sequential covering. A rule is a conjunction of thresholds, ``symbols > 0.02 and n_words <= 90``. It grows
on one fold of the labelled rows by the threshold of highest FOIL gain, is pruned from its end on the other fold, and is
taken if it covers ``COVERED`` bad rows there or more, and ``PRECISION`` of all it covers are bad; covered rows then leave and the next rule is sought. Thresholds are quantiles
of either label's rows. Each step is one aggregation of all labelled rows, binned once and written, by statistic and bin: the driver gets at most
``2 * BINS`` rows for each statistic. ``expression`` turns the list into nested conditionals; the first rule that fits gives the verdict, and what fits none is kept.

Results: null and empty texts have no words, zero statistics and fail the base rule. Rows that share a ``doc_id`` are judged each. A label counts for every
document with its ``doc_id``; null labels and labels without a document count for none; without labels of both kinds no rule is learnt. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from math import log2
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, written

#: Fixed by the contract.
WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"
WINDOW, LEAST_WORDS, REPEATED_PERCENT = 5, 10, 20

BINS, CONDITIONS, RULES = 24, 4, 12
PRECISION, COVERED = 0.95, 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("n_words", "mean_word", "symbols", "capitals", "digits", "marks", "repeated", "distinct", "dup_lines", "line_words")


class Condition(NamedTuple):
    """``value > threshold`` (or ``<=``) of a statistic; ``bin`` is the threshold's place among the statistic's."""

    name: str
    above: bool
    threshold: float
    bin: int

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"

    def fits(self, value: Column) -> Column:
        return value > self.threshold if self.above else value <= self.threshold


class Rule(NamedTuple):
    """Rejects what all its conditions fit; bad and good rows that it covered in the fold that it was pruned on."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` that occur twice or more."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def twice(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return bound(placed, lambda s: bound(F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["p"])), covered))

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def count(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) < F.size(found), twice(found)).otherwise(0)

    return F.when(F.size(words) > WINDOW, bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: bound(windows(h), count))).otherwise(0)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts of ``COUNTS``, ``base_failed`` and the statistics of ``RATES`` of each document."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", text.alias("t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    found = split.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("lines"), repeated_words(F.col("w")).cast("long").alias("n_repeat_words"), F.size(F.array_distinct("w")).alias("distinct_words"),
        *[F.regexp_count("t", F.lit(p)).alias(n) for n, p in (("n_capitals", r"\p{Lu}"), ("n_digits", "[0-9]"), ("n_marks", r"[!?.,;:]"))],
    ).withColumn("n_dup_lines", (F.col("lines.n") - F.col("lines.d")).cast("long"))
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    rates = {
        "mean_word": F.col("word_chars") / words, "symbols": F.col("n_symbols") / chars, "capitals": F.col("n_capitals") / chars, "digits": F.col("n_digits") / chars, "marks": F.col("n_marks") / chars,
        "repeated": F.col("n_repeat_words") / words, "distinct": F.col("distinct_words") / words, "dup_lines": F.col("n_dup_lines") / F.greatest("lines.n", F.lit(1)), "line_words": F.col("n_words") / F.greatest("lines.n", F.lit(1)),
    }
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return found.select("doc_id", *COUNTS, failed.alias("base_failed"), *[v.alias(k) for k, v in rates.items()])


# --- learning -------------------------------------------------------------------------------------------------------

#: Counts of bad and good rows that a conjunction covers and no earlier rule does: by (statistic, bin) of a fold's rows.
Stats = Callable[[Sequence[Rule], Sequence[Condition]], dict[tuple[str, int], tuple[int, int]]]
#: The same of each beginning of a conjunction.
Prefixes = Callable[[Sequence[Rule], Sequence[Condition]], list[tuple[int, int]]]


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """FOIL gain of a narrower conjunction."""
    return bad * (log2(bad / (bad + good)) - log2(bad_before / (bad_before + good_before))) if bad else 0.0


def best_condition(stats: dict[tuple[str, int], tuple[int, int]], thresholds: dict[str, list[float]]) -> Condition | None:
    """The threshold of highest gain over all rows of ``stats``; the first of equals."""
    best, highest = None, 1e-9
    for name, ts in thresholds.items():
        counts = [stats.get((name, b), (0, 0)) for b in range(len(ts) + 1)]
        bad, good = sum(c[0] for c in counts), sum(c[1] for c in counts)
        below_bad = below_good = 0
        for b, t in enumerate(ts):
            below_bad, below_good = below_bad + counts[b][0], below_good + counts[b][1]
            for above, p, n in ((True, bad - below_bad, good - below_good), (False, below_bad, below_good)):
                if p >= COVERED and (gain := _gain(p, n, bad, good)) > highest:
                    best, highest = Condition(name, above, t, b), gain
    return best


def cover(thresholds: dict[str, list[float]], grow: Stats, prune: Prefixes) -> list[Rule]:
    """Sequential covering: rules one by one, each grown and pruned on the rows that no earlier rule covers."""
    rules: list[Rule] = []
    while len(rules) < RULES:
        conditions: list[Condition] = []
        while len(conditions) < CONDITIONS:
            found = best_condition(grow(rules, conditions), thresholds)
            if found is None:
                break
            conditions.append(found)
        if not conditions:
            return rules
        covered = prune(rules, conditions)
        value, length = max(((b - g) / (b + g) if b + g else -1.0, -k) for k, (b, g) in enumerate(covered, 1))
        bad, good = covered[-length - 1]
        if bad < COVERED or bad < PRECISION * (bad + good):
            return rules
        rules.append(Rule(tuple(conditions[:-length]), bad, good))
    return rules


def _binned(name: str, thresholds: list[float]) -> Column:
    """Number of thresholds below the value."""
    return F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t < F.col(name))) if thresholds else F.lit(0)


def _all(conditions: Iterable[Condition], value: Callable[[Condition], Column]) -> Column:
    return reduce(Column.__and__, map(value, conditions), F.lit(True))


def _in_bins(c: Condition) -> Column:
    return F.col(f"b_{c.name}") > c.bin if c.above else F.col(f"b_{c.name}") <= c.bin


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Rates of the labelled documents that pass the base rule, with ``bad`` and the fold ``grows``."""
    marks = labels.where(F.col("quality").isNotNull()).select("doc_id", (F.col("quality") == 0).alias("bad"))
    known = stats.where(~F.col("base_failed")).select("doc_id", *RATES).join(marks, "doc_id")
    return known.select("bad", (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(3)) > 0).alias("grows"), *RATES)


def learn(known: DataFrame) -> list[Rule]:
    """The rules for ``labelled`` rows, in order."""
    at = [k / BINS for k in range(1, BINS)]
    cuts = known.groupBy("bad").agg(*[F.percentile_approx(n, at, 1000).alias(n) for n in RATES]).collect()  # a row for each label
    if len(cuts) < 2:
        return []
    thresholds = {n: sorted({float(t) for row in cuts for t in row[n]}) for n in RATES}
    binned = written(known.select("bad", "grows", *[_binned(n, thresholds[n]).alias(f"b_{n}") for n in RATES]), "quality-bins")

    def left(rules: Sequence[Rule], grows: bool) -> DataFrame:
        fold = F.col("grows") if grows else ~F.col("grows")
        return binned.where(reduce(lambda a, r: a & ~_all(r.conditions, _in_bins), rules, fold))

    def grow(rules: Sequence[Rule], conditions: Sequence[Condition]) -> dict[tuple[str, int], tuple[int, int]]:
        rows = left(rules, True).where(_all(conditions, _in_bins)).select("bad", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"b_{n}").alias("bin")) for n in RATES])).alias("x"))
        found = rows.groupBy("x.name", "x.bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
        return {(r.name, r.bin): (r.p, r.n) for r in found.collect()}

    def prune(rules: Sequence[Rule], conditions: Sequence[Condition]) -> list[tuple[int, int]]:
        parts = [_all(conditions[:k], _in_bins) for k in range(1, len(conditions) + 1)]
        row = left(rules, False).agg(*[F.count_if(p & b).alias(f"{n}{k}") for k, p in enumerate(parts) for n, b in (("p", F.col("bad")), ("n", ~F.col("bad")))]).first()
        return [(row[f"p{k}"], row[f"n{k}"]) for k in range(len(parts))]

    rules = cover(thresholds, grow, prune)
    released(binned)
    return rules


def expression(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Verdict (kept or not) and the first rule that fits, as text, of a row of rates: ordered conditionals."""
    kept, name = F.lit(True), F.lit(None).cast("string")
    for r in reversed(rules):
        fits = _all(r.conditions, lambda c: c.fits(F.col(c.name)))
        kept, name = F.when(fits, False).otherwise(kept), F.when(fits, str(r)).otherwise(name)
    return kept, name


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``measured``, with ``kept`` and the ``rule`` that rejects; texts are read once and never written."""
    stats = written(measured(docs), "quality-stats")
    kept, name = expression(learn(labelled(stats, labels)))
    return stats.select("*", (~F.col("base_failed") & kept).alias("kept"), F.when(F.col("base_failed"), "base").otherwise(name).alias("rule"))


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "rule")


def brute_force(text: str | None) -> tuple[int, int, int, int, int]:
    """The counts of one text, the plain way (for tests)."""
    import re

    t = text or ""
    w, lines = re.findall(WORD, t), [x for x in t.split("\n") if re.search(WORD, x)]
    grams = [tuple(w[i : i + WINDOW]) for i in range(len(w) - WINDOW + 1)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(WINDOW)}
    return len(w), sum(map(len, w)), len(re.findall(SYMBOL, t)), len(lines) - len(set(lines)), len(hit)
