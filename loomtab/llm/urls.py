"""URL filters by a path-template tree, in DataFrame functions alone.

A url's path is a branch of its host's tree: its segments, each generalised by shape (numbers, hex, slugs, numbered files). Then, level
by level from the root, until no node has two branches below:

* a node with many literal children that each have few urls is variable there: they become one wildcard;
* literal children whose own children are spread like those of all of them (a G-test) merge into one; labels, where a child has
  any, have to be mixed like those of all.

A template is rejected if it has ``labelled`` labelled urls or more and the share of blocked ones among them, smoothed by one url of either
label, reaches ``purity``. Labels are the verdicts of explicit rules, which win in any case; so a branch without rules
gets the verdict of those that it merged with. A rule fits its host and all subdomains, from the start of the path, longest first.

The tree is built on distinct (host, shape) with counts, written after partial aggregation, not on urls; only the rejected shapes
are joined back, from a written table, so that a hot host is split by adaptive skew handling. Pages are read twice: for the
tree and for the verdicts. Levels go on as deep as paths branch; a path that is alone from a node on needs none.

Results: null url, or one without ``://``, has an empty host and path, fits no rule and is allowed unless its own template is rejected,
which labels never reach; a path of any length or depth counts whole; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract, fixed values.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))

WILD_CHILDREN, WILD_URLS, PURITY, LABELLED = 10, 5, 0.8, 4
END = "$"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://((?s:.*))$", 1), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def shape(segment: Column) -> Column:
    """A segment generalised by its form."""
    return (
        F.when(segment == END, "{end}")
        .when(segment.rlike("^[0-9]+$"), "{num}")
        .when(segment.rlike(r"^[0-9]+\.[a-z0-9]+$"), F.concat(F.lit("{num}."), F.substring_index(segment, ".", -1)))
        .when(segment.rlike("^[0-9a-f]{8,}$"), "{hex}")
        .when((F.length(segment) > 24) | (F.regexp_count(segment, F.lit("-")) >= 3), "{slug}")
        .otherwise(segment)
    )


def shaped(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``page_id, host, path, rule, ruled`` and the shapes of the path's segments, ``steps``."""
    host, path = parsed(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(rules, F.col("host"), F.col("path"))
    steps = F.transform(F.split(F.substring("path", 2, (1 << 31) - 1), "/"), shape)
    return rows.select("*", name.alias("rule"), verdict.alias("ruled"), steps.alias("steps"))


def _level(tree: DataFrame, k: int) -> DataFrame:
    """``tree`` of ``host, steps, n, block, allow`` and the generalised steps before level ``k``, ``gen``, with that level's added to them."""
    node = ["host", "gen"]
    deep = tree.where(F.size("steps") >= k).withColumns({"step": F.element_at("steps", k), "child": F.coalesce(F.try_element_at("steps", F.lit(k + 1)), F.lit(END))})
    literal = deep.where(~F.col("step").startswith("{"))
    spread = literal.groupBy(*node, "step", "child").agg(F.sum("n").alias("m"), F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    branch = spread.groupBy(*node, "step").agg(F.sum("m").alias("n"), F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    pool = branch.groupBy(*node).agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("urls"), (F.sum("block") / F.greatest(F.sum("block") + F.sum("allow"), F.lit(1))).alias("share"))
    whole = spread.groupBy(*node, "child").agg(F.sum("m").alias("all_m"))
    pool = pool.join(whole.groupBy(*node).agg((F.count(F.lit(1)) - 1).alias("free")), node)
    variable = (F.col("children") >= WILD_CHILDREN) & (F.col("urls") < WILD_URLS * F.col("children"))
    test = (
        spread.drop("block", "allow").join(whole, [*node, "child"]).join(branch, [*node, "step"]).join(pool, node)
        .groupBy(*node, "step", "children", "urls", "free", "share", "block", "allow").agg(F.sum(2 * F.col("m") * F.log(F.col("m") * F.col("urls") / (F.col("n") * F.col("all_m")))).alias("g"))
    )
    seen = F.greatest(F.col("block") + F.col("allow"), F.lit(1))
    labels_alike = (F.col("block") + F.col("allow") == 0) | (F.abs(F.col("block") / seen - F.col("share")) <= 2 * F.sqrt(F.col("share") * (1 - F.col("share")) / seen) + 1e-6)
    alike = (F.col("children") > 1) & (F.col("g") <= F.col("free") + 3 * F.sqrt(2 * F.col("free")) + 1e-6) & labels_alike
    names = test.select(*node, "step", F.when(variable, "{*}").when(alike, "{merged}").otherwise(F.col("step")).alias("name"))
    named = deep.join(names, [*node, "step"], "left").withColumn("gen", F.concat("gen", F.array(F.coalesce("name", "step"))))
    return named.select(*tree.columns).union(tree.where(F.size("steps") < k))


def template_tree(rows: DataFrame) -> DataFrame:
    """``host, steps`` with the template ``gen`` of each, its labels ``block, allow`` and smoothed ``purity``."""
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "block").alias("block"), F.count_if(F.col("ruled") == "allow").alias("allow")]
    tree = written(rows.groupBy("host", "steps").agg(*counts).withColumn("gen", F.array().cast("array<string>")), "url-tree")
    k = 1
    while tree.where(F.size("steps") >= k).groupBy("host", "gen").count().where("count > 1").limit(1).count():
        tree, k = written(_level(tree, k), "url-tree"), k + 1
    tree = tree.withColumn("gen", F.concat("gen", F.slice("steps", F.size("gen") + 1, F.size("steps"))))
    labels = tree.groupBy("host", "gen").agg(F.sum("block").alias("blocked"), F.sum("allow").alias("allowed"))
    pure = labels.withColumn("purity", (F.col("blocked") + 1) / (F.col("blocked") + F.col("allowed") + 2))
    return tree.join(pure, ["host", "gen"])


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, purity: float = PURITY, labelled: int = LABELLED) -> DataFrame:
    """``page_id, host, path, rule, verdict, template_rejected`` of every page."""
    rows = shaped(pages, rules)
    rejected = template_tree(rows).where((F.col("purity") >= purity) & (F.col("blocked") + F.col("allowed") >= labelled))
    rejected = written(rejected.select("host", "steps", F.lit(True).alias("template_rejected")), "url-rejected")
    out = rows.join(rejected, ["host", "steps"], "left").withColumn("template_rejected", F.coalesce("template_rejected", F.lit(False)))
    verdict = F.coalesce("ruled", F.when(F.col("template_rejected"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template_rejected")


def digest(judged: DataFrame) -> DataFrame:
    return judged


def _sql_level(k: int, levels: int) -> str:
    source, node = f"t{k - 1}", ["host", *(f"g{i}" for i in range(1, k))]
    on, step = ", ".join(node), f"s{k}"
    child = f"s{k + 1}" if k < levels else "'$'"
    return f"""
c{k} AS (SELECT {on}, {step}, child, m, sum(m) OVER (PARTITION BY {on}, {step}) AS n, sum(m) OVER (PARTITION BY {on}, child) AS all_m, sum(m) OVER (PARTITION BY {on}) AS urls,
          sum(block) OVER (PARTITION BY {on}, {step}) AS block, sum(allow) OVER (PARTITION BY {on}, {step}) AS allow,
          sum(block) OVER (PARTITION BY {on}) / greatest(sum(block + allow) OVER (PARTITION BY {on}), 1) AS share
        FROM (SELECT {on}, {step}, {child} AS child, sum(n) AS m, sum(block) AS block, sum(allow) AS allow FROM {source} WHERE NOT starts_with({step}, '{{') AND {step} <> '$' GROUP BY ALL)),
p{k} AS (SELECT {on}, count(DISTINCT {step}) AS children, count(DISTINCT child) - 1 AS free FROM c{k} GROUP BY ALL),
m{k} AS (SELECT {on}, {step}, CASE WHEN children >= {WILD_CHILDREN} AND any_value(urls) < {WILD_URLS} * children THEN '{{*}}'
          WHEN children > 1 AND sum(2 * m * ln(m::DOUBLE * urls / (n * all_m))) <= free + 3 * sqrt(2.0 * free) + 1e-6
            AND (block + allow = 0 OR abs(block / greatest(block + allow, 1) - share) <= 2 * sqrt(share * (1 - share) / greatest(block + allow, 1)) + 1e-6) THEN '{{merged}}' ELSE {step} END AS name
        FROM c{k} JOIN p{k} USING ({on}) GROUP BY {on}, {step}, children, free, block, allow, share),
t{k} AS (SELECT {source}.*, coalesce(name, {step}) AS g{k} FROM {source} LEFT JOIN m{k} USING ({on}, {step})),"""


def _sql_shape(k: int) -> str:
    x = f"parts[{k}]"
    return f"""coalesce(CASE WHEN {x} = '$' THEN '{{end}}' WHEN regexp_full_match({x}, '[0-9]+') THEN '{{num}}' WHEN regexp_full_match({x}, '[0-9]+\\.[a-z0-9]+') THEN '{{num}}.' || split_part({x}, '.', 2)
       WHEN regexp_full_match({x}, '[0-9a-f]{{8,}}') THEN '{{hex}}' WHEN length({x}) > 24 OR length({x}) - length(replace({x}, '-', '')) >= 3 THEN '{{slug}}' ELSE {x} END, '$') AS s{k}"""


def oracle(rules: Sequence[Rule] = RULES, purity: float = PURITY, labelled: int = LABELLED, levels: int = 4) -> str:
    """The same in SQL, for paths of at most ``levels`` segments."""
    longest = sorted(rules, key=lambda r: -len(r.name))
    fits = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN" for r in longest]
    name = "CASE " + " ".join(f"{f} '{r.name}'" for f, r in zip(fits, longest, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"{f} '{r.verdict}'" for f, r in zip(fits, longest, strict=True)) + " END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    steps = [f"s{k}" for k in range(1, levels + 1)]
    whole = "host, " + ", ".join(f"g{k}" for k in range(1, levels + 1))
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {name} AS rule, {verdict} AS ruled, string_split(substr(path, 2), '/') AS parts FROM h),
s AS (SELECT page_id, host, path, rule, ruled, {", ".join(_sql_shape(k) for k in range(1, levels + 1))} FROM r),
t0 AS (SELECT host, {", ".join(steps)}, count(*) AS n, count(*) FILTER (WHERE ruled = 'block') AS block, count(*) FILTER (WHERE ruled = 'allow') AS allow FROM s GROUP BY ALL),
{"".join(_sql_level(k, levels) for k in range(1, levels + 1))}
bad AS (SELECT host, {", ".join(steps)} FROM t{levels} JOIN (SELECT {whole} FROM t{levels} GROUP BY ALL HAVING (sum(block) + 1) / (sum(block) + sum(allow) + 2) >= {purity} AND sum(block) + sum(allow) >= {labelled}) USING ({whole}))
SELECT page_id, s.host, path, rule, coalesce(ruled, CASE WHEN bad.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict, bad.host IS NOT NULL AS template_rejected
FROM s LEFT JOIN bad ON bad.host = s.host AND {" AND ".join(f"bad.{c} = s.{c}" for c in steps)}
"""
