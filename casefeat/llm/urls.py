"""URL verdicts by rules and, where none fits, by a path-template tree.

Per host the paths form a tree. From the top down, a segment that is rare
among its siblings is variable and becomes a wildcard; frequent siblings
whose labelled shares do not differ beyond chance are merged into one branch.
What the rules decide serves as label: a template whose smoothed share of
allowed pages is too low is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, scratch_folder
from .common import settle

PLAIN_LEVELS = 8
FEW = 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains and the paths that start alike."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


@dataclass(frozen=True)
class Tree:
    """``share`` and ``support``: what part of its siblings' pages, and how
    many, keep a segment literal. ``z``: how far a branch's labelled share
    may be from its siblings' to be merged. ``prior`` and ``strength``: the
    share of allowed pages assumed, and the number of pages it counts as.
    ``depth``: deeper segments share the last template; None: no end."""

    share: float = 0.1
    support: int = 3
    z: float = 1.96
    prior: float = 0.7
    strength: float = 2.0
    least: float = 0.5
    depth: int | None = None


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end. Both empty
    without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = rule.fits(host, path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def template_verdicts(paths: DataFrame, tree: Tree) -> DataFrame:
    """``(host, path, template, purity, verdict)`` of distinct ``paths
    (host, path, n, allowed, blocked)``.

    Each level aggregates pages by (host, template so far, segment), so a
    host with a third of all pages is spread over its segments; the tables of
    a level are written and joined by keys that adaptive execution can split.
    From ``PLAIN_LEVELS`` on, finished paths are set aside before each level,
    and what is left of a branch with few paths is done in one task.
    """
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    if tree.depth is not None:
        parts = F.slice(parts, 1, tree.depth)
    state, path = settle(paths.withColumn("parts", parts).withColumn("template", F.lit("")), "paths")
    depth = state.agg(F.max(F.size("parts"))).first()[0] or 0
    for level in range(min(depth, PLAIN_LEVELS)):
        state, path = _deeper(state, path, level, tree)
    if depth > PLAIN_LEVELS:
        state = _deepest(state, path, tree)
    leaves = state.groupBy("host", "template").agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
    purity = (F.col("a") + tree.strength * tree.prior) / (F.col("a") + F.col("b") + tree.strength)
    judged, _ = settle(leaves.select("host", "template", purity.alias("purity")), "templates")
    verdict = F.when(F.col("purity") < tree.least, "block").otherwise("allow")
    met = state.join(judged, ["host", "template"])
    return met.select("host", "path", "template", "purity", verdict.alias("verdict"))


def _deeper(state: DataFrame, path: str, level: int, tree: Tree) -> tuple[DataFrame, str]:
    spark = state.sparkSession
    longer = F.size("parts") > level
    rows = state.withColumn("part", F.when(longer, F.element_at("parts", F.when(longer, level + 1).otherwise(1))))
    sums = [F.sum(c).alias(c) for c in ("n", "allowed", "blocked")]
    branches, own = settle(rows.where(longer).groupBy("host", "template", "part").agg(*sums), "branches")
    common = (F.col("n") >= tree.support) & (F.col("n") >= tree.share * F.col("all_n"))
    parents, up = settle(
        branches.groupBy("host", "template").agg(
            F.sum("n").alias("all_n"), F.sum("allowed").alias("all_a"), F.sum("blocked").alias("all_b")
        ),
        "parents",
    )
    labelled, every = F.col("allowed") + F.col("blocked"), F.col("all_a") + F.col("all_b")
    share = F.col("all_a") / every
    apart = F.abs(F.col("allowed") / labelled - share) > tree.z * F.sqrt(share * (1 - share) / labelled)
    name = (
        F.when(~common, "*")
        .when(labelled == 0, "{unknown}")
        .when(apart | ((share > 0) & (share < 1) & ((F.col("allowed") == 0) | (F.col("blocked") == 0))), F.col("part"))
        .otherwise("{alike}")
    )
    named = branches.join(parents, ["host", "template"]).select("host", "template", "part", name.alias("name"))
    names, down = settle(named, "names")
    met = rows.join(names, ["host", "template", "part"], "left")
    deeper = F.when(longer, F.concat("template", F.lit("/"), "name")).otherwise(F.col("template"))
    out, new = settle(met.select("host", "path", "n", "allowed", "blocked", "parts", deeper.alias("template")), "paths", drop=path)
    for folder in (own, up, down):
        discard(spark, folder)
    return out, new


FINISHED = "host string, path string, n long, allowed long, blocked long, template string"


def _deepest(state: DataFrame, path: str, tree: Tree) -> DataFrame:
    """All levels from ``PLAIN_LEVELS`` on."""
    spark = state.sparkSession
    folder = scratch_folder(spark, "finished")
    columns = [c.split()[0] for c in FINISHED.split(", ")]
    level = PLAIN_LEVELS
    while True:
        longer = state.where(F.size("parts") > level)
        state.where(F.size("parts") <= level).select(*columns).write.mode("append").parquet(folder)
        counted, own = settle(longer.groupBy("host", "template").agg(F.count("*").alias("paths")), "branches")
        few = longer.join(counted.where(F.col("paths") <= FEW), ["host", "template"], "left_semi")
        few.groupBy("host", "template").applyInPandas(_finisher(level, tree, columns), FINISHED).write.mode("append").parquet(folder)
        many = counted.where(F.col("paths") > FEW)
        if many.isEmpty():
            return spark.read.schema(FINISHED).parquet(folder)
        state, path = settle(longer.join(many, ["host", "template"], "left_semi"), "paths", drop=path)
        discard(spark, own)
        state, path = _deeper(state, path, level, tree)
        level += 1


def _finisher(level: int, tree: Tree, columns: list[str]):
    def finish(group: pd.DataFrame) -> pd.DataFrame:
        return _finished(group, level, tree)[columns]

    return finish


def _finished(group: pd.DataFrame, level: int, tree: Tree) -> pd.DataFrame:
    """The paths of one branch with their last template, by the same rules."""
    parts = group["parts"].tolist()
    n, allowed, blocked = (group[c].tolist() for c in ("n", "allowed", "blocked"))
    out = group["template"].tolist()
    open_ = [(list(range(len(parts))), level)]
    while open_:
        rows, at = open_.pop()
        branches: dict[str, list[int]] = {}
        for k in rows:
            if len(parts[k]) > at:
                branches.setdefault(parts[k][at], []).append(k)
        sums = {p: [sum(c[k] for k in own) for c in (n, allowed, blocked)] for p, own in branches.items()}
        whole = [sum(c) for c in zip(*sums.values(), strict=True)]
        named: dict[str, list[int]] = {}
        for part, own in branches.items():
            named.setdefault(_name(part, sums[part], whole, tree), []).extend(own)
        for name, own in named.items():
            template = f"{out[own[0]]}/{name}"
            for k in own:
                out[k] = template
            open_.append((own, at + 1))
    return group.assign(template=out)


def _name(part: str, own: list[int], whole: list[int], tree: Tree) -> str:
    n, allowed, blocked = own
    labelled, every = allowed + blocked, whole[1] + whole[2]
    if n < tree.support or n < tree.share * whole[0]:
        return "*"
    if labelled == 0:
        return "{unknown}"
    share = whole[1] / every
    apart = abs(allowed / labelled - share) > tree.z * math.sqrt(share * (1 - share) / labelled)
    return part if apart or (0 < share < 1 and (allowed == 0 or blocked == 0)) else "{alike}"


def url_verdicts(pages: DataFrame, rules: Sequence[Rule] = RULES, tree: Tree | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)`` of every
    page: the longest rule decides, else the page's template.

    A null url and one without ``://`` have empty host and path, no rule, and
    the verdict of the empty template; so do repeated rows and null page_ids
    like any other. Templates without labelled pages are allowed. Other
    columns are not read; an empty table gives an empty one.
    """
    host, path = host_and_path(F.col("url"))
    thin, _ = settle(pages.select("page_id", host.alias("host"), path.alias("path")), "pages")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    distinct = thin.groupBy("host", "path").agg(F.count("*").alias("n"))
    ruled = distinct.withColumn("rule", name).withColumn("ruled", verdict)
    counted, _ = settle(
        ruled.withColumn("allowed", F.when(F.col("ruled") == "allow", F.col("n")).otherwise(0)).withColumn(
            "blocked", F.when(F.col("ruled") == "block", F.col("n")).otherwise(0)
        ),
        "urls",
    )
    judged = template_verdicts(counted.select("host", "path", "n", "allowed", "blocked"), tree or Tree())
    both, _ = settle(
        counted.select("host", "path", "rule", "ruled").join(judged, ["host", "path"]), "verdicts"
    )
    return thin.join(both, ["host", "path"]).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "verdict").alias("verdict"), "template", "purity"
    )
