"""Row filters: named predicates and completeness thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CheckPeriod, Filter, split_rule
from ..constants import CASE_KEY, DAYPART_HOURS, LEGACY_DAYPART_HOURS, LEVELS
from ..functions.timing import coarser, in_hours, level_micros
from ..session import written

# Good buckets of a case travel as a list on the case up to this many;
# beyond, rows are kept by a semi join.
MAX_LISTED_BUCKETS = 256


def filter_condition(flt: Filter) -> Column | None:
    """The condition that the filter's name stands for; none for ``Whl``."""
    if flt.name == "Whl":
        return None
    if flt.name in flt.predicates:
        predicate = flt.predicates[flt.name]
        return predicate if isinstance(predicate, Column) else predicate(F.col("dt"))
    hours = LEGACY_DAYPART_HOURS if flt.legacy_dayparts else DAYPART_HOURS
    if flt.name not in hours:
        raise ValueError(f"unknown filter {flt.name!r}")
    return in_hours(F.col("dt"), hours[flt.name])


def filter_rows(records: DataFrame, flt: Filter) -> DataFrame:
    """Apply the predicate the filter names; ``Whl`` keeps everything. A
    predicate looks at one record, so it runs before records meet cases."""
    condition = filter_condition(flt)
    return records if condition is None else records.where(condition)


def counts_bare_times(rules: dict[str, float]) -> bool:
    """Whether the rules look at times only, so records of one instant may
    be counted as one."""
    parts = [split_rule(rule) for rule in rules]
    return all(source in ("DT", *LEVELS) and target in LEVELS for source, target in parts)


def good_buckets(rows: DataFrame, rules: dict[str, float], distinct_times: bool = False) -> list[DataFrame]:
    """For each rule ``AInB`` in order: the (case, B) buckets with enough
    distinct values of A. Later rules see the survivors of earlier ones.

    The count is partially aggregated, so a crowded bucket is never gathered
    in one place. ``distinct_times`` says that a case's rows already differ
    in time; times are then counted without telling them apart again, and
    several rules that look at times only are settled in one pass, as one set
    of buckets (:func:`settled_buckets`). Other rows are written once for all
    of several rules.
    """
    if len(rules) > 1 and distinct_times and counts_bare_times(rules):
        return [settled_buckets(rows, rules)]
    if len(rules) > 1:
        rows = written(rows, "bare")
    as_column = {"DT": "dt", "R": "rec_id"}
    found = []
    for rule, need in rules.items():
        source, target = (as_column.get(p, p) for p in split_rule(rule))
        plain = distinct_times and source == "dt"
        n = F.count("*") if plain else F.count_distinct(source)
        good = rows.groupBy(*CASE_KEY, target).agg(n.alias("n")).where(F.col("n") >= need)
        good = good.select(*CASE_KEY, target)
        rows = rows.join(good, good.columns, "left_semi")
        found.append(good)
    return found


def settled_buckets(rows: DataFrame, rules: dict[str, float]) -> DataFrame:
    """The buckets that satisfy all rules in order, for rules on times only:
    (case, B) with the finest B any rule asks for.

    Levels are nested, so whether a time survives is settled by its finest
    bucket. Times are first counted per case and 5 minutes; a case has as many
    such slots as its period, however many records. Slots are placed by case
    once, and every rule is a window over those that the rules before it left.
    """
    slots = rows.groupBy(*CASE_KEY, "5Min").agg(F.count("*").alias("__times")).repartition(*CASE_KEY)
    parts = [split_rule(rule) for rule in rules]
    named = {level for pair in parts for level in pair if level in LEVELS}
    slots = slots.withColumns({level: coarser("5Min", level) for level in LEVELS if level in named - {"5Min"}})
    for (source, target), need in zip(parts, rules.values(), strict=True):
        inside = Window.partitionBy(*CASE_KEY, target)
        if source == "DT":
            n = F.sum("__times").over(inside)
        else:
            same = Window.partitionBy(*CASE_KEY, target, source).orderBy("5Min")
            slots = slots.withColumn("__first", (F.row_number().over(same) == 1).cast("int"))
            n = F.sum("__first").over(inside)
        slots = slots.withColumn("__n", n).where(F.col("__n") >= need).drop("__n", "__first")
    finest = max((target for _, target in parts), key=LEVELS.index)
    return slots.select(*CASE_KEY, finest).distinct()


def keep_full(rows: DataFrame, rules: dict[str, float]) -> DataFrame:
    """Observed rows (with their levels) of buckets that satisfy all rules."""
    if not rules:
        return rows
    times_only = counts_bare_times(rules)
    bare = rows.select(*CASE_KEY, *LEVELS, "dt", *([] if times_only else ["rec_id"]))
    for good in good_buckets(bare.distinct() if times_only else bare, rules, times_only):
        rows = rows.join(good, good.columns, "left_semi")
    return rows


def can_be_listed(target: str, period: CheckPeriod) -> bool:
    """Whether a case has few enough buckets of this level in the period."""
    if target not in LEVELS:
        return False
    if target == "CP":
        return True
    return period.length_us // level_micros(target) + 2 <= MAX_LISTED_BUCKETS


def with_good_lists(cases: DataFrame, listed: list[DataFrame]) -> DataFrame:
    """Cases that can have rows, each with its good buckets per rule."""
    for i, good in enumerate(listed):
        target = good.columns[-1]
        lists = good.groupBy(*CASE_KEY).agg(F.collect_list(target).alias(f"__good{i}"))
        cases = cases.join(lists, list(CASE_KEY))
    return cases


def keep_listed(rows: DataFrame, listed: list[DataFrame]) -> DataFrame:
    """Rows whose bucket is among the case's good ones."""
    for i, good in enumerate(listed):
        name = f"__good{i}"
        rows = rows.where(F.array_contains(name, F.col(good.columns[-1]))).drop(name)
    return rows
