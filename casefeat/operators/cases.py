"""Case sets: which (entity, time) pairs are observed, kept and split."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CASE_KEY
from ..functions.hashing import HASH_RANGE, below_ratio, case_draw
from .ranking import with_rank

SPLITS = ("in_train", "in_valid", "in_test", "out_test")


def trigger_cases(records: DataFrame, case_id: Column | None = None) -> DataFrame:
    """Every distinct (pid, dt) of a record type is a case. The smallest
    ``case_id`` (default: the record id) names it. Names may repeat from one
    entity to the next: a case's key is its name, entity and time together."""
    case_id = F.col("rec_id") if case_id is None else case_id
    keys = ["pid", F.col("dt").alias("pred_dt")]
    return records.groupBy(*keys).agg(F.min(case_id).alias("case_id"))


def entity_groups(entities: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Entities with ``group_id``: the rank of their attribute combination.
    Only the distinct combinations are ranked."""
    combos = entities.select(*attributes).distinct()
    ranked = with_rank(combos, attributes, "group_id")
    matches = [F.col(f"e.{a}").eqNullSafe(F.col(f"g.{a}")) for a in attributes]
    joined = entities.alias("e").join(ranked.alias("g"), matches, "left")
    return joined.select("e.*", "g.group_id")


def filter_cases(cases: DataFrame, counts: DataFrame, condition: Column) -> DataFrame:
    """Keep the cases whose feature values (one row per case) satisfy the
    condition, e.g. enough records before and after."""
    return cases.join(counts.where(condition).select(*CASE_KEY), list(CASE_KEY), "left_semi")


def downsample(cases: DataFrame, ratio: float, seed: str = "downsample") -> DataFrame:
    """Keep about ``ratio`` of the cases; the choice depends on entity and
    time only, so it repeats on any layout and under any name."""
    return cases.where(case_draw(cases, seed) < F.lit(round(ratio * HASH_RANGE)).cast("bigint"))


def split_cases(
    cases: DataFrame, out: float, test: float, valid: float, seed: str = "split"
) -> DataFrame:
    """Column ``split``: whole entities are held out first (``out_test``),
    then single cases go to test, valid or train, by entity and time."""
    if not 0 <= test + valid <= 1:
        raise ValueError("test and valid ratios must sum to at most 1")
    draw = case_draw(cases, seed)
    test_end = round(test * HASH_RANGE)
    valid_end = round((test + valid) * HASH_RANGE)
    split = (
        F.when(below_ratio(F.coalesce(F.col("pid").cast("string"), F.lit("")), out, seed), "out_test")
        .when(draw < F.lit(test_end).cast("bigint"), "in_test")
        .when(draw < F.lit(valid_end).cast("bigint"), "in_valid")
        .otherwise("in_train")
    )
    return cases.withColumn("split", split)


def select_set(cases: DataFrame, selector: str, tags: str = "tags") -> DataFrame:
    """``in_train:C1&t2``: one split, and all of the ``&``-joined group tags.
    ``out_whole`` takes every held-out case."""
    match = re.fullmatch(r"(\w+)(?::(.+))?", selector)
    if not match or match[1] not in (*SPLITS, "out_whole"):
        raise ValueError(f"not a set selector: {selector!r}")
    name, wanted = match[1], match[2]
    condition = F.col("split").startswith("out_") if name == "out_whole" else F.col("split") == name
    for tag in wanted.split("&") if wanted else []:
        condition &= F.array_contains(F.col(tags), tag)
    return cases.where(condition)


def tag_column(named: Mapping[str, Column]) -> Column:
    """Array of the names whose condition holds."""
    picked = F.array(*[F.when(cond, F.lit(name)) for name, cond in named.items()])
    return F.filter(picked, lambda t: t.isNotNull())
