"""Nesting of feature rows into lists, and export in batches of cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CASE_KEY
from ..functions.hashing import case_draw, stable_hash
from ..functions.tokens import each
from .ranking import with_position

CELL_CASES = 10_000


def nest(
    rows: DataFrame, prefix: Sequence[str], focal: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """One row per case and outermost layer. Rows are gathered in focal
    order, then layer by layer from the innermost to the outermost."""
    inner = list(focal)
    for depth in range(len(prefix), 0, -1):
        entry = F.struct(*inner, *values)
        grouped = rows.groupBy(*CASE_KEY, *prefix[:depth]).agg(
            F.sort_array(F.collect_list(entry)).alias("e")
        )
        listed = {v: each(F.col("e"), v) for v in values}
        rows = grouped.withColumns(listed).drop("e")
        inner = [prefix[depth - 1]]
    return rows


def one_row_per_case(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """All rows of a case as one list of structs, in order."""
    fields = [c for c in rows.columns if c not in (*CASE_KEY, *order)]
    entry = F.struct(*order, *fields)
    return rows.groupBy(*CASE_KEY).agg(F.sort_array(F.collect_list(entry)).alias(name))


def in_batches(cases: DataFrame, size: int, cells: int | None = None) -> DataFrame:
    """Numbered batches of ``size`` cases as lists of structs. The order is a
    stable hash of entity and time, so it repeats for the same cases. No task numbers
    all of them: hash cells are numbered one by one, 1,024 of them or as many
    as keep a cell at about ``CELL_CASES`` cases."""
    if cells is None:
        cells = max(1024, -(-cases.count() // CELL_CASES))
    # Rows that carry a name only go by it.
    keyed = {"pid", "pred_dt"} <= set(cases.columns)
    draw = case_draw(cases, "batch") if keyed else stable_hash(F.col("case_id"), "batch")
    order = [c for c in CASE_KEY if c in cases.columns]
    numbered = with_position(cases, [], F.pmod(draw, F.lit(cells)), order, "row_no")
    entry = F.struct("row_no", *cases.columns)
    batches = numbered.groupBy(F.expr(f"row_no div {size}").alias("batch")).agg(
        F.sort_array(F.collect_list(entry)).alias("rows")
    )
    return batches
