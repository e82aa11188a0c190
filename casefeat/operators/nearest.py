"""As-of match: the record nearest to a case on one side of its time."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CheckPeriod
from ..constants import CASE_KEY, UNIT_MICROS
from ..functions.timing import bucket, micros
from ..session import materialize
from .observe import MAX_CELL_ROWS, cut_crowded


@dataclass(frozen=True)
class Nearest:
    """The ``last`` or the ``first`` record of a period."""

    period: CheckPeriod
    pick: str = "last"

    def __post_init__(self):
        if self.pick not in ("last", "first"):
            raise ValueError(f"pick must be last or first, got {self.pick!r}")

    @property
    def bounds(self) -> tuple[int, int]:
        """First and last microsecond of the period, seen from the case."""
        return self.period.start_us + (1 if self.period.start_exclusive else 0), self.period.end_us - 1


def nearest_records(
    cases: DataFrame,
    records: DataFrame,
    wanted: Mapping[str, Nearest],
    columns: Sequence[str] = (),
    width_us: int = UNIT_MICROS["D"],
    max_cell_rows: int = MAX_CELL_ROWS,
) -> DataFrame:
    """One row per case; one column per wanted record, a struct of ``dt``,
    ``rec_id`` and the named columns, null when the period holds none. Of
    records of one instant the smallest ``rec_id`` is nearest; null ids come
    first.

    No case meets a record. Cases and records stand on one time line per
    (entity, bucket); each case takes over the last record before it, or the
    first one after it, from its own bucket, or else from the nearest bucket
    that has one. Work is linear in cases + records, however long periods
    are; all wanted records share the line, and crowded buckets are cut finer
    by counts. Per entity only one row per bucket is looked at together.
    """
    taken = {c.lower() for c in wanted}
    if len(taken) != len(wanted) or taken & set(CASE_KEY):
        raise ValueError("wanted records need names of their own")
    fields = ["dt", "rec_id", *[c for c in columns if c not in ("dt", "rec_id")]]
    at = micros(cases, "pred_dt")
    marks = []
    for i, n in enumerate(wanted.values()):
        first, last = n.bounds
        mark, other = (last, first) if n.pick == "last" else (first, last)
        marks.append(F.struct((at + mark).alias("u"), (at + other).alias("limit"), F.lit(i).alias("i")))
    asked = cases.select(*CASE_KEY, F.explode(F.array(*marks)).alias("m"))
    asked = asked.select(*CASE_KEY, "m.u", "m.limit", "m.i")
    rows = records.select("pid", micros(records, "dt").alias("u"), F.struct(*fields).alias("rec"))
    rows = rows.where(F.col("u").isNotNull() & F.col("pid").isNotNull())
    line = asked.unionByName(rows, allowMissingColumns=True).withColumn("cell", bucket(F.col("u"), width_us))
    line = cut_crowded(materialize(line), width_us, max_cell_rows)

    found = None
    for pick in ("last", "first"):
        numbers = [i for i, n in enumerate(wanted.values()) if n.pick == pick]
        if numbers:
            part = _matched(line, numbers, pick)
            found = part if found is None else found.unionByName(part)
    inside = F.when(F.col("pick") == "last", F.col("at") >= F.col("limit")).otherwise(F.col("at") <= F.col("limit"))
    kept = found.select(*CASE_KEY, "i", F.when(inside, F.col("rec")).alias("rec"))
    # One row per case and wanted record: the others of a group are null.
    picked = [F.first(F.when(F.col("i") == i, F.col("rec")), ignorenulls=True).alias(n) for i, n in enumerate(wanted)]
    return kept.groupBy(*CASE_KEY).agg(*picked)


def _matched(line: DataFrame, numbers: list[int], pick: str) -> DataFrame:
    """Each asked mark with the nearest record on its side: ``at`` its time."""
    forward = pick == "last"
    is_record = F.col("i").isNull()
    # Of one instant the smallest id is nearest: walking forward it must come
    # last among records, walking backward too. Marks see records of their
    # own instant, as both bounds are inclusive.
    time = F.col("u") if forward else -F.col("u")
    order = [time, is_record.desc(), F.col("rec.rec_id").desc_nulls_last()]
    entry = F.when(is_record, F.struct(F.col("u").alias("at"), "rec"))
    upto = (Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("pid", "cell", "sub").orderBy(*order).rowsBetween(*upto)
    near = line.withColumn("near", F.last(entry, ignorenulls=True).over(own))
    asked = near.where(F.col("i").isin(numbers))
    # The record a cell hands on to the cells after it.
    last_time = line.where(is_record).groupBy("pid", "cell", "sub").agg(F.max(time).alias("t"))
    edge = line.where(is_record).withColumn("t", time).join(last_time, ["pid", "cell", "sub", "t"])
    handed = edge.groupBy("pid", "cell", "sub").agg(
        F.min_by(F.struct(F.col("u").alias("at"), "rec"), F.struct(F.col("rec.rec_id").isNotNull(), "rec.rec_id")).alias("hand")
    )
    cells = line.select("pid", "cell", "sub").distinct().join(handed, ["pid", "cell", "sub"], "left")
    step = [F.col("cell"), F.col("sub")] if forward else [F.col("cell").desc(), F.col("sub").desc()]
    before = Window.partitionBy("pid").orderBy(*step).rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.withColumn("carried", F.last("hand", ignorenulls=True).over(before)).drop("hand")
    met = asked.join(carried, ["pid", "cell", "sub"], "left")
    got = F.coalesce("near", "carried")
    return met.select(*CASE_KEY, "i", "limit", got["at"].alias("at"), got["rec"].alias("rec"), F.lit(pick).alias("pick"))


def case_function(
    cases: DataFrame, observed: Mapping[str, DataFrame], function: Callable[..., Mapping[str, Column]]
) -> DataFrame:
    """Cases with the values of a function of several observations.

    ``observed`` names tables of one row per case (entity, time and name) or
    per entity (``pid`` only, for attributes without a time); a struct column
    of each is handed to ``function``, null where a case has no row, and it
    returns ``{name: Column}``. Joined one by one on the case, so the case
    set keeps its rows and nothing is multiplied.
    """
    joined = cases.select(*CASE_KEY)
    for name, table in observed.items():
        keys = [c for c in CASE_KEY if c in table.columns]
        if keys not in (list(CASE_KEY), ["pid"]):
            raise ValueError(f"{name!r} must have one row per case or per entity")
        fields = [c for c in table.columns if c not in keys]
        side = table.select(*keys, F.struct(*fields).alias(f"__{name}"))
        joined = joined.join(side, keys, "left")
    values = function(**{n: F.col(f"__{n}") for n in observed})
    return joined.select(*CASE_KEY, *[v.alias(n) for n, v in values.items()])
