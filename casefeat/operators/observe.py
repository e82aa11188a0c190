"""Check periods and the interval join of cases with records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CheckPeriod
from ..constants import CASE_KEY, UNIT_MICROS
from ..functions.hashing import stable_hash
from ..functions.timing import DISTANCE, bucket, micros, shifted
from ..session import estimated_bytes, materialize
from .survey import Survey, reached, spread, survey

# Columns that place an observed row: rows of one cell lie together.
CELL = ("pid", "__b", "__part")

# A list of hot cells longer than this is joined without a broadcast.
MAX_BROADCAST_CELLS = 100_000

# Rows of one entity and time bucket that one task may number.
MAX_CELL_ROWS = 1_000_000

# Records of more bytes than this (Spark's estimate of the columns read) are
# surveyed before they are shuffled; below, the survey costs more than it saves.
SURVEY_BYTES = 1 << 30


def check_period(cases: DataFrame, period: CheckPeriod) -> DataFrame:
    """Cases with the window ``[dt_start, dt_end)`` of the period."""
    return cases.withColumns(
        {
            "dt_start": shifted(F.col("pred_dt"), period.start_us),
            "dt_end": shifted(F.col("pred_dt"), period.end_us),
        }
    )


def _with_window(cases: DataFrame, period: CheckPeriod) -> DataFrame:
    """Window bounds as microseconds, half-open."""
    at = micros(cases, "pred_dt")
    first = period.start_us + (1 if period.start_exclusive else 0)
    return cases.withColumns(
        {"__p": at, "__s": at + F.lit(first), "__e": at + F.lit(period.end_us)}
    )


def observe(
    cases: DataFrame,
    records: DataFrame,
    period: CheckPeriod,
    how: str = "auto",
    width_us: int | None = None,
    hot_cell_rows: int | None = None,
    prune: bool = False,
    partitions: int | None = None,
    keep_cell: bool = False,
    found: Survey | None = None,
) -> DataFrame:
    """One row per case and record of its entity inside the period.

    ``plain`` joins on the entity and checks the window as a condition.
    ``bucketed`` cuts time into buckets of the window's length, so a case
    meets at most two buckets of its entity and an entity's history is
    spread over many tasks. ``hot_cell_rows`` additionally splits every
    (entity, bucket) cell with more records than that. ``surveyed`` needs no
    such number: it looks at both sides first (:func:`join_survey`; ``found``
    where that was done), cuts the records to the times and cells that windows
    reach before they are shuffled, and splits the cells where too many pairs
    meet. ``auto`` is ``surveyed`` for records above ``SURVEY_BYTES``, else
    ``bucketed``; all forms give the same rows. ``prune`` first cuts
    the records to the time range the cases can reach. ``partitions`` fixes
    the number of join tasks, for windows so crowded that the pairs far
    outgrow the shuffled input. ``keep_cell`` leaves
    the columns the join was made on (``CELL``) in the result, and the time
    distance in microseconds.
    """
    if how == "auto":
        how = join_form(records, hot_cell_rows)
    if how not in ("plain", "bucketed", "surveyed"):
        raise ValueError(f"how must be auto, plain, bucketed or surveyed, got {how!r}")
    if prune:
        records = prune_records(cases, records, period)
    keys = ["pid"]
    if how == "plain":
        windows, rows = _with_window(cases, period), records.withColumn("__u", micros(records, "dt"))
    else:
        windows, rows = _sides(cases, records, period, width_us)
        keys.append("__b")
    if how == "bucketed" and hot_cell_rows is not None:
        windows, rows = _split_hot_cells(windows, rows, hot_cell_rows)
        keys.append("__part")
    if how == "surveyed":
        found = found or survey(windows, rows)
        rows = reached(_in_time(rows, found.low, found.high), found)
        windows, rows, more = spread(windows, rows, found)
        keys += more
    if partitions is not None:
        windows, rows = (side.repartition(partitions, *keys) for side in (windows, rows))
    inside = (F.col("__u") >= F.col("__s")) & (F.col("__u") < F.col("__e"))
    joined = windows.alias("c").join(rows.alias("r"), [F.col(f"c.{k}") == F.col(f"r.{k}") for k in keys] + [inside])
    left = [F.col(f"c.{c}") for c in cases.columns]
    if keep_cell:
        left += [F.col(f"c.{k}") for k in keys[1:]]
        left.append((F.col("c.__p") - F.col("r.__u")).alias(DISTANCE))
    right = [F.col(f"r.{c}") for c in records.columns if c not in {*cases.columns}]
    return joined.select(*left, *right)


def join_form(records: DataFrame, hot_cell_rows: int | None = None) -> str:
    """The form of the interval join that ``auto`` stands for."""
    big = hot_cell_rows is None and estimated_bytes(records) > SURVEY_BYTES
    return "surveyed" if big else "bucketed"


def join_survey(cases: DataFrame, records: DataFrame, period: CheckPeriod, width_us: int | None = None) -> Survey:
    """What a surveyed join of these sides has to know; it holds for any part
    of the cases and of the records as well."""
    return survey(*_sides(cases, records, period, width_us))


def _sides(
    cases: DataFrame, records: DataFrame, period: CheckPeriod, width_us: int | None
) -> tuple[DataFrame, DataFrame]:
    """Windows and records with the buckets of time they meet on."""
    width = width_us or period.length_us
    first, last = bucket(F.col("__s"), width), bucket(F.col("__e") - 1, width)
    windows = _with_window(cases, period).withColumn("__b", F.explode(F.sequence(first, last)))
    rows = records.withColumn("__u", micros(records, "dt"))
    return windows, rows.withColumn("__b", bucket(F.col("__u"), width))


def window_pairs(cases: DataFrame, records: DataFrame, period: CheckPeriod) -> tuple[int, int, int]:
    """How many pairs the bucketed join tries, and how many records and cases
    there are: from counts per (entity, bucket), without joining any."""
    windows, rows = _sides(cases, records, period, None)
    cell = ["pid", "__b"]
    n, m = (side.groupBy(*cell).agg(F.count("*").alias(c)) for side, c in ((rows, "n"), (windows, "m")))
    both = n.join(m, cell, "full").agg(
        F.sum(F.col("n").cast("double") * F.col("m")).alias("pairs"), F.sum("n").alias("n"), F.sum("m").alias("m")
    ).first()
    return int(both.pairs or 0), both.n or 0, both.m or 0


# Bits of a mask of windows.
MAX_WINDOWS = 62


def hull(periods: Sequence[CheckPeriod]) -> list[tuple[int, int]]:
    """The stretches of time that any of the periods covers, disjoint and in
    order, as microseconds from the case (half-open)."""
    out: list[tuple[int, int]] = []
    for first, last in sorted((p.start_us, p.end_us) for p in periods):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def observe_windows(
    cases: DataFrame, records: DataFrame, periods: Sequence[CheckPeriod], mask: str = "windows",
    width_us: int | None = None, how: str = "auto",
) -> DataFrame:
    """One row per case and record of its entity inside any of the periods,
    with ``mask``: bit ``i`` tells whether the record lies in period ``i``.

    One interval join serves all periods: their windows are cut at their
    bounds into the stretches they cover together, and a record meets a case
    once however many periods overlap there. ``how`` is ``auto``, ``bucketed``
    or ``surveyed``, as for :func:`observe`. A column ``mask`` of the records
    says which periods want the record at all. The time distance in
    microseconds stays in the result.
    """
    if not 0 < len(periods) <= MAX_WINDOWS:
        raise ValueError(f"from 1 to {MAX_WINDOWS} periods fit one join, got {len(periods)}")
    wanted = F.col(mask) if mask in records.columns else F.lit((1 << len(periods)) - 1).cast("bigint")
    rows = records.withColumn(mask, wanted).where(F.col(mask) != 0).withColumn("__u", micros(records, "dt"))
    stretches = hull(periods)
    width = width_us or max(last - first for first, last in stretches)
    spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in stretches])
    windows = cases.withColumn("__p", micros(cases, "pred_dt")).withColumn("__x", F.explode(spans))
    windows = windows.withColumns({"__s": F.col("__p") + F.col("__x.a"), "__e": F.col("__p") + F.col("__x.b")}).drop("__x")
    windows = windows.withColumn("__b", F.explode(F.sequence(bucket(F.col("__s"), width), bucket(F.col("__e") - 1, width))))
    rows = rows.withColumn("__b", bucket(F.col("__u"), width))
    keys = ["pid", "__b"]
    if (join_form(records) if how == "auto" else how) == "surveyed":
        found = survey(windows, rows)
        rows = reached(_in_time(rows, found.low, found.high), found)
        windows, rows, more = spread(windows, rows, found)
        keys += more
    inside = (F.col("__u") >= F.col("__s")) & (F.col("__u") < F.col("__e"))
    meets = [F.col(f"c.{k}") == F.col(f"r.{k}") for k in keys] + [inside]
    joined = windows.alias("c").join(rows.alias("r"), meets)
    away = F.col("r.__u") - F.col("c.__p")
    bits = F.lit(0).cast("bigint")
    for i, p in enumerate(periods):
        first = p.start_us + (1 if p.start_exclusive else 0)
        bits = bits + F.when((away >= first) & (away < p.end_us), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
    left = [F.col(f"c.{c}") for c in cases.columns]
    right = [F.col(f"r.{c}") for c in records.columns if c not in {*cases.columns, mask}]
    out = joined.select(*left, *right, (-away).alias(DISTANCE), bits.bitwiseAND(F.col(f"r.{mask}")).alias(mask))
    return out.where(F.col(mask) != 0)


def _split_hot_cells(windows: DataFrame, rows: DataFrame, limit: int):
    """Spread the records of cells above ``limit`` rows over parts and repeat
    the few windows that meet them, so no cell is one task's work."""
    cell = ["pid", "__b"]
    counts = rows.groupBy(*cell).agg(F.count("*").alias("__n")).where(F.col("__n") > limit)
    hot = materialize(counts.select(*cell, F.ceil(F.col("__n") / limit).cast("int").alias("__parts")))
    if hot.limit(MAX_BROADCAST_CELLS + 1).count() <= MAX_BROADCAST_CELLS:
        hot = F.broadcast(hot)
    parts = F.coalesce(F.col("__parts"), F.lit(1))
    spread = "rec_id" if "rec_id" in rows.columns else "__u"
    draw = F.pmod(stable_hash(F.col(spread), "part"), parts).cast("int")
    rows = rows.join(hot, cell, "left").withColumn("__part", draw).drop("__parts")
    every = F.explode(F.sequence(F.lit(0), parts - 1))
    windows = windows.join(hot, cell, "left").withColumn("__part", every).drop("__parts")
    return windows, rows


def prune_records(cases: DataFrame, records: DataFrame, period: CheckPeriod) -> DataFrame:
    """Records inside the overall time range that the cases can reach. The
    range is read off the cases first (two values), so the scan can skip
    files and row groups by their time statistics."""
    windows = _with_window(cases, period)
    return _in_time(records, *windows.agg(F.min("__s"), F.max("__e")).first())


def _in_time(records: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Records from ``low`` to ``high`` (excluded), none without bounds."""
    if low is None:
        return records.where(F.lit(False))
    low, high = (_instant(records, us) for us in (low, high))
    return records.where((F.col("dt") >= low) & (F.col("dt") < high))


def _instant(records: DataFrame, us: int) -> Column:
    """A constant of the records' own time type."""
    if isinstance(records.schema["dt"].dataType, T.TimestampType):
        return F.timestamp_micros(F.lit(us))
    return shifted(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), us)


def record_count(
    cases: DataFrame,
    records: DataFrame,
    period: CheckPeriod | Mapping[str, CheckPeriod],
    name: str = "rec_num",
    width_us: int = UNIT_MICROS["D"],
    max_cell_rows: int = MAX_CELL_ROWS,
) -> DataFrame:
    """``RecNum``: number of records per case and period, 0 when none; of
    several named periods one column each.

    No case meets a record: window bounds and records are put on one time
    line per (entity, bucket), a running count gives the records before each
    bound, and the count is the difference of its two bounds. Work grows
    with cases + records, however long or crowded the windows are. All
    periods share the line. Buckets of more than ``max_cell_rows`` rows are
    counted first and cut finer.
    """
    periods = {name: period} if isinstance(period, CheckPeriod) else dict(period)
    marks = []
    for i, p in enumerate(periods.values()):
        at = micros(cases, "pred_dt")
        first = p.start_us + (1 if p.start_exclusive else 0)
        for offset, sign in ((first, -1), (p.end_us, 1)):
            marks.append(F.struct((at + F.lit(offset)).alias("u"), F.lit(sign).alias("sign"), F.lit(i).alias("i")))
    bounds = cases.select(*CASE_KEY, F.explode(F.array(*marks)).alias("m"))
    bounds = bounds.select(*CASE_KEY, "m.u", F.lit(0).alias("is_rec"), "m.sign", "m.i")
    rows = records.select("pid", micros(records, "dt").alias("u"), F.lit(1).alias("is_rec"))
    line = bounds.unionByName(rows, allowMissingColumns=True).withColumn("cell", bucket(F.col("u"), width_us))
    # Written once: counting, numbering and adding up all read the line, and
    # the records behind it are scanned a single time.
    line = cut_crowded(materialize(line), width_us, max_cell_rows)
    # A bound sorts before a record of the same instant: it counts records
    # strictly earlier than itself.
    running = (
        Window.partitionBy("pid", "cell", "sub")
        .orderBy("u", "is_rec")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = line.withColumn("inside", F.sum("is_rec").over(running)).where(F.col("is_rec") == 0)
    earlier = Window.partitionBy("pid").orderBy("cell", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        line.groupBy("pid", "cell", "sub")
        .agg(F.sum("is_rec").alias("n"))
        .select("pid", "cell", "sub", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    at_bound = F.col("sign") * (F.col("inside") + F.col("before"))
    counts = [
        F.sum(F.when(F.col("i") == i, at_bound)).cast("bigint").alias(n) for i, n in enumerate(periods)
    ]
    return inside.join(offsets, ["pid", "cell", "sub"]).groupBy(*CASE_KEY).agg(*counts)


def cut_crowded(line: DataFrame, width_us: int, limit: int) -> DataFrame:
    """Column ``sub``: the part of its bucket that a row lies in, from counts;
    0 in buckets of at most ``limit`` rows."""
    counts = line.groupBy("pid", "cell").agg(F.count("*").alias("__n")).where(F.col("__n") > limit)
    crowded = materialize(counts.select("pid", "cell", F.ceil(F.col("__n") * 2 / limit).alias("__parts")))
    if crowded.isEmpty():
        return line.withColumn("sub", F.lit(0).cast("bigint"))
    if crowded.limit(MAX_BROADCAST_CELLS + 1).count() <= MAX_BROADCAST_CELLS:
        crowded = F.broadcast(crowded)
    inside = F.col("u") - F.col("cell") * width_us
    sub = F.floor(inside / width_us * F.coalesce("__parts", F.lit(1)))
    return line.join(crowded, ["pid", "cell"], "left").withColumn("sub", sub).drop("__parts")


def observed_count(cases: DataFrame, observed: DataFrame, name: str = "nrow") -> DataFrame:
    """Rows per case of anything observed, 0 for cases without rows."""
    counts = observed.groupBy(*CASE_KEY).agg(F.count("*").alias(name))
    return cases.join(counts, list(CASE_KEY), "left").withColumn(name, F.coalesce(name, F.lit(0)))
