"""Sums per case and time bucket without pairs of cases and records.

Where windows overlap so much that joined rows would far outnumber cases and
records, a bucket's sums are differences of running sums at its two bounds.
Bounds and records stand on one time line per entity, cut into cells, so no
task holds an entity. Work grows with cases + records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CheckPeriod
from ..constants import CASE_KEY, UNIT_MICROS
from ..functions.timing import bucket, level_micros, micros
from .observe import MAX_CELL_ROWS, cut_crowded, window_pairs

# Joined rows per row of a time line from which on the line is the shorter way.
PAIRS_PER_ROW = 16

# Tokens that get a running sum of their own, and buckets of a case, at most;
# beyond, cases and records are joined.
MAX_TOKENS = 64
MAX_STRETCHES = 16

# Whole numbers up to here are exact as doubles.
EXACT = float(1 << 53)


def stretches(period: CheckPeriod, level: str) -> list[tuple[int, int, int]]:
    """``(bucket, first, last)`` of the level's buckets that the period covers,
    as microseconds from the case (half-open). Buckets count away from the case
    and truncate toward zero, so number 0 reaches to both sides."""
    first, last = period.start_us + (1 if period.start_exclusive else 0), period.end_us
    if level == "CP":
        return [(0, first, last)]
    width = level_micros(level)
    number = lambda u: (-u) // width if u <= 0 else -(u // width)
    out = []
    for k in range(number(last - 1), number(first) + 1):
        low = -(k + 1) * width + 1 if k >= 0 else -k * width
        high = -k * width + 1 if k > 0 else (-k + 1) * width
        if max(low, first) < min(high, last):
            out.append((k, max(low, first), min(high, last)))
    return out


def summed_in_line(
    cases: DataFrame, records: DataFrame, period: CheckPeriod, level: str, row_idx: int, unk_idx: int,
    max_cell_rows: int = MAX_CELL_ROWS,
) -> DataFrame | None:
    """``(case, level, idx, v, present)`` of the tokens of ``records`` in each
    case's buckets, rows themselves under ``row_idx``, a stand-in ``unk_idx``
    with an empty level per case; rows of a case lie together. ``None`` where
    joining is as short, and where weights are no whole numbers, as a
    difference would round them."""
    spans = stretches(period, level)
    if not 0 < len(spans) <= MAX_STRETCHES:
        return None
    records = records.where(F.col("pid").isNotNull() & F.col("dt").isNotNull()).select("pid", "dt", "tok")
    pairs, n, m = window_pairs(cases, records, period)
    if pairs <= PAIRS_PER_ROW * (n + 2 * len(spans) * m):
        return None
    weight = F.col("t.w").cast("double")
    found = (
        records.select(F.explode("tok").alias("t")).groupBy(F.col("t.idx").alias("idx"))
        .agg(
            F.min(F.coalesce(weight == F.floor(weight), F.lit(False))).alias("whole"),
            F.sum(F.abs(weight)).alias("total"), F.min(weight).alias("low"), F.max(weight).alias("high"),
        )
        .limit(MAX_TOKENS + 1).collect()
    )
    if len(found) > MAX_TOKENS or not all(r.whole and r.total < EXACT for r in found):
        return None
    # Weights that are all alike follow from their number.
    alike = {r.idx: r.low for r in found if r.low == r.high}
    ids = sorted(r.idx for r in found)
    of_token = F.map_from_entries(F.transform("tok", lambda t: F.struct(t["idx"], t["w"].cast("bigint").alias("w"))))
    rows = records.select("pid", micros(records, "dt").alias("u"), F.lit(1).alias("is_rec"), of_token.alias("__of"))
    rows = rows.select("pid", "u", "is_rec", *[F.col("__of")[i].alias(f"w{i}") for i in ids])
    at = micros(cases, "pred_dt")
    marks = [
        F.struct((at + F.lit(u)).alias("u"), F.lit(k).cast("bigint").alias("k"), F.lit(sign).alias("sign"))
        for k, *bounds in spans for u, sign in zip(bounds, (-1, 1), strict=True)
    ]
    bounds = cases.select(*CASE_KEY, F.explode(F.array(*marks)).alias("m"))
    bounds = bounds.select(*CASE_KEY, "m.u", "m.k", "m.sign", F.lit(0).alias("is_rec"))
    width = min(period.length_us, UNIT_MICROS["D"])
    line = bounds.unionByName(rows, allowMissingColumns=True).withColumn("cell", bucket(F.col("u"), width))
    line = cut_crowded(line, width, max_cell_rows)
    place = ["pid", "cell", "sub"]
    totals: dict[str, Column] = {"n": F.sum("is_rec")}
    for i in ids:
        totals[f"n{i}"] = F.count(f"w{i}")
        if i not in alike:
            totals[f"v{i}"] = F.sum(f"w{i}")
    # A bound sorts before a record of the same instant, so it sees earlier ones.
    running = Window.partitionBy(*place).orderBy("u", "is_rec").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = line.select(
        *CASE_KEY, "k", "sign", "cell", "sub", "is_rec", *[c.over(running).alias(name) for name, c in totals.items()]
    ).where(F.col("is_rec") == 0)
    earlier = Window.partitionBy("pid").orderBy("cell", "sub").rowsBetween(Window.unboundedPreceding, -1)
    cells = line.groupBy(*place).agg(*[c.alias(name) for name, c in totals.items()])
    offsets = cells.select(*place, *[F.sum(name).over(earlier).alias(f"before_{name}") for name in totals])
    none = F.lit(0).cast("bigint")
    # Cases without an entity or a time meet nothing and keep their stand-ins.
    seen = inside.join(offsets, place, "left").select(
        *CASE_KEY, "k", "sign",
        *[(F.col("sign") * (F.coalesce(n, none) + F.coalesce(f"before_{n}", none))).alias(n) for n in totals],
    )
    # The one shuffle by case; all later steps find its rows together.
    summed = seen.repartition(*CASE_KEY).groupBy(*CASE_KEY, "k").agg(
        F.sum((F.col("sign") < 0).cast("bigint")).alias("cases"), *[F.sum(n).alias(n) for n in totals]
    )

    def entry(k: Column, idx: int, value: Column, present: Column) -> Column:
        return F.struct(
            k.cast("bigint").alias("k"), F.lit(idx).alias("idx"), value.cast("double").alias("v"),
            present.cast("bigint").alias("present"),
        )

    entries = [entry(F.col("k"), row_idx, F.col("n"), F.col("n"))]
    for i in ids:
        value = F.col(f"n{i}") * F.lit(alike[i]) if i in alike else F.col(f"v{i}")
        entries.append(entry(F.col("k"), i, value, F.col(f"n{i}")))
    # Every case has the first bucket's row, which brings its stand-in.
    one = F.when(F.col("k") == spans[0][0], F.col("cases")).otherwise(F.lit(0))
    entries += [entry(F.lit(None), i, F.col("cases"), one) for i in (row_idx, unk_idx)]
    long = summed.select(*CASE_KEY, F.explode(F.filter(F.array(*entries), lambda e: e["present"] > 0)).alias("e"))
    return long.select(*CASE_KEY, F.col("e.k").alias(level), "e.idx", "e.v", "e.present")
