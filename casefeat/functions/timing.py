"""Time expressions, in whole microseconds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DAYPART_HOURS, FINER_PER_LEVEL, LEVELS, SECONDS_IN_5MIN

# Microseconds from a record to its case's observation time.
DISTANCE = "__distance"


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without zone."""
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(name)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, F.col(name).cast("timestamp_ntz"))


def shifted(col: Column, offset_us: int) -> Column:
    """``col`` moved by a signed number of microseconds."""
    sign = -1 if offset_us < 0 else 1
    days, rest = divmod(abs(offset_us), 86_400_000_000)
    seconds = F.lit(f"{sign * rest / 1_000_000:.6f}").cast("decimal(18,6)")
    step = F.make_dt_interval(F.lit(sign * days), F.lit(0), F.lit(0), seconds)
    return col + step


def bucket(us: Column, width_us: int) -> Column:
    """Number of the fixed-width bucket that holds ``us`` (exact, floors)."""
    width = F.lit(width_us).cast("bigint")
    return ((us - F.pmod(us, width)) / width).cast("bigint")


def add_relative_time(df: DataFrame) -> DataFrame:
    """Columns CP, M, W, D, H, 5Min of ``dt`` seen from ``pred_dt``. Buckets
    count away from ``pred_dt`` and truncate toward zero, so they are
    negative after it. A distance column, where there is one, is used up."""
    if DISTANCE not in df.columns:
        distance = F.timestamp_diff("MICROSECOND", F.col("dt"), F.col("pred_dt"))
        df = df.withColumn(DISTANCE, distance)
    divisor = SECONDS_IN_5MIN * 1_000_000
    # Truncation composes: dividing twice equals dividing by the product.
    columns = {"5Min": F.expr(f"{DISTANCE} div {divisor}")}
    for level, finer in FINER_PER_LEVEL.items():
        divisor *= finer
        columns[level] = F.expr(f"{DISTANCE} div {divisor}")
    columns["CP"] = F.lit(0).cast("bigint")
    return df.withColumns({level: columns[level] for level in LEVELS}).drop(DISTANCE)


def level_micros(level: str) -> int:
    """Length of one bucket of a level."""
    width = SECONDS_IN_5MIN * 1_000_000
    for name, finer in FINER_PER_LEVEL.items():
        if level == "5Min":
            break
        width *= finer
        if name == level:
            break
    return width


def coarser(level: str, target: str) -> Column:
    """The ``target`` bucket that holds a bucket of the finer ``level``."""
    if target == "CP":
        return F.lit(0).cast("bigint")
    steps = list(FINER_PER_LEVEL)
    first = 0 if level == "5Min" else steps.index(level) + 1
    size = math.prod(FINER_PER_LEVEL[s] for s in steps[first : steps.index(target) + 1])
    return F.expr(f"`{level}` div {size}")


def daypart(dt: Column) -> Column:
    """Name of the part of the day, from the hour."""
    names = F.array(*[F.lit(n) for n in sorted(DAYPART_HOURS, key=DAYPART_HOURS.get)])
    return F.element_at(names, (F.floor(F.hour(dt) / 6) + 1).cast("int"))


def in_hours(dt: Column, hours: tuple[int, int]) -> Column:
    return F.hour(dt).between(*hours)
