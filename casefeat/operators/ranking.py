"""Positions inside large groups without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    cell: Column,
    order: Sequence[str],
    name: str = "pos",
    size: str | None = None,
) -> DataFrame:
    """0-based position of each row in its ``keys`` group, ordered by
    ``(cell, *order)``; a row takes up one place, or ``size`` places.

    ``cell`` cuts a group into consecutive pieces (time buckets, hash
    ranges). Rows are ranked inside a cell only; the rows of all earlier
    cells are counted with a partial aggregation and added.
    """
    keys = list(keys)
    df = df.withColumn("__cell", cell)
    places = F.lit(1).cast("bigint") if size is None else F.col(size).cast("bigint")
    counts = df.groupBy(*keys, "__cell").agg(F.sum(places).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "__cell", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
    )
    inside = (
        Window.partitionBy(*keys, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = df.withColumn("__rank", F.coalesce(F.sum(places).over(inside), F.lit(0)))
    placed = ranked.join(offsets, [*keys, "__cell"])
    return placed.withColumn(name, F.col("__before") + F.col("__rank")).drop(
        "__cell", "__rank", "__before"
    )


def with_rank(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """0-based rank of each row among all rows, ``order`` being unique. Rows
    are dealt out by ranges and written once; a row's rank is its place in its
    range plus the sizes of the ranges before, one number per task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # The id holds the task's number above bit 33 and the place below.
    placed = materialize(ranges.withColumn("__at", F.monotonically_increasing_id()))
    task, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(task.alias("__task")).agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__task", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    ranked = placed.withColumn("__task", task).join(F.broadcast(offsets), "__task")
    return ranked.withColumn(name, F.col("__before") + place).drop("__at", "__task", "__before")
