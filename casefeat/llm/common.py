"""Helpers shared by the operators: written tables, links, blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, scratch_folder

WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"


def settle(df: DataFrame, name: str, drop: str | None = None) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: cuts lineage, and
    what follows is the same rows whatever executors are lost. ``drop`` is a
    folder no longer needed once this one is written."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    if drop:
        discard(spark, drop)
    return spark.read.schema(df.schema).parquet(path), path


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Runs of characters that are not ASCII white space; 0 for null."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "))
    gaps = F.length(squeezed) - F.length(F.translate(squeezed, " ", ""))
    return F.when(squeezed == "", 0).otherwise(gaps + 1).cast("long")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every vertex of ``edges (a, b)``, the component
    named by its smallest id.

    Alternating large-star and small-star steps; each is a partial
    aggregation of the smallest neighbour and one join, so a hub is split by
    adaptive execution and nothing is collected. The steps' tables are
    written and the previous one deleted. Ends when a step changes nothing:
    then every vertex hangs on the smallest one.
    """
    spark = edges.sparkSession
    edge = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edge, path = settle(edge.where("u > v").distinct(), "edges")
    before = None
    while True:
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edge, path = _star(both, F.least("u", F.min("v")), edge.sparkSession, path, large=True)
        edge, path = _star(edge, F.min("v"), spark, path, large=False)
        now = edge.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edge.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edge.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _star(edge, smallest, spark, path, large):
    least, least_path = settle(edge.groupBy("u").agg(F.min("v").alias("__m")), "stars")
    met = edge.join(least.withColumnRenamed("u", "__u"), F.col("u") == F.col("__u"))
    m = F.least("u", "__m")
    if large:
        moved = met.where("v > u").select(F.col("v").alias("u"), m.alias("v"))
    else:
        moved = met.where("v > __m").select(F.col("v").alias("u"), F.col("__m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("__m").alias("v")))
    edge, path = settle(moved.distinct(), "edges", drop=path)
    discard(spark, least_path)
    return edge, path


def split_crowded(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Rows with a group id ``grp`` and the pair of pieces ``(ci, cj)`` that
    meet there. A key of at most ``limit`` rows is one group. The rows of a
    larger one are dealt into pieces of about ``limit / 2`` rows by a hash,
    and every two pieces meet in one group: any two rows of a key still meet,
    in groups of bounded size. Rows of one piece meet where ``ci = cj``
    (``mine`` is the row's own piece)."""
    counts = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > limit)
    pieces = F.ceil(F.col("__n") * 2 / limit).cast("int")
    crowded, _ = settle(counts.select(F.col(key).alias("__k"), pieces.alias("__c")), "crowded")
    if crowded.isEmpty():
        tagged = rows.withColumn("__c", F.lit(1))
    else:
        tagged = rows.join(crowded, rows[key] == F.col("__k"), "left").drop("__k")
    others = [c for c in rows.columns if c != key]
    mine = F.pmod(F.xxhash64(*others), F.coalesce("__c", F.lit(1))).cast("int")
    tagged = tagged.withColumn("mine", mine)
    pieces = F.sequence(F.lit(0), F.coalesce("__c", F.lit(1)) - 1)
    out = tagged.withColumn("__o", F.explode(pieces)).drop("__c")
    out = out.withColumn("ci", F.least("mine", "__o")).withColumn("cj", F.greatest("mine", "__o")).drop("__o")
    return out.withColumn("grp", F.xxhash64(key, "ci", "cj"))


def grouped_batches(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Cut a partition sorted by ``keys`` into tables of whole groups, each of
    ``rows`` rows or little more; only a group larger than that exceeds it."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        starts = group_starts(table, keys)
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut)
            held, n = table.slice(cut).to_batches(), table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` nodes over links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
