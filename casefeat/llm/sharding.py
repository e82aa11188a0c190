"""A uniform shuffle into shards of exact size by a communication matrix.

Every partition learns from a multivariate hypergeometric draw how many of
its rows go to each shard; it deals its rows out in a random order of its
own, the rows are exchanged, and each shard orders what it got at random
once more. Together this is a uniform permutation with exact shard sizes.
A shard is ordered by random keys in ranges of about 250,000 rows, so its
size, and the number of input partitions, do not bound the parallelism.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import partitions, settle

ROWS_PER_BIN = 250_000


def draw(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """One hypergeometric number. Above the library's limit of 10^9 rows it
    is found by inversion, from the most likely value outwards."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, taken))
    low, high = max(0, taken - bad), min(good, taken)
    mode = min(max(int((taken + 1) * (good + 1) // (good + bad + 2)), low), high)
    spread = int(20 * np.sqrt(taken / (good + bad) * good * bad / (good + bad)) + 50)
    x = np.arange(max(low, mode - spread), min(high, mode + spread) + 1, dtype=np.int64)
    ratio = np.log((good - x[:-1]) * ((taken - x[:-1]) / ((x[:-1] + 1) * (bad - taken + x[:-1] + 1.0))))
    log_p = np.concatenate(([0.0], np.cumsum(ratio)))
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return int(x[np.searchsorted(p, rng.random() * p[-1], side="right").clip(0, len(x) - 1)])


def communication_matrix(rows: list[int], targets: list[int], seed: int) -> np.ndarray:
    """How many rows each partition sends to each target: a random matrix
    with exactly these row and column sums, as of a uniform permutation."""
    if sum(rows) != sum(targets):
        raise ValueError("the targets must hold exactly the rows there are")
    rng = np.random.default_rng([seed, 1])
    left = np.array(targets, np.int64)
    out = np.zeros((len(rows), len(targets)), np.int64)
    for i, n in enumerate(rows):
        rest = int(left.sum())
        for j, room in enumerate(left.tolist()):
            if n == 0:
                break
            rest -= room
            take = draw(rng, room, rest, n) if rest else n
            out[i, j] = take
            n -= take
        left -= out[i]
    return out


def equal_parts(n: int, parts: int) -> list[int]:
    """``n`` in ``parts`` whole numbers at most one apart, larger ones first."""
    return [n // parts + (k < n % parts) for k in range(parts)]


def bins_per_shard(rows: int, shards: int, width: int) -> int:
    """Ranges of keys that a shard is ordered in: one task each."""
    return max(1, -(-rows // (shards * ROWS_PER_BIN)), -(-width // shards))


def drawn(share: np.ndarray, seed: int, p: int, per_shard: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, key)`` of each row of partition ``p``: its shard at random, as
    often as the matrix says, and a random key, whose range is the bin. The
    same for the same arguments, without looking at a row."""
    rng = np.random.default_rng([seed, 2, p])
    where = rng.permutation(np.repeat(np.arange(len(share), dtype=np.int64), share))
    key = rng.integers(0, 2**63 - 1, len(where), dtype=np.int64)
    return where * per_shard + ((key >> 31) * per_shard >> 32), key


def shard_rows(df: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """All rows of ``df`` with ``shard`` and ``slot``.

    Shard sizes are at most one apart (law ``rows``), slots run from 0
    without gaps, and every placement of the rows is equally likely; so equal
    texts fall apart like any other rows. Nulls, empty texts and repeated
    rows are rows like any other; an empty table gives an empty one. Columns
    ``shard`` and ``slot`` of the input are replaced. With fewer rows than
    shards the last shards stay empty.

    The input is checkpointed first: counting, dealing and any retry must see
    the same partitions. The driver gets one count per partition and draws a
    matrix of partitions times shards; rows only move once. Where a range of
    keys begins in its shard follows from the draws, which are repeated for
    that without reading a row.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    # Inside, columns go by their places, so no name clashes.
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    fixed = materialize(df.select(*[df[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(keep)]))
    counted = fixed.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    counts = {r["p"]: r["n"] for r in counted.collect()}
    total = sum(counts.values())
    order = sorted(counts)
    per_shard = bins_per_shard(total, shards, partitions(spark))
    matrix = communication_matrix([counts[p] for p in order], equal_parts(total, shards), seed)
    sent = sc.broadcast({p: matrix[k] for k, p in enumerate(order)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("p").to_pylist():
                bins, n = np.unique(drawn(sent.value[p], seed, p, per_shard)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), pa.array(n, pa.int64())], ["bin", "n"])

    which = spark.createDataFrame([(p,) for p in order], "p int").repartition(partitions(spark), "p")
    sizes = which.mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    sizes = sizes.withColumn("shard", F.expr(f"cast(bin div {per_shard} as int)"))
    earlier = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")
    places, _ = settle(sizes.select("bin", "shard", first), "shard-places")
    added = [T.StructField(n, t) for n, t in (("bin", T.LongType()), ("key", T.LongType()), ("origin", T.LongType()))]
    schema = T.StructType([*fixed.schema.fields, *added])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        where, key = drawn(sent.value[p], seed, p, per_shard) if p in sent.value else (None, None)
        at = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            origin = (np.int64(p) << 40) + np.arange(at, at + n)
            arrays = [*batch.columns, pa.array(where[at : at + n]), pa.array(key[at : at + n]), pa.array(origin)]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "bin", "key", "origin"])
            at += n

    dealt = fixed.mapInArrow(deal, schema)
    line = Window.partitionBy("bin").orderBy("key", "origin")
    placed = dealt.withColumn("rank", F.row_number().over(line) - 1).join(places, "bin")
    named = [F.col(f"c{k}").alias(c) for k, c in enumerate(keep)]
    return placed.select(*named, "shard", (F.col("first") + F.col("rank")).alias("slot"))
