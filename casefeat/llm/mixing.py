"""Mixing sources to target weights by systematic sampling, in SQL functions.

Inside a source the documents stand in one line, by size and then by a hash;
each takes the same stretch of the line, its expected number of copies. One
random offset shifts the line, and a document is emitted once for every whole
number inside its stretch. As neighbours are equally long, a source's words
come near its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, n_words, settle

CAP = 3


def source_targets(sized: DataFrame, cap: int = CAP) -> DataFrame:
    """``(source, sid, source_size, target)`` from ``(source, size)`` rows.

    Sources by code point, null last, weigh 1, 2, 3, repeating. They share
    the sum of all sizes; a target stops at ``cap`` times its source's size
    and the excess is shared again by weight. The rounds of sharing are
    aggregates over one row per source; one number comes to the driver.
    """
    totals, _ = settle(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    line = Window.orderBy(F.col("source").asc_nulls_last())
    place = totals.withColumn("sid", F.row_number().over(line) - 1)
    weighed, _ = settle(place.withColumn("weight", F.col("sid") % 3 + 1), "weights")
    limit = F.col("source_size") * cap
    everything, weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (everything or 0) / (weight or 1)
    while True:
        full = limit < F.lit(level) * F.col("weight")
        spent, free = weighed.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        again = ((everything or 0) - spent) / free if free else level
        if again <= level:
            break
        level = again
    target = F.least(F.lit(level) * F.col("weight"), limit.cast("double"))
    return weighed.select("source", "sid", "source_size", target.alias("target"))


def unit_hash(value: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value, F.lit("\x00"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2**52)


def row_hash(docs: DataFrame) -> Column:
    """A hash of a row's columns, nulls told apart by their place."""
    columns = [docs[f"`{c}`"] for c in docs.columns]
    return F.xxhash64(*columns, F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in columns]))


def mix(docs: DataFrame, seed: int = 0, cap: int = CAP) -> DataFrame:
    """``(doc_id, text_hash, row_hash, source, size, source_size, target,
    copies)`` of every row: how often the mix takes it. ``size`` is the number of words,
    ``row_hash`` a hash of all columns.

    The same rows and seed give the same copies, however partitioned. Rows
    equal in all columns are interchangeable. A null text has size 0, a
    null source is a source, a null doc_id an id. A source without words has
    target 0 and nothing is taken. Places in a source are found without
    sorting it in one task: ranks inside (source, size, hash byte), offsets
    from counts.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    thin = docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"),
        row_hash(docs).alias("row_hash"), digest.alias("h"),
    )
    sized, _ = settle(thin, "sizes")
    targets, _ = settle(source_targets(sized, cap), "targets")
    rows = sized.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    rows = rows.withColumn("hb", F.substring("h", 1, 2))
    cells = rows.groupBy("sid", "size", "hb").agg(F.count("*").alias("n"))
    sizes = cells.groupBy("sid", "size").agg(F.sum("n").alias("n"))
    up_to = (Window.unboundedPreceding, -1)
    smaller = F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("size").rowsBetween(*up_to)), F.lit(0))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("sid", "size").orderBy("hb").rowsBetween(*up_to)), F.lit(0))
    offsets = cells.withColumn("b", before).join(sizes.withColumn("s", smaller).drop("n"), ["sid", "size"])
    offsets, _ = settle(offsets.select("sid", "size", "hb", (F.col("b") + F.col("s")).alias("offset")), "offsets")
    inside = Window.partitionBy("sid", "size", "hb").orderBy("h", "doc_id", "text_hash", "row_hash")
    placed = rows.withColumn("r", F.row_number().over(inside) - 1).join(offsets, ["sid", "size", "hb"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = F.col("offset") + F.col("r")
    shift = unit_hash(F.col("source"), seed)
    copies = F.floor(rate * (at + 1) + shift) - F.floor(rate * at + shift)
    return placed.select("doc_id", "text_hash", "row_hash", "source", "size", "source_size", "target", copies.alias("copies"))


def mixed_rows(docs: DataFrame, seed: int = 0, cap: int = CAP) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with
    all its columns. Rows that differ in any column are taken each by itself;
    of wholly equal ones the copies add up."""
    taken = mix(docs, seed, cap).groupBy("doc_id", "row_hash", "source")
    counts, _ = settle(taken.agg(F.sum("copies").alias("__copies"), F.count("*").alias("__n")), "copies")
    if not counts.where("__n > 1").isEmpty():
        docs = docs.dropDuplicates()
    wanted = counts.where("__copies > 0").select(
        F.col("doc_id").alias("__d"), F.col("row_hash").alias("__r"), F.col("source").alias("__s"), "__copies"
    )
    met = docs.join(
        wanted,
        docs["doc_id"].eqNullSafe(wanted["__d"]) & (row_hash(docs) == wanted["__r"]) & docs["source"].eqNullSafe(wanted["__s"]),
    )
    each, columns = fresh(docs, "copy"), [docs[f"`{c}`"] for c in docs.columns]
    return met.select(*columns, F.explode(F.sequence(F.lit(1), wanted["__copies"])).alias(each)).drop(each)
