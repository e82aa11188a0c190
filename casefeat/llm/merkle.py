"""A Merkle tree over a dataset, level by level with a slot pivot.

Every row is a leaf. Inside a source leaves stand in the order of their ids;
the nodes of a level are dealt to parents by place, and conditional
aggregates spread a parent's children into one column per slot. All slot
columns together hash to the parent, all but a child's own are its siblings.
The roots of the sources are the leaves of one more tree of the same kind.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, settle

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hash of the fields: ``-`` for null, else the number of UTF-8 bytes,
    ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of each group ``g`` with their place ``pos`` in the order and the
    group's size ``n``.

    Rows are dealt by ranges of (group, order) and written once, so a large
    group lies in many tasks; a place is that in the own task plus the
    counts of the tasks before.
    """
    line = ["g", *[F.col(c).asc_nulls_first() for c in order]]
    ranges = rows.repartitionByRange(partitions(rows.sparkSession), *line).sortWithinPartitions(*line)
    written, _ = settle(ranges.withColumn("at", F.monotonically_increasing_id()), "merkle-line")
    written = written.withColumn("task", F.shiftright("at", 33))
    counts = written.groupBy("g", "task").agg(F.count("*").alias("k"), F.min("at").alias("first"))
    # One row per task and group: of a group as many as there are partitions.
    line = Window.partitionBy("g").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("k").over(line), F.lit(0)) - F.col("first")
    sizes = counts.withColumn("n", F.sum("k").over(Window.partitionBy("g")))
    offsets = sizes.select("g", "n", "task", before.alias("shift"))
    met = written.join(offsets, ["g", "task"])
    return met.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "task", "shift")


def slots(fanout: int) -> list[str]:
    return [f"s{j}" for j in range(fanout)]


def parents_of(nodes: DataFrame, fanout: int) -> DataFrame:
    """One level up: ``(g, pos, n, s0.., digest)`` from nodes ``(g, pos, n,
    digest)``; groups of one node have arrived at their root and end."""
    up = nodes.where("n > 1").select(
        "g", F.floor(F.col("pos") / fanout).cast("long").alias("pos"), F.ceil(F.col("n") / fanout).cast("long").alias("n"),
        F.pmod("pos", F.lit(fanout)).alias("slot"), "digest",
    )
    children = [F.max(F.when(F.col("slot") == j, F.col("digest"))).alias(s) for j, s in enumerate(slots(fanout))]
    spread = up.groupBy("g", "pos").agg(F.max("n").alias("n"), *children)
    return spread.withColumn("digest", F.sha2(F.concat_ws("", *slots(fanout)), 256))


def levels_over(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """All levels above the leaves, each a written table."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes = [], leaves
    while most > 1:
        nodes, _ = settle(parents_of(nodes, fanout), "merkle-level")
        levels.append(nodes)
        most = -(-most // fanout)
    return levels


def roots_of(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``(g, digest)``: the one node left of each group."""
    ends = [t.where("n = 1").select("g", "digest") for t in (leaves, *levels)]
    return reduce(DataFrame.unionByName, ends)


def with_paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """Leaves with the columns of ``tops`` (one row per group; ``path`` is
    how the group's root goes on), the path led down to the leaf: one entry
    ``(before, after)`` of its siblings per level, lowest first."""
    names = [c for c in tops.columns if c not in ("g", "path")]
    down = None
    for nodes in (*reversed(levels), leaves):
        own = nodes.columns
        ends = nodes.where("n = 1").join(tops, "g").select(*own, *names, "path")
        if down is not None:
            # A parent's row meets its children, so a path is moved once per
            # parent; the slot says which siblings stand before and after.
            above = down.select("g", F.col("pos").alias("__up"), *[F.col(s).alias(f"__{s}") for s in slots(fanout)], *names, F.col("path").alias("__path"))
            up = F.floor(nodes["pos"] / fanout).cast("long")
            met = nodes.where("n > 1").withColumn("__up", up).join(above, ["g", "__up"])
            slot, others = F.pmod("pos", F.lit(fanout)), [F.col(f"__{s}") for s in slots(fanout)]
            before = F.concat_ws("", *[F.when(slot > j, s) for j, s in enumerate(others)])
            after = F.concat_ws("", *[F.when(slot < j, s) for j, s in enumerate(others)])
            step = F.array(F.struct(before.alias("before"), after.alias("after")))
            ends = ends.unionByName(met.select(*own, *names, F.concat(step, "__path").alias("path")))
        down = ends
    return down


def proof_of(path: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda p: F.concat(p["before"], p["after"]))), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along its siblings."""
    return F.aggregate(path, digest, lambda node, p: F.sha2(F.concat(p["before"], node, p["after"]), 256))


def merkle_manifest(docs: DataFrame, received: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """Every row of ``docs`` with ``leaf``, ``subroot`` (of its source),
    ``root``, ``path`` (its siblings up to the root), ``proof_sha256``,
    ``folded_root`` (from the leaf of the text as ``received``, by default
    the text itself) and ``verified``; other columns are left out.

    Leaves of a source ascend by doc_id, null first; rows equal in doc_id
    stand in the order of their digests, wholly equal rows are
    interchangeable. Null and empty sources are two sources, null sorts
    first; a null field hashes as ``-``, an empty text as ``0:``. A source of
    one row has its leaf as subroot, a single source its subroot as root. An
    empty table gives an empty result. Other columns may have any name.

    Levels above a source's leaves hold a half of their number altogether;
    every level is a written table, and the driver gets the largest source's
    size and the root only.
    """
    text = F.col("text").cast("string")
    got = text if received is None else received
    rest = [F.col(c) for c in FIELDS[:-1]]
    # Null first, then by the bytes of the name.
    group = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))
    hashed = docs.select(
        "doc_id", group.alias("g"), leaf_digest([*rest, text]).alias("digest"), leaf_digest([*rest, got]).alias("got")
    )
    leaves, _ = settle(placed(hashed, ["doc_id", "digest", "got"]), "merkle-leaves")
    levels = levels_over(leaves, fanout)
    subroots, _ = settle(roots_of(leaves, levels), "merkle-subroots")
    named = subroots.select(F.lit("").alias("g"), F.col("g").alias("source_key"), "digest")
    sources, _ = settle(placed(named, ["source_key"]), "merkle-sources")
    over = levels_over(sources, fanout)
    root = roots_of(sources, over).first()
    no_step = F.array().cast("array<struct<before:string,after:string>>")
    start = sources.select("g").distinct().withColumn("path", no_step)
    tops, _ = settle(
        with_paths(sources, over, start, fanout).select(F.col("source_key").alias("g"), F.col("digest").alias("subroot"), "path"),
        "merkle-tops",
    )
    led = with_paths(leaves, levels, tops, fanout)
    whole = F.lit(root["digest"] if root else None).cast("string")
    found = led.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", whole.alias("root"), "path",
        proof_of(F.col("path")).alias("proof_sha256"), folded(F.col("got"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_line_breaks(docs: DataFrame, every: int = 2) -> Column:
    """The text as a careless copy has it: line breaks are lost where
    ``every`` divides the checksum of the decimal doc_id."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(every)) == 0
    return F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


__all__ = ["folded", "leaf_digest", "merkle_manifest", "proof_of", "without_line_breaks"]
