"""Id chains: entity -> ... -> leaf id, and records attached to the leaf."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import keep_all_left
from ..operators.ranking import with_position
from ..session import fit_partitions, materialize


def id_chain(levels: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Distinct id combinations down the chain, every parent kept. A level's
    table holds its own id and at least its parent's. A missing child gets
    ``M`` and the parent's id, so it is unique and repeatable."""
    ids = [name for name, _ in levels]
    fit_partitions(*[df for _, df in levels])
    tables = []
    for i, (name, df) in enumerate(levels):
        known = [c for c in ids[: i + 1] if c in df.columns]
        if name not in known or (i and ids[i - 1] not in known):
            raise ValueError(f"the table of {name!r} lacks its own or its parent's id")
        own = df.select(*[F.col(c).cast("string").alias(c) for c in known]).distinct()
        tables.append(materialize(own) if len(levels) > 1 else own)
    chain = tables[0]
    for parent, child, table in zip(ids, ids[1:], tables[1:]):
        # Parents without a child are found by their bare ids. So the chain
        # itself only goes through inner joins, of which either side can be
        # split, and appears once at every level.
        up = tables[ids.index(parent)]
        shared = [c for c in table.columns if c in up.columns]
        found = table.join(up.select(*shared).distinct(), shared, "left_semi")
        alone = up.select(parent).join(found.select(parent).distinct(), parent, "left_anti")
        missing = alone.withColumn(child, F.concat(F.lit("M"), F.col(parent)))
        tables[ids.index(child)] = found.unionByName(missing, allowMissingColumns=True)
        older = {c: f"__{c}" for c in shared if c != parent}
        chain = chain.join(tables[ids.index(child)].withColumnsRenamed(older), parent)
        for own, other in older.items():
            chain = chain.where(F.col(other).isNull() | (F.col(own) == F.col(other))).drop(other)
    return chain.select(*ids)


def align_to_leaf(chain: DataFrame, records: DataFrame) -> DataFrame:
    """Records with the chain's leaf id. A table that lacks it is joined on
    the ids it has, so a parent's record reaches each of its children."""
    leaf = chain.columns[-1]
    shared = [c for c in chain.columns if c in records.columns]
    records = records.withColumns({c: F.col(c).cast("string") for c in shared})
    if leaf in records.columns:
        return records
    return keep_all_left(chain, records, shared)


def collect_per_leaf(
    chain: DataFrame,
    records: DataFrame,
    fields: Sequence[str],
    cell: Column,
    order: Sequence[str],
    name: str,
    chunk_rows: int = 10_000,
) -> DataFrame:
    """Records of each leaf as ordered lists, every leaf kept. A leaf's list
    comes in numbered chunks of at most ``chunk_rows`` records, so no row
    grows with the length of a history. ``cell`` cuts a leaf's records into
    consecutive pieces (e.g. days) for the numbering."""
    leaf = chain.columns[-1]
    placed = with_position(records.select(leaf, *fields), [leaf], cell, order)
    chunk = F.expr(f"pos div {chunk_rows}")
    lists = placed.groupBy(leaf, chunk.alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("pos", *fields))).alias(name)
    )
    joined = keep_all_left(chain, lists, [leaf], records)
    return joined.withColumn("chunk", F.coalesce("chunk", F.lit(0).cast("bigint")))
