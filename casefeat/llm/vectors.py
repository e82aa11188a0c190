"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated and cut into low-dimensional blocks. Cosine ``c`` is
squared distance ``2 - 2c``; of two vectors within it, some block is within
the block's proportional share. So each block is range-joined on a grid under
its share, a pair is taken up by the first block that admits it, and its
cosine is computed from the original numbers in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, forest, group_starts, grouped_batches, partitions, settle, split_crowded

BLOCK_DIMS = 8
CELL_WIDTH = 0.2
CELL_ROWS = 2_000
CROWDED = 8_192
BUFFER_ROWS = 20_000
SLACK = 1e-9
SEED = 7


@lru_cache(8)
def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dims), max(1, dims // BLOCK_DIMS))


def budgets(dims: int, cosine: float) -> list[float]:
    """Squared distance each block may use; together the whole budget."""
    total = 2 - 2 * cosine + SLACK
    return [total * len(b) / dims for b in blocks(dims)]


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def entries(points: np.ndarray, label: np.ndarray, cosine: float, grid_dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(cell, row, at home)`` of every cell that a rotated point's range
    meets, block by block. The grid covers the first ``grid_dims`` numbers of
    a block; a cell's name is a hash of label, length, block and place."""
    n, dims = points.shape
    for number, (block, budget) in enumerate(zip(blocks(dims), budgets(dims, cosine), strict=True)):
        axes = block[:grid_dims]
        width = max(CELL_WIDTH, np.sqrt(budget))
        at = points[:, axes] / width
        place = np.floor(at).astype(np.int64)
        below = (at - place) * width
        rows = np.arange(n)
        gap, moved = np.zeros(n), place
        for k in range(len(axes)):
            own, before, after = gap, gap + below[rows, k] ** 2, gap + (width - below[rows, k]) ** 2
            options = [(np.arange(len(rows)), 0, own), (np.flatnonzero(before <= budget), -1, before), (np.flatnonzero(after <= budget), 1, after)]
            rows, gap, parts = (
                np.concatenate([rows[i] for i, _, _ in options]),
                np.concatenate([g[i] for i, _, g in options]),
                [_shifted(moved[i], k, step) for i, step, _ in options],
            )
            moved = np.concatenate(parts)
        home = (moved == place[rows]).all(1)
        digits = np.zeros(len(rows), np.uint64)
        for column in (label[rows], np.full(len(rows), dims), np.full(len(rows), number), *moved.T):
            digits = _mixed(digits, column.astype(np.int64).view(np.uint64))
        yield digits.view(np.int64), rows, home


def _shifted(cells: np.ndarray, axis: int, step: int) -> np.ndarray:
    out = cells.copy()
    out[:, axis] += step
    return out


def _mixed(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One more number into a cell's 64-bit name (a fixed bit mixer)."""
    x = (state ^ value) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def near_pairs(raw: np.ndarray, home: np.ndarray, block: int, cosine: float, allowed) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one group, the first at home, that ``block`` is the first
    to admit and whose cosine is large enough."""
    points = unit(raw)
    turned = points @ rotation(raw.shape[1])
    cuts, limit = blocks(raw.shape[1]), budgets(raw.shape[1], cosine)
    own = turned[:, cuts[block]]
    square = (own * own).sum(1)
    left, right = [], []
    rows = np.flatnonzero(home)
    for at in range(0, len(rows), 512):
        i = rows[at : at + 512]
        gap = square[i][:, None] + square[None, :] - 2 * own[i] @ own.T
        a, b = np.nonzero(gap <= limit[block] + SLACK)
        a = i[a]
        ok = allowed(a, b)
        a, b = a[ok], b[ok]
        for c in range(0, len(a), 100_000):
            x, y = a[c : c + 100_000], b[c : c + 100_000]
            admits = [((turned[x][:, cut] - turned[y][:, cut]) ** 2).sum(1) <= limit[k] for k, cut in enumerate(cuts[: block + 1])]
            keep = admits[-1]
            for earlier in admits[:-1]:
                keep = keep & ~earlier
            x, y = x[keep], y[keep]
            keep = (points[x] * points[y]).sum(1) >= cosine
            left.append(x[keep])
            right.append(y[keep])
    return np.concatenate([*left, []]).astype(int), np.concatenate([*right, []]).astype(int)


def links(reps: DataFrame, cosine: float, grid_dims: int, crowded: int) -> DataFrame:
    """``(node, other, n)``: links counted per node (``other`` null), and
    links that connect each group's nodes (``n`` zero)."""
    size = partitions(reps.sparkSession)
    kind = "<f8" if reps.schema["embedding"].dataType.elementType == T.DoubleType() else "<f4"

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                vectors = batch.column("embedding")
                lengths = np.array([len(v) for v in vectors])
                label, node, copies = (batch.column(c).to_numpy() for c in ("label", "node", "copies"))
                for dims in np.unique(lengths):
                    pick = np.flatnonzero(lengths == dims)
                    raw = np.stack(vectors.take(pa.array(pick)).to_numpy(zero_copy_only=False)).astype(kind)
                    bytes_of = [v.tobytes() for v in raw]
                    turned = unit(raw) @ rotation(int(dims))
                    for block, (cell, rows, home) in enumerate(entries(turned, label[pick], cosine, grid_dims)):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(cell), pa.array(label[pick][rows], pa.int64()), pa.array(np.full(len(rows), block, np.int32)),
                                pa.array(node[pick][rows]), pa.array(copies[pick][rows]), pa.array(home),
                                pa.array([bytes_of[r] for r in rows], pa.binary()),
                            ],
                            ["cell", "label", "block", "node", "copies", "home", "raw"],
                        )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["grp", "cell", "label", "block"]
        for table in grouped_batches(batches, keys, BUFFER_ROWS):
            node, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
            mine, ci, cj = (table.column(c).to_numpy() for c in ("mine", "ci", "cj"))
            home = table.column("home").to_numpy()
            raw = table.column("raw").to_pylist()
            starts = group_starts(table, keys)
            left, right = [], []
            length = np.fromiter(map(len, raw), np.int64, len(raw))
            for lo, hi in zip(starts, np.append(starts[1:], len(node)), strict=True):
                for size in np.unique(length[lo:hi]):
                    at = lo + np.flatnonzero(length[lo:hi] == size)
                    if len(at) < 2 or not home[at].any():
                        continue

                    def allowed(a, b, at=at):
                        a, b = at[a], at[b]
                        return (node[a] < node[b]) & ((mine[a] != mine[b]) | (ci[a] == cj[a]))

                    vectors = np.frombuffer(b"".join([raw[k] for k in at]), kind).reshape(len(at), -1)
                    a, b = near_pairs(vectors, home[at].astype(bool), int(block[lo]), cosine, allowed)
                    left.append(at[a])
                    right.append(at[b])
            a, b = np.concatenate([*left, []]).astype(int), np.concatenate([*right, []]).astype(int)
            found = np.zeros(len(node), np.int64)
            np.add.at(found, a, copies[b])
            np.add.at(found, b, copies[a])
            counted = np.flatnonzero(found)
            root = forest(len(node), a, b)
            tied = np.flatnonzero(root != np.arange(len(node)))
            nodes = np.concatenate([node[counted], node[tied]])
            others = pa.concat_arrays([pa.nulls(len(counted), pa.int64()), pa.array(node[root[tied]], pa.int64())])
            n = np.concatenate([found[counted], np.zeros(len(tied), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), others, pa.array(n)], ["node", "other", "n"])

    schema = "cell long, label long, block int, node long, copies long, home boolean, raw binary"
    met = split_crowded(reps.mapInArrow(enter, schema), "cell", crowded)
    dealt = met.repartition(size, "grp").sortWithinPartitions("grp", "cell", "label", "block")
    return dealt.mapInArrow(link, "node long, other long, n long")


def grid_dimensions(reps: DataFrame) -> int:
    """Numbers of a block that the grid covers: enough that a label's rows
    spread to about ``CELL_ROWS`` a cell. It changes the work, never the
    result."""
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    return int(np.clip(np.ceil(np.log(max(largest, 1) / CELL_ROWS) / np.log(1 / CELL_WIDTH)), 2, 6))


def vector_classes(vectors: DataFrame, cosine: float = 0.98, grid_dims: int | None = None, crowded: int = CROWDED) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors``.

    Two rows link if their labels are equal and not null, their vectors equally
    long and their cosine is at least ``cosine``. A vector that is null, empty,
    zero or holds a null, NaN or infinite number links with nothing, as does a
    row without label: its class is its own id. Rows with equal label and
    vector are compared once and counted as often as they occur, repeated rows
    with one vec_id included. A null vec_id is linked but names no class
    unless all members are null. Other columns are not read; an empty table
    gives an empty one.
    """
    rows = vectors.select("vec_id", "label", "embedding")
    good = F.col("label").isNotNull() & usable(F.col("embedding"))
    groups = rows.where(good).groupBy("label", "embedding")
    named = groups.agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    reps, _ = settle(named.withColumn("node", F.monotonically_increasing_id()), "vectors")
    dims = grid_dimensions(reps) if grid_dims is None else grid_dims
    found, _ = settle(links(reps.withColumn("label", F.col("label").cast("long")), cosine, dims, crowded), "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    ties = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    member = connected_components(ties).withColumnRenamed("id", "node")
    thin = reps.select("node", "first_id", "copies").join(counts, "node", "left").join(member, "node", "left")
    thin, _ = settle(thin.withColumn("component", F.coalesce("component", "node")), "members")
    least = thin.groupBy("component").agg(F.min("first_id").alias("component_id"))
    total = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    done, _ = settle(thin.join(least, "component").select("node", total, "component_id"), "members")
    known = reps.select("label", "embedding", "node").join(done, "node").withColumn("linked", F.lit(True))
    key = (rows["label"] == known["label"]) & (rows["embedding"] == known["embedding"])
    out = rows.withColumn("__good", good).join(known, key & F.col("__good"), "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
