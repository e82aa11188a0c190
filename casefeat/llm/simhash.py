"""SimHash near-duplicates by segment bit counts.

A fingerprint's 64 bits are cut into segments of two; the counts of set bits
per segment are a point whose Manhattan distance to another point never
exceeds the number of differing bits. The 32 segments form three blocks: of
two points at distance 4 or less, some block is at distance 4 // 3 = 1 or
less. So a grid of unit cells over each block's counts and a range of one
step finds every candidate; the differing bits are then counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, fresh, group_starts, grouped_batches, partitions, settle, split_crowded

SEED = 42
SEGMENT_BITS = 2
BUFFER_ROWS = 200_000
CROWDED = 8_192


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of the ``width``-word shingles of a text, A-Z
    lower-cased, repeats counted; a shorter text is one shingle, a text
    without words has fingerprint 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    begin, end = starts.tolist(), ends.tolist()
    for at in range(0, len(begin), 65_536):
        spans = zip(begin[at : at + 65_536], end[at : at + 65_536], strict=True)
        values = np.array([hashed(line[s:e], SEED) for s, e in spans], np.uint64)
        total += np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (total * 2 > len(begin)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, width: int = 4, name: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(name, of("text"))


def blocks(max_distance: int) -> list[np.ndarray]:
    """The segments of each block; with more blocks than half the distance,
    some block's counts differ by at most one step."""
    return np.array_split(np.arange(64 // SEGMENT_BITS), max_distance // 2 + 1)


def segment_counts(fps: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fps), -1, SEGMENT_BITS).sum(2).astype(np.int64)


def visits(fps: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(cell, fingerprint, guest)`` of every cell a fingerprint enters.

    Counts one step apart have sums of different parity, so it is enough
    that points of odd sum visit the neighbouring cells.
    """
    counts = segment_counts(fps)
    cells, owners, guests = [], [], []
    for number, block in enumerate(blocks(max_distance)):
        radix = (SEGMENT_BITS + 1) ** np.arange(len(block), dtype=np.int64)
        point = counts[:, block]
        home = (point @ radix) * 64 + number
        cells.append(home)
        owners.append(fps)
        guests.append(np.zeros(len(fps), bool))
        odd = np.flatnonzero(point.sum(1) % 2)
        for k in range(len(block)):
            for step in (-1, 1):
                who = odd[(point[odd, k] + step >= 0) & (point[odd, k] + step <= SEGMENT_BITS)]
                cells.append(home[who] + step * radix[k] * 64)
                owners.append(fps[who])
                guests.append(np.ones(len(who), bool))
    return np.concatenate(cells), np.concatenate(owners), np.concatenate(guests)


def links_of_groups(table: pa.Table, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all near fingerprints of each group: a pair of rows
    counts if at least one lives in the cell, and if the two belong to
    different pieces, or to one piece in its own group."""
    fps = table.column("fp").to_numpy().view(np.uint64)
    guest = table.column("guest").to_numpy(zero_copy_only=False)
    mine, ci, cj = (table.column(c).to_numpy() for c in ("mine", "ci", "cj"))
    starts = group_starts(table, ["grp"])
    sizes = np.diff(np.append(starts, len(fps)))
    group = np.repeat(np.arange(len(starts)), sizes)
    left, right = [], []

    def near(i, j):
        ok = np.bitwise_count(fps[i] ^ fps[j]) <= max_distance
        return ok & ~(guest[i] & guest[j]) & ((mine[i] != mine[j]) | (ci[i] == cj[i]))

    small = sizes <= 48
    rows = np.flatnonzero(small[group])
    last = starts + sizes
    step = 1
    while len(rows := rows[rows + step < last[group[rows]]]):
        hit = rows[near(rows, rows + step)]
        left.append(hit)
        right.append(hit + step)
        step += 1
    for k in np.flatnonzero(~small):
        a, b = reach(np.arange(starts[k], last[k]), near)
        left.append(a)
        right.append(b)
    a, b = np.concatenate([*left, []]).astype(int), np.concatenate([*right, []]).astype(int)
    root = forest(len(fps), a, b)
    far = np.flatnonzero(root != np.arange(len(fps)))
    pairs = np.unique(np.stack([fps[far].view(np.int64), fps[root[far]].view(np.int64)], 1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pairs[:, 0], pairs[:, 1]


def reach(rows: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one large group: whoever is reached leaves the
    rest, so a crowd of near copies costs few comparisons and few links."""
    a, b, rest = [], [], rows
    frontier: list[int] = []
    while len(rest) or frontier:
        if not frontier:
            frontier, rest = [int(rest[0])], rest[1:]
        at = frontier.pop()
        hit = near(np.full(len(rest), at), rest)
        found, rest = rest[hit], rest[~hit]
        a.append(np.full(len(found), at))
        b.append(found)
        frontier.extend(found.tolist())
    return np.concatenate([*a, []]), np.concatenate([*b, []])


def near_links(fps: DataFrame, max_distance: int = 4, crowded: int = CROWDED) -> DataFrame:
    """Links ``(a, b)`` over distinct fingerprints ``fp`` that connect all
    pairs of at most ``max_distance`` differing bits: each link is such a
    pair or a path of such pairs."""
    n = partitions(fps.sparkSession)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                own = batch.column("fp").slice(at, 20_000).to_numpy().view(np.uint64)
                cell, fp, guest = visits(own, max_distance)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(fp.view(np.int64)), pa.array(guest)], ["cell", "fp", "guest"]
                )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches, ["grp"], BUFFER_ROWS):
            a, b = links_of_groups(table, max_distance)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    entered = fps.mapInArrow(enter, "cell long, fp long, guest boolean")
    met = split_crowded(entered, "cell", crowded).select("grp", "fp", "guest", "mine", "ci", "cj")
    return met.repartition(n, "grp").sortWithinPartitions("grp").mapInArrow(link, "a long, b long")


def simhash_classes(docs: DataFrame, width: int = 4, max_distance: int = 4, crowded: int = CROWDED) -> DataFrame:
    """``(doc_id, fp, component_id, component)`` of every row of ``docs``: its
    fingerprint, the smallest doc_id reachable over links of at most
    ``max_distance`` differing bits, and the smallest fingerprint there.

    Null and empty texts have fingerprint 0 and link like any other. Repeated
    rows stay rows. A null doc_id is reached but never names a class unless
    all its members are null. Other columns of ``docs`` are not read. An
    empty table gives an empty table. A third of all rows may share a
    fingerprint: links are sought between distinct fingerprints only.
    """
    thin = docs.select("doc_id", "text")
    marked, _ = settle(with_fingerprint(thin, width).select("doc_id", "fp"), "fingerprints")
    lowest, _ = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    links = near_links(lowest.select("fp"), max_distance, crowded)
    member = connected_components(links).withColumnRenamed("id", "fp")
    named = lowest.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes, _ = settle(named.join(least, "component").select("fp", "component_id", "component"), "classes")
    return marked.join(classes, "fp")


def keep_first(docs: DataFrame, width: int = 4, max_distance: int = 4) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, with all
    its columns. Of several rows with that doc_id (or of a class with null
    doc_ids only) one stays.

    Where doc_ids are unique, the ids that go are taken away: the shorter
    list. Where some repeat, an id alone does not name a row; rows are then
    met by id and fingerprint.
    """
    classes, _ = settle(simhash_classes(docs, width, max_distance), "members")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    if classes.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = classes.where(~first).select(F.col("doc_id").alias("__id"))
        return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]), "left_anti")
    kept = classes.where(first).select(F.col("doc_id").alias("__id"), F.col("fp").alias("__of"), "component").distinct()
    own, group = fresh(docs, "fp"), fresh(docs, "component")
    kept = kept.withColumnRenamed("component", group)
    marked = with_fingerprint(docs, width, own)
    met = marked.join(kept, marked["doc_id"].eqNullSafe(kept["__id"]) & (marked[own] == kept["__of"]))
    columns = [marked[f"`{c}`"] for c in docs.columns]
    return met.select(*columns, kept[group]).dropDuplicates([group]).drop(group)
