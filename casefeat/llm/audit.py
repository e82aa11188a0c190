"""How filters interact: every order of five filters over a stream of files.

Files are read as micro-batches until none is left. What a document fails by
itself follows from its text; whether its text stands at a smaller id as well
is known only when all files are seen. So the state of a text holds its
smallest id so far and who has it; when a smaller one arrives the earlier
owner's mask is retracted from its part's counter and counted again with the
duplicate's bit. Counters of failure masks are all that leaves the stream;
every order and step follows from them. Texts share a state entry by their
digests, some 256 each, as calling Python costs more than looking one up.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch_folder
from .common import partitions, settle

FILTERS = "ABCDE"
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
MIN_WORDS = 200
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = re.compile(rb"[#$%&*|]")
# Micro-batches over a table, and grouped rows a task holds before passing them on.
BATCHES, HELD = 8, 200_000

MARKED = "doc_id long, part string, mask int, key binary"
FLAGGED = f"{MARKED}, good boolean, toxic boolean"
GROUPED = "bucket long, key binary, part string, good boolean, toxic boolean, mask int, min_id long, n_min long, n long, n_null long"
DELTA = "part string, mask int, good boolean, toxic boolean, delta long"
STATE = "texts string"
# Texts per state entry, and bytes of state that a text takes.
BUCKET_TEXTS, TEXT_BYTES = 256, 150
# A partition's state above this many bytes lies on the executor's disk with a
# log of changes; below, the files such a store allocates would outweigh it.
MEMORY_STATE = 32_000_000
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def own_mask(raw: bytes) -> int:
    """The filters a text fails by itself."""
    words = raw.split()
    mask = BIT["A"] if len(words) < MIN_WORDS else 0
    if 100 * len(set(words)) < 50 * len(words):
        mask |= BIT["B"]
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    if capitals and 100 * capitals > 2 * len(raw.decode("utf-8", "replace")):
        mask |= BIT["C"]
    return mask | BIT["D"] if MARKS.search(raw) else mask


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    pairs = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(pairs)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, pairs, strict=True)], [n for n, _ in pairs])


def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts turn into masks and digests where they are read."""
    for batch in batches:
        ids, parts = (batch.column(c).to_pylist() for c in ("doc_id", "part"))
        rows = []
        for doc_id, part, raw in zip(ids, parts, batch.column("raw"), strict=True):
            raw = raw.as_py()
            rows.append((doc_id, part, own_mask(raw), hashlib.sha256(raw).digest()))
        yield _batch(MARKED, rows)


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in batch.columns], strict=True)


def group_up(batches: Iterator[pa.RecordBatch], buckets: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows of one text, part and label meet before the shuffle: the smallest
    id, how many have it, and how many there are. So a text that a third of
    all rows hold is a few rows per task."""
    held: dict[tuple, list] = {}

    def passed():
        # Without any id the smallest is written as 0; ``n`` tells.
        out = [(int.from_bytes(g[0][:7], "little") % buckets, *g, low or 0, *rest) for g, (low, *rest) in held.items()]
        held.clear()
        return _batch(GROUPED, out)

    for batch in batches:
        for doc_id, part, mask, key, good, toxic in _rows_of(batch):
            values = held.setdefault((key, part, good, toxic, mask), [None, 0, 0, 0])
            if doc_id is None:
                values[3] += 1
                continue
            values[2] += 1
            if values[0] is None or doc_id < values[0]:
                values[0], values[1] = doc_id, 1
            elif doc_id == values[0]:
                values[1] += 1
        if len(held) >= HELD:
            yield passed()
    yield passed()


def settle_text(groups: Iterator[tuple], old: tuple | None) -> tuple[tuple | None, list[tuple]]:
    """What new rows of one text do: the new state ``(smallest id, [(part,
    good, toxic, n), ..])`` and the changes ``(part, mask, good, toxic, n)``
    of the counters."""
    groups = list(groups)
    least = min((g[4] for g in groups if g[6]), default=None)
    if old is not None:
        least = old[0] if least is None else min(least, old[0])
    out, held = [], {}
    if old is not None:
        mask = groups[0][3]
        for part, good, toxic, n in old[1]:
            if old[0] == least:
                held[part, good, toxic] = n
            else:
                out += [(part, mask, good, toxic, -n), (part, mask | BIT["E"], good, toxic, n)]
    for part, good, toxic, mask, low, n_low, n, n_null in groups:
        first = n_low if n and low == least else 0
        if first:
            held[part, good, toxic] = held.get((part, good, toxic), 0) + first
        if first + n_null:
            out.append((part, mask, good, toxic, first + n_null))
        if n > first:
            out.append((part, mask | BIT["E"], good, toxic, n - first))
    return None if least is None else (least, [(*k, n) for k, n in held.items()]), out


def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The texts of one state entry take in a micro-batch."""
    columns = ["part", "good", "toxic", "mask", "min_id", "n_min", "n", "n_null"]
    met: dict[str, list[tuple]] = {}
    for frame in frames:
        for digest, *row in zip(frame["key"], *[frame[c].tolist() for c in columns], strict=True):
            met.setdefault(digest.hex(), []).append(tuple(row))
    texts = json.loads(state.get[0]) if state.exists else {}
    changes = []
    for digest, groups in met.items():
        old = texts.get(digest)
        new, out = settle_text(groups, old and (old[0], [tuple(h) for h in old[1]]))
        if new is not None:
            texts[digest] = new
        changes += out
    state.update((json.dumps(texts),))
    yield pd.DataFrame(changes, columns=["part", "mask", "good", "toxic", "delta"])


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of one task, one row per counter."""
    sums: dict[tuple, int] = {}
    for batch in batches:
        for *counter, n in _rows_of(batch):
            sums[tuple(counter)] = sums.get(tuple(counter), 0) + n
    yield _batch(DELTA, [(*c, n) for c, n in sums.items() if n])


def flags_of(labels: DataFrame) -> DataFrame:
    """``(doc_id, good, toxic)``, one row per id: any of its labels counts."""
    flag = [F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*flag)


def mask_counts(spark: SparkSession, path: str, labels: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """``(part, mask, n, n_good, n_toxic)`` over all files below ``path``."""
    table = spark.read.parquet(path)
    if files_per_batch is None:
        files_per_batch = max(1, -(-len(table.inputFiles()) // BATCHES))
    flags, _ = settle(flags_of(labels), "audit-flags")
    # As a pattern the path may also name a single file.
    pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    thin = stream.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"),
    )
    marked = thin.mapInArrow(mark, MARKED)
    never = F.lit(False)
    flagged = marked.join(flags, "doc_id", "left").select(
        "doc_id", "part", "mask", "key", F.coalesce("good", never).alias("good"), F.coalesce("toxic", never).alias("toxic")
    )
    buckets = max(1, -(-table.count() // BUCKET_TEXTS))
    changes = (
        flagged.mapInArrow(lambda batches: group_up(batches, buckets), GROUPED)
        .groupBy("bucket")
        .applyInPandasWithState(update, DELTA, STATE, "append", GroupStateTimeout.NoTimeout)
        .mapInArrow(add_up, DELTA)
    )
    folder = scratch_folder(spark, "audit")
    store = STATE_STORE if buckets * BUCKET_TEXTS * TEXT_BYTES > MEMORY_STATE * partitions(spark) else {}
    before = {k: spark.conf.get(k, None) for k in store}
    for k, v in store.items():
        if before[k] is None:
            spark.conf.set(k, v)
    try:
        writer = changes.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
        writer.trigger(availableNow=True).start(f"{folder}/changes").awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
    deltas = spark.read.schema(DELTA).parquet(f"{folder}/changes")
    n = F.sum("delta")
    counts = deltas.groupBy("part", "mask").agg(
        n.alias("n"), F.sum(F.when(F.col("good"), F.col("delta")).otherwise(0)).alias("n_good"),
        F.sum(F.when(F.col("toxic"), F.col("delta")).otherwise(0)).alias("n_toxic"),
    )
    return counts


def orders() -> list[tuple]:
    """``(number, order, step, bit, bits before)`` of all steps of all orders."""
    out = []
    for k, order in enumerate(permutations(FILTERS)):
        bits = [BIT[f] for f in order]
        out += [(k, "".join(order), s + 1, b, sum(bits[:s])) for s, b in enumerate(bits)]
    return out


def _total(field: str, wanted) -> Column:
    return F.aggregate("e", F.lit(0).cast("long"), lambda s, x: s + F.when(wanted(x["mask"]), x[field]).otherwise(0))


def every_order(counts: DataFrame) -> DataFrame:
    """All orders and steps of every part from its counters, of which it has
    32 at most."""
    spark = counts.sparkSession
    entry = F.struct("mask", "n", "n_good", "n_toxic")
    listed = counts.groupBy("part").agg(F.collect_list(entry).alias("e"))
    steps = spark.createDataFrame(orders(), "number int, filter_order string, step int, bit int, earlier int")
    rows = listed.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(119)))).join(F.broadcast(steps), "number")
    bit, earlier = F.col("bit"), F.col("earlier")

    def fails(m):
        return m.bitwiseAND(bit) != 0

    def gone(m):
        return m.bitwiseAND(earlier) != 0

    def here(m):
        return fails(m) & ~gone(m)

    # Of the orders of all filters, a document that fails k of them meets
    # each of the k first equally often.
    share = F.aggregate(
        "e", F.lit(0).cast("long"),
        lambda s, x: s + F.when(fails(x["mask"]), x["n"] * F.expr("120") / F.bit_count(x["mask"])).otherwise(0).cast("long"),
    )
    return rows.select(
        "part", "filter_order", "step",
        _total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        _total("n", here).alias("removed"),
        _total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        _total("n", lambda m: m == bit).alias("unique_fails"),
        _total("n_good", here).alias("good_lost"),
        _total("n_toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )


def filter_audit(spark: SparkSession, path: str, labels: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """What each filter removes in each order, per part; ``path`` is a
    Parquet table of documents, read as a stream of files.

    A null text is empty, a null source the part of the empty name. A
    document without doc_id neither fails E nor makes others fail it; rows
    equal in doc_id and text do not either. Labels without doc_id are passed
    over, and of several labels of an id any counts. Parts without documents
    have no rows, an empty table none at all. Other columns are not read.

    The result does not depend on the order of files nor on their number per
    micro-batch. Lost tasks are repeated from the batch's own files and the
    last written state; the changes of a batch are published once.
    """
    return every_order(mask_counts(spark, path, labels, files_per_batch))
