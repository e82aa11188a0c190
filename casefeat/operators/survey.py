"""What the sides of an interval join tell each other before they are shuffled.

Cases say which cells (entity, time bucket) they reach: a bitmap of bounded
size cuts the records below the shuffle. Both sides are counted per hash slot,
a sketch of fixed size that shows the cells in which too many pairs meet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import stable_hash
from ..session import materialize

# Words of 64 bits in the bitmap at most: a broadcast of some 40 MB.
MAX_WORDS = 1 << 20

# Bits per key, so that about one foreign key in sixteen passes.
BITS_PER_KEY = 16

# Slots of the sketch, also the most rows of its broadcast.
SLOTS = 1 << 16

# Pairs that one part of a cell may try.
PAIRS_PER_PART = 4_000_000

# Entities of these types hash alike where they are equal.
HASHED = (T.StringType(), T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())


@dataclass(frozen=True)
class Survey:
    """Settled facts about the sides of a join on (entity, bucket).

    ``low`` and ``high`` bound the times any window reaches (both ``None``:
    there is no window). ``words`` rows ``(word, bits)`` are a bitmap of the
    keys ``by`` that windows have, ``n_words`` long; ``None`` where it would
    not tell enough. ``crowded`` rows ``(slot, parts)`` say into how many
    parts the records of a slot's cells are spread; ``None`` if none are.
    """

    low: int | None
    high: int | None
    by: tuple[str, ...] = ()
    n_words: int = 0
    words: DataFrame | None = None
    crowded: DataFrame | None = None


def _word(by: tuple[str, ...], n_words: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(*by), 6), F.lit(n_words).cast("bigint"))


def _bit(by: tuple[str, ...]) -> Column:
    return F.xxhash64(*by).bitwiseAND(F.lit(63).cast("bigint")).cast("int")


def _slot() -> Column:
    return F.pmod(F.xxhash64(F.lit("slot"), "pid", "__b"), F.lit(SLOTS).cast("bigint")).cast("int")


def survey(windows: DataFrame, rows: DataFrame, pairs: int = PAIRS_PER_PART) -> Survey:
    """Look at both sides once. ``windows`` have ``pid``, ``__b``, ``__s`` and
    ``__e`` (one row per case and bucket), ``rows`` have ``pid``, ``__b`` and
    ``__u``. Every bound is one of memory or work, never of results."""
    cell = ("pid", "__b")
    facts = windows.agg(
        F.min("__s").alias("low"), F.max("__e").alias("high"),
        F.approx_count_distinct("pid").alias("pids"), F.approx_count_distinct(F.struct(*cell)).alias("cells"),
    ).first()
    if facts.low is None:
        return Survey(None, None)
    if not _hash_alike(windows, rows):
        return Survey(facts.low, facts.high)
    by, n_words, words = (), 0, None
    for keys, n in ((cell, facts.cells), (("pid",), facts.pids)):
        # A bitmap that is more than half full is not worth its broadcast.
        if 2 * n <= 64 * MAX_WORDS:
            by, n_words = keys, min(MAX_WORDS, max(16, 1 << (n * BITS_PER_KEY // 64).bit_length()))
            bit = F.expr("shiftleft(1L, __bit)")
            marked = windows.select(_word(by, n_words).alias("word"), _bit(by).alias("__bit"))
            words = materialize(marked.groupBy("word").agg(F.bit_or(bit).alias("bits")))
            break
    found = Survey(facts.low, facts.high, by, n_words, words)
    return Survey(facts.low, facts.high, by, n_words, words, _crowded(windows, reached(rows, found), pairs))


def _hash_alike(windows: DataFrame, rows: DataFrame) -> bool:
    """Whether equal entities of both sides have equal hashes."""
    left, right = windows.schema["pid"].dataType, rows.schema["pid"].dataType
    return left == right and left in HASHED


def _crowded(windows: DataFrame, rows: DataFrame, pairs: int) -> DataFrame | None:
    """Slots whose pairs exceed ``pairs``. What an average slot holds is taken
    off first, as a slot gathers the cells that happen to hash alike: a full
    slot of many small cells is not crowded."""
    filled = [
        side.select(_slot().alias("slot")).groupBy("slot").agg(F.count("*").alias(n))
        for side, n in ((rows, "n"), (windows, "m"))
    ]
    counts = materialize(filled[0].join(filled[1], "slot"))
    mean = counts.agg(F.sum("n") / SLOTS, F.sum("m") / SLOTS).first()
    if mean[0] is None:
        return None
    n, m = (F.greatest(F.ceil(F.col(c) - F.lit(a)), F.lit(1)) for c, a in zip("nm", mean, strict=True))
    parts = F.least(F.ceil(n.cast("double") * m / pairs), n).cast("int")
    crowded = materialize(counts.select("slot", parts.alias("parts")).where(F.col("parts") > 1))
    return None if crowded.isEmpty() else crowded


def reached(rows: DataFrame, found: Survey) -> DataFrame:
    """Rows whose cell, as far as the bitmap tells, some window reaches."""
    if found.low is None:
        return rows.where(F.lit(False))
    if found.words is None:
        return rows
    # At most MAX_WORDS rows, whatever the number of cases.
    words = F.broadcast(found.words.select(F.col("word").alias("__word"), F.col("bits").alias("__bits")))
    hit = rows.join(words, _word(found.by, found.n_words) == F.col("__word"))
    return hit.where(F.getbit("__bits", _bit(found.by)) == 1).drop("__word", "__bits")


def spread(windows: DataFrame, rows: DataFrame, found: Survey) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the join's further key: the rows of crowded slots are
    spread over parts, the windows that meet them repeated."""
    if found.crowded is None:
        return windows, rows, []
    # At most SLOTS rows.
    crowded = F.broadcast(found.crowded.select(F.col("slot").alias("__slot"), F.col("parts").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    drawn = "rec_id" if "rec_id" in rows.columns else "__u"
    rows = rows.join(crowded, _slot() == F.col("__slot"), "left")
    draw = F.when(parts > 1, F.pmod(stable_hash(F.coalesce(F.col(drawn).cast("string"), F.lit("")), "part"), parts))
    rows = rows.withColumn("__part", F.coalesce(draw, F.lit(0)).cast("int")).drop("__slot", "__parts")
    windows = windows.join(crowded, _slot() == F.col("__slot"), "left")
    windows = windows.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__slot", "__parts")
    return windows, rows, ["__part"]
