"""Stable hashes: the same key gives the same number on every layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timing import micros

HASH_RANGE = 1 << 32


def stable_hash(key: Column, seed: str = "") -> Column:
    """32-bit number from the md5 of the key's text and a seed."""
    text = F.concat(F.lit(seed), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def below_ratio(key: Column, ratio: float, seed: str = "") -> Column:
    return stable_hash(key, seed) < F.lit(round(ratio * HASH_RANGE)).cast("bigint")


def case_draw(cases: DataFrame, seed: str = "") -> Column:
    """32-bit number of a case, from its entity and time: record ids may
    repeat from one entity to the next, so the name does not enter. A case
    without entity or time draws like any other."""
    at = F.coalesce(micros(cases, "pred_dt").cast("string"), F.lit(""))
    return stable_hash(F.concat(F.coalesce(F.col("pid").cast("string"), F.lit("")), F.lit("@"), at), seed)


def entity_group(pid: Column, range_size: int | None = None, groups: int = 64) -> Column:
    """Storage group of an entity: id range for numeric ids, hash otherwise."""
    if range_size is not None:
        # In decimals: a double would round ids above 2^53.
        number, size = pid.cast("bigint"), F.lit(range_size).cast("bigint")
        whole = (number - F.pmod(number, size)).cast("decimal(20,0)")
        return (whole / size.cast("decimal(20,0)")).cast("bigint")
    return F.pmod(F.xxhash64(pid), F.lit(groups)).cast("bigint")
