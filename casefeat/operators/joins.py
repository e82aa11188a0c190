"""Join forms that stay even when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def keep_all_left(
    left: DataFrame, right: DataFrame, on: Sequence[str], present: DataFrame | None = None
) -> DataFrame:
    """``left LEFT JOIN right`` where the right side may be crowded on one
    key. Adaptive execution can split either side of an inner join but only
    the left side of a left join; so matches come from an inner join, and
    rows without a match from an anti join with the distinct keys. The keys
    are read off ``present`` where that is cheaper than off ``right``."""
    on = list(on)
    matched = left.join(right, on)
    keys = (right if present is None else present).select(*on).distinct()
    alone = left.join(keys, on, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)
