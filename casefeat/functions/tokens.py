"""Token and token-list expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CALENDAR_PREFIXES
from .timing import daypart


def calendar_columns(dt: Column) -> list[Column]:
    """``Year-2024, Month-1, Date-1, MEAN-Night, Hour-0, Min-7``."""
    parts = [F.year(dt), F.month(dt), F.day(dt), daypart(dt), F.hour(dt), F.minute(dt)]
    return [F.concat(F.lit(p), v.cast("string")) for p, v in zip(CALENDAR_PREFIXES, parts)]


def calendar_tokens(dt: Column) -> Column:
    return F.array(*calendar_columns(dt))


def token_entry(idx: Column, w: Column, rfg_idx: Column | None = None) -> Column:
    """A token of a list: id, grain group where wanted, weight."""
    group = [] if rfg_idx is None else [rfg_idx.alias("rfg_idx")]
    return F.struct(idx.alias("idx"), *group, w.alias("w"))


def each(items: Column, name: str) -> Column:
    """One field of every struct in a list."""
    return F.transform(items, lambda e: e[name])


def ones_like(keys: Column) -> Column:
    return F.transform(keys, lambda _: F.lit(1.0))


def number_to_token(field: str, value: Column, width: float = 1) -> Column:
    """Number to category token: ``value`` cut into bins of ``width``."""
    return F.concat(F.lit(f"{field}-"), F.floor(value / F.lit(width)).cast("string"))


def last_per_idx(tok: Column) -> Column:
    """Of tokens with the same id in one list, keep the last. Lists without
    repeats, the usual case, pass through after one linear check."""
    ids = each(tok, "idx")
    repeats = F.size(F.array_distinct(ids)) < F.size(ids)
    deduped = F.filter(
        tok,
        lambda t, i: F.array_position(F.slice(ids, i + 2, F.size(ids)), t["idx"]) == 0,
    )
    return F.when(repeats, deduped).otherwise(tok)


def rank_in_group(labels: Column) -> Column:
    """For each list element, how many earlier elements carry its label."""
    numbered = F.transform(labels, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    per_label = F.transform(
        F.array_distinct(labels),
        lambda g: F.transform(
            F.filter(numbered, lambda e: e["g"] == g),
            lambda e, rank: F.struct(e["i"].alias("i"), rank.alias("rank")),
        ),
    )
    return each(F.sort_array(F.flatten(per_label)), "rank")


def filled_slots(entries: Column, size: int, fill: Column) -> Column:
    """Sorted ``(slot, value)`` entries as a dense list of ``size`` values;
    free slots get ``fill``. Linear in the list, no lookups."""

    def with_gap(entry, i):
        before = F.when(i > 0, F.try_element_at(entries, i)["slot"]).otherwise(F.lit(-1))
        gap = (entry["slot"] - before - 1).cast("int")
        return F.concat(F.array_repeat(fill, gap), F.array(entry["value"]))

    last = F.coalesce(F.try_element_at(entries, F.lit(-1))["slot"], F.lit(-1))
    tail = F.array_repeat(fill, (F.lit(size) - 1 - last).cast("int"))
    return F.concat(F.flatten(F.transform(entries, with_gap)), tail)
