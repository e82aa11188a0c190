"""Token stage: weighted token lists per record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CheckPeriod, GrainColumn, GrainTable, Tokens
from ..constants import CASE_KEY, LEVELS, UNK_IDX
from ..functions.timing import level_micros
from ..functions.tokens import calendar_columns, calendar_tokens, each, filled_slots, ones_like, token_entry
from .vocab import MAX_BROADCAST_TOKENS, Vocabulary


# Parallel lists of a token row; the last two only from grain tables that have them.
TOKEN_LISTS = ("tkn_key", "tkn_wgt", "tkn_rfg", "tkn_keyInrfg")


def attach_tokens(records: DataFrame, tokens: Tokens) -> DataFrame:
    """Add ``tkn_key`` and ``tkn_wgt``: the lists of all grains in order, the
    calendar last. A record's tokens do not depend on the case, so this runs
    once per record, before records meet cases. A record missing from a grain
    table has an empty list there.

    Grain tables may also hold the lists ``{name}_rfg`` and
    ``{name}_keyInrfg``; where one does, they are put together like keys and
    weights as ``tkn_rfg`` and ``tkn_keyInrfg``. A grain without them, and the
    calendar, counts as one group of its own name there."""
    keys, weights, groups, places = [], [], [], []
    suffixes = any(_stored_suffixes(g) for g in tokens.grains)
    for grain in tokens.grains:
        if isinstance(grain, GrainTable):
            key, wgt = f"{grain.name}_key", f"{grain.name}_wgt"
            on = [c for c in grain.df.columns if c in records.columns]
            same = {c: F.col(c).cast(records.schema[c].dataType) for c in on}
            records = records.join(grain.df.withColumns(same), on, "left")
            keys.append(F.coalesce(F.col(key), F.array().cast("array<string>")))
            weights.append(
                F.coalesce(F.col(wgt).cast("array<double>"), F.array().cast("array<double>"))
            )
        elif grain.single is not None:
            key = F.array(*[k for k, _ in grain.single])
            wgt = F.array(*[w for _, w in grain.single])
            keys.append(F.array_compact(key))
            weights.append(_beside(wgt, key))
        else:
            key = grain.key()
            keys.append(key)
            weights.append(grain.wgt().cast("array<double>") if grain.wgt else ones_like(key))
        if suffixes:
            group, place = _one_group(keys[-1], grain.name)
            if _stored_suffixes(grain):
                group = F.coalesce(F.col(f"{grain.name}_rfg"), F.array().cast("array<string>"))
                place = F.coalesce(F.col(f"{grain.name}_keyInrfg").cast("array<bigint>"), F.array().cast("array<bigint>"))
            groups.append(group)
            places.append(place)
    if tokens.calendar is not None:
        calendar = calendar_tokens(F.col("dt"))
        keys.append(calendar)
        weights.append(ones_like(calendar))
    added = {"tkn_key": F.concat(*keys), "tkn_wgt": F.concat(*weights)}
    if suffixes:
        if tokens.calendar is not None:
            group, place = _one_group(keys[-1], tokens.calendar)
            groups.append(group)
            places.append(place)
        added |= {"tkn_rfg": F.concat(*groups), "tkn_keyInrfg": F.concat(*places)}
    records = records.withColumns(added)
    return records.drop(*[f"{g.name}_{s}" for g in tokens.grains for s in ("key", "wgt", "rfg", "keyInrfg")])


def _one_group(keys: Column, name: str) -> tuple[Column, Column]:
    return F.transform(keys, lambda _: F.lit(name)), F.transform(keys, lambda _, i: i.cast("bigint"))


def _stored_suffixes(grain: GrainTable | GrainColumn) -> bool:
    return isinstance(grain, GrainTable) and {f"{grain.name}_rfg", f"{grain.name}_keyInrfg"} <= set(grain.df.columns)


def record_label(record_name: str, rec_id: str = "rec_id") -> Column:
    return F.concat(F.lit(record_name), F.col(rec_id))


def _beside(weights: Column, keys: Column) -> Column:
    """Weights whose key is not null."""
    return F.filter(weights, lambda _, i: keys[i].isNotNull())


def _known(idx: Column, rfg_idx: Column, token: Column, vocab: Vocabulary, on_unknown: str):
    """Ids of a looked-up token: one outside the vocabulary fails, turns into
    the unknown token, or stays without an id."""
    unknown = token.isNotNull() & idx.isNull()
    if on_unknown == "unk":
        idx = F.when(unknown, F.lit(UNK_IDX)).otherwise(idx)
        rfg_idx = F.when(unknown, F.lit(vocab.special[vocab.unk][1])).otherwise(rfg_idx)
    elif on_unknown == "fail":
        problem = F.raise_error(F.concat(F.lit("token outside the vocabulary: "), token))
        idx = F.when(unknown, problem.cast("int")).otherwise(idx)
    return idx, rfg_idx


def encoded_records(
    records: DataFrame,
    tokens: Tokens,
    vocab: Vocabulary,
    on_unknown: str = "fail",
    rfg: bool = False,
    keep: Sequence[str] = (),
    name: str = "tok",
) -> DataFrame:
    """Records as ``pid, rec_id, dt``, the columns in ``keep`` and ``tok``:
    token lists already as ids.

    When every token is a column of its own, each is looked up by a broadcast
    join and the list is put together in place: no shuffle. Otherwise the
    lists are built first and encoded by ``encode_tokens``.
    """
    single = []
    for grain in tokens.grains:
        pairs = None if isinstance(grain, GrainTable) else grain.single
        if pairs is None:
            single = None
            break
        single += pairs
    if single is None or vocab.size > MAX_BROADCAST_TOKENS:
        listed = attach_tokens(records, tokens).select("pid", "rec_id", "dt", *keep, "tkn_key", "tkn_wgt")
        return encode_tokens(listed, vocab, on_unknown, rfg).withColumnRenamed("tok", name)
    if tokens.calendar is not None:
        single += [(k, F.lit(1.0)) for k in calendar_columns(F.col("dt"))]
    names = [f"__{i}" for i in range(len(single))]
    rows = records.select(
        "pid", "rec_id", "dt", *keep,
        *[k.alias(f"{n}k") for n, (k, _) in zip(names, single)],
        *[w.alias(f"{n}w") for n, (_, w) in zip(names, single)],
    )
    entries = []
    for n in names:
        side = vocab.df.select(
            F.col("grn").alias(f"{n}k"), F.col("idx").alias(f"{n}i"), F.col("rfg_idx").alias(f"{n}g")
        )
        rows = rows.join(F.broadcast(side), f"{n}k", "left")
        idx, group = _known(F.col(f"{n}i"), F.col(f"{n}g"), F.col(f"{n}k"), vocab, on_unknown)
        entries.append(token_entry(idx, F.col(f"{n}w"), group if rfg else None))
    tok = F.filter(F.array(*entries), lambda t: t["idx"].isNotNull())
    return rows.select("pid", "rec_id", "dt", *keep, tok.alias(name))


def encode_tokens(rows: DataFrame, vocab: Vocabulary, on_unknown: str = "fail", rfg: bool = False) -> DataFrame:
    """Replace ``tkn_key``/``tkn_wgt`` by ``tok``: the same list as token
    entries, with grain groups if wanted. Every row stays a row of its own,
    also one that equals another. A token outside the vocabulary fails, turns
    into the unknown token, or is dropped."""
    kept = [c for c in rows.columns if c not in ("tkn_key", "tkn_wgt")]
    clash = {"pos", "t", "grn", "weight", "idx", "rfg", "rfg_idx"} & {c.lower() for c in kept}
    if clash:
        raise ValueError(f"columns {sorted(clash)} would clash; rename them")
    pair = F.arrays_zip(F.col("tkn_key").alias("grn"), F.col("tkn_wgt").alias("weight"))
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    long = numbered.select(*kept, "__row", F.posexplode_outer(pair).alias("pos", "t"))
    long = long.select(*kept, "__row", "pos", "t.grn", "t.weight")
    found = vocab.lookup(long, "grn")
    idx, group = _known(F.col("idx"), F.col("rfg_idx"), F.col("grn"), vocab, on_unknown)
    token = token_entry(idx, F.col("weight").cast("double"), group if rfg else None)
    entry = F.struct("pos", token.alias("token"))
    grouped = found.groupBy("__row").agg(
        *[F.first(c).alias(c) for c in kept], F.sort_array(F.collect_list(entry)).alias("tok")
    )
    listed = F.filter(each(F.col("tok"), "token"), lambda t: t["idx"].isNotNull())
    return grouped.withColumn("tok", listed).select(*kept, "tok")


def unk_rows(cases: DataFrame) -> DataFrame:
    """One row per case with all relative times 0 and no record."""
    zeros = {level: F.lit(0).cast("bigint") for level in LEVELS}
    return cases.select(*CASE_KEY).withColumns(zeros)


def with_unk(cases: DataFrame, rows: DataFrame, unk: str) -> DataFrame:
    """Token rows plus one ``[UNK]`` row for each case without any."""
    empty = unk_rows(cases.join(rows.select(*CASE_KEY).distinct(), list(CASE_KEY), "left_anti"))
    fill = {"tkn_key": F.lit(unk), "tkn_wgt": F.lit(1.0), "tkn_rfg": F.lit(unk), "tkn_keyInrfg": F.lit(0).cast("bigint")}
    empty = empty.withColumns({c: F.array(fill[c]) for c in TOKEN_LISTS if c in rows.columns})
    return rows.unionByName(empty, allowMissingColumns=True)


def slot_range(period: CheckPeriod, level: str = "5Min") -> tuple[int, int]:
    """First and last slot of a period, counted away from the observation
    time. The start of a period is inclusive, so a record exactly 24 hours
    before lies in slot 288 of ``Bf24H``."""
    if period.start_us < 0 < period.end_us:
        raise ValueError(f"period {period.name!r} lies on both sides: its slots would mix before and after")
    width = level_micros(level)
    near, far = (-period.end_us + 1, -period.start_us) if period.end_us <= 0 else (period.start_us, period.end_us - 1)
    if period.start_exclusive:
        near, far = (near, far - 1) if period.end_us <= 0 else (near + 1, far)
    return near // width, far // width


def one_token_per_slot(
    cases: DataFrame, rows: DataFrame, token: Column, period: CheckPeriod, fill: Column, level: str = "5Min"
) -> DataFrame:
    """One value per time slot of the period, counted away from the
    observation time: the latest record of the slot, ``fill`` where there is
    none. One list of all the period's slots per case."""
    first, last = slot_range(period, level)
    slot = (F.abs(F.col(level)) - first).cast("int").alias("slot")
    latest = rows.groupBy(*CASE_KEY, slot).agg(F.max_by(token, F.struct("dt", "rec_id")).alias("value"))
    entries = latest.groupBy(*CASE_KEY).agg(
        F.sort_array(F.collect_list(F.struct("slot", "value"))).alias("entries")
    )
    none = F.array().cast(entries.schema["entries"].dataType)
    joined = cases.join(entries, list(CASE_KEY), "left")
    dense = filled_slots(F.coalesce("entries", none), last - first + 1, fill)
    return joined.withColumn("tkn", dense).drop("entries")
