"""Compress stage: roll token lists up the time hierarchy.

Rows carry one ``tok`` list of ``(idx, w)`` per record or group, with the
grain group ``rfg_idx`` in between where a program asks for it.
A token absent from a list counts as weight 0, so nothing is ever pivoted:
a mean is the weight sum over the number of rows. Once rounded, weights are
whole thousandths (BIGINT), which makes later levels exact and independent
of partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Compress, split_rule
from ..constants import CASE_KEY, LEVELS, UNIT_MICROS, UNK_IDX
from ..functions.timing import bucket, coarser, micros
from ..functions.tokens import each, last_per_idx, rank_in_group, token_entry
from ..session import materialize
from .observe import CELL
from .ranking import with_position
from .vocab import Vocabulary

# Id of the entry that stands for the row itself while tokens are summed.
ROW_IDX = -1

# Columns of a wide table at most.
MAX_COLUMNS = 5_000


@dataclass(frozen=True)
class Method:
    """A compress method for one token of one group.

    ``agg`` aggregates the weights that are present; ``finish(value, present,
    rows)`` sees how many of the group's rows had the token, so absent zeros
    can be accounted for. ``linear`` methods scale with their weights and can
    run on thousandths; others get natural weights. ``merge`` combines partial
    values; a method that has it is pre-aggregated where the rows lie.
    ``values`` methods see all weights of the group (see :func:`over_values`).
    """

    agg: Callable[[Column], Column]
    finish: Callable[[Column, Column, Column], Column] = lambda value, present, rows: value
    rounded: bool = False
    linear: bool = False
    merge: Callable[[Column], Column] | None = None
    values: bool = False


def over_values(finish: Callable[[Column, Column], Column], rounded: bool = False) -> Method:
    """A method that sees every weight of a token in its group, absent zeros
    included: ``finish(histogram, rows)`` gets the distinct weights in order
    with their numbers, as a list of ``(weight, present)``. Equal weights are
    counted where the rows lie and counts are merged after the shuffle, so a
    group is moved and kept as its distinct weights, not as its rows."""
    return Method(F.count, lambda value, present, rows: finish(value, rows), rounded, values=True)


def quantile(q: float) -> Method:
    """The ``q`` quantile of a token's weights in the group, linear between
    neighbours; ``quantile(0.5)`` is the median."""
    if not 0 <= q <= 1:
        raise ValueError(f"a quantile lies between 0 and 1, got {q}")

    def finish(histogram: Column, rows: Column) -> Column:
        place = F.lit(float(q)) * (rows - 1)
        low, high = F.floor(place), F.ceil(place)

        def passed(acc: Column, entry: Column) -> Column:
            seen = acc["seen"] + entry["present"]
            return F.struct(
                seen.alias("seen"),
                *[
                    F.coalesce(acc[name], F.when(seen > at, entry["weight"])).alias(name)
                    for name, at in (("low", low), ("high", high))
                ],
            )

        none = F.lit(None).cast("double")
        start = F.struct(F.lit(0).cast("bigint").alias("seen"), none.alias("low"), none.alias("high"))
        return F.aggregate(
            histogram, start, passed, lambda acc: acc["low"] + (acc["high"] - acc["low"]) * (place - low)
        )

    return over_values(finish)


METHODS: Mapping[str, Method] = {
    "mean": Method(
        F.sum, lambda value, present, rows: value / rows, rounded=True, linear=True, merge=F.sum
    ),
    "sum": Method(F.sum, rounded=True, linear=True, merge=F.sum),
    "cat": Method(F.sum, linear=True, merge=F.sum),
}


@dataclass(frozen=True)
class State:
    """Where a compress program stands.

    ``raw`` rows are single records, whose number per case has no bound;
    ``order`` sorts the rows of a case; ``unique`` lists hold a token once;
    ``cell`` names the columns raw rows were joined on; ``rfg`` tells whether
    entries carry their grain group. ``stand_in`` holds one ``[UNK]`` row per
    case until the first roll-up, which drops the ones not needed. ``summed``
    are the first roll-up's sums with those of the stand-ins, where they were
    taken without joining cases and records (``operators/running.py``).
    """

    rows: DataFrame
    prefix: tuple[str, ...]
    order: tuple[str, ...]
    stand_in: DataFrame | None = None
    flat: bool = False
    exact: bool = False
    raw: bool = True
    unique: bool = False
    rfg: bool = False
    sfx: tuple[str, ...] = ()
    counts: tuple[str, ...] = ()
    cell: tuple[str, ...] = ()
    summed: DataFrame | None = None

    @property
    def lists(self) -> list[str]:
        return [f"tkn_{s}" for s in self.sfx if s != "rfg"]


def start(
    observed: DataFrame,
    cases: DataFrame | None,
    vocab: Vocabulary,
    unique: bool = False,
    rfg: bool = False,
) -> State:
    """Encoded token rows as a program state. With ``cases``, a stand-in
    ``[UNK]`` row per case runs along until the first roll-up shows which
    cases have rows, so no second pass over the observation is needed to find
    the empty ones."""
    cell = [c for c in CELL if c in observed.columns and c not in CASE_KEY]
    rows = observed.select(*CASE_KEY, *LEVELS, "dt", "rec_id", "tok", *cell)
    stand_in = None
    if cases is not None:
        columns = {level: F.lit(0).cast("bigint") for level in LEVELS}
        columns["dt"] = F.lit(None).cast(rows.schema["dt"].dataType)
        columns["rec_id"] = F.lit(None).cast(rows.schema["rec_id"].dataType)
        columns.update({c: F.lit(None).cast(rows.schema[c].dataType) for c in cell})
        group = F.lit(vocab.special[vocab.unk][1]) if rfg else None
        columns["tok"] = F.array(token_entry(F.lit(UNK_IDX), F.lit(1.0), group))
        stand_in = cases.select(*CASE_KEY, *[columns[c].alias(c) for c in rows.columns[len(CASE_KEY) :]])
    order = ("dt", "rec_id")
    return State(rows, LEVELS, order, stand_in, unique=unique, rfg=rfg, cell=tuple(cell))


def _on_rows(state: State, change: Callable[[DataFrame], DataFrame]) -> State:
    """The same row-wise change on the rows and on the stand-ins."""
    stand_in = None if state.stand_in is None else change(state.stand_in)
    return replace(state, rows=change(state.rows), stand_in=stand_in)


def _gathered(state: State, level: str, group: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Group the rows and the stand-ins, which get no ``level`` to tell them
    apart. They are grouped separately: rows that already lie together need
    no shuffle for it."""
    rows = group(state.rows)
    if state.stand_in is None:
        return rows
    stand_in = group(state.stand_in).withColumn(level, F.lit(None).cast("bigint"))
    return rows.unionByName(stand_in)


def _settled(state: State, level: str, prefix: Sequence[str], rows: DataFrame) -> DataFrame:
    """Drop the stand-ins of cases that have rows of their own, and bring
    back the levels above ``level``: each follows from the finer one."""
    if state.stand_in is not None:
        has_rows = F.max(F.col(level).isNotNull()).over(Window.partitionBy(*CASE_KEY))
        rows = rows.withColumn("__has", has_rows)
        rows = rows.where(F.col(level).isNotNull() | ~F.col("__has")).drop("__has")
        rows = rows.withColumn(level, F.coalesce(level, F.lit(0).cast("bigint")))
    return rows.withColumns({c: coarser(level, c) for c in prefix if c != level})


def flatten(state: State) -> State:
    """Tokens as weights: of a repeated token the last entry counts."""
    tok = F.col("tok") if state.unique else last_per_idx(F.col("tok"))
    flat = _on_rows(state, lambda rows: rows.withColumn("tok", tok).drop(*state.lists))
    return replace(flat, flat=True, unique=True, sfx=())


def roll_up(state: State, rule: str, method: Method, vocab: Vocabulary) -> State:
    """Group flat tokens by the columns down to the rule's target. The number
    of rows of each group joins the tokens under the rule's own name."""
    level = split_rule(rule)[1]
    prefix = state.prefix[: state.prefix.index(level) + 1]
    natural = state.exact and not method.linear
    one = F.lit(1).cast("bigint") if state.exact else F.lit(1.0)
    no_group = F.lit(ROW_IDX) if state.rfg else None
    row = F.array(token_entry(F.lit(ROW_IDX), one, no_group))
    group = ["rfg_idx"] if state.rfg else []
    same_group = [F.min("rfg_idx").alias("rfg_idx")] if state.rfg else []
    merged = state.raw and (method.merge is not None or method.values)
    # Methods over values count equal weights first.
    entry = ["idx", "weight"] if method.values else ["idx"]

    def sums(rows: DataFrame) -> DataFrame:
        long = rows.select(
            *CASE_KEY, level, *state.cell, F.explode(F.concat(row, F.col("tok"))).alias("t")
        )
        weight = F.col("t.w") / 1000 if natural else F.col("t.w")
        fields = ["t.idx", *[f"t.{g}" for g in group], weight.alias("weight")]
        long = long.select(*CASE_KEY, level, *state.cell, *fields)
        # Grouping by the join's cell as well needs no shuffle after it.
        by = state.cell if merged else ()
        value = [] if method.values else [method.agg(F.col("weight")).alias("v")]
        summed = long.groupBy(*CASE_KEY, *by, level, *entry).agg(
            *same_group, *value, F.count("*").alias("present")
        )
        return summed.drop(*by)

    summed = _gathered(state, level, sums) if state.summed is None else state.summed
    if state.raw and state.summed is None:
        # The one shuffle after the join. From here on a case is small (time
        # buckets x vocabulary) and placed by case for all later steps.
        summed = summed.repartition(*CASE_KEY)
    if merged and state.summed is None:
        value = [] if method.values else [method.merge(F.col("v")).alias("v")]
        summed = summed.groupBy(*CASE_KEY, level, *entry).agg(
            *same_group, *value, F.sum("present").alias("present")
        )
    if method.values:
        listed = F.sort_array(F.collect_list(F.struct(F.col("weight").cast("double").alias("weight"), "present")))
        summed = summed.groupBy(*CASE_KEY, level, "idx").agg(
            *same_group, listed.alias("v"), F.sum("present").alias("present")
        )
    grouped = summed.groupBy(*CASE_KEY, level).agg(
        F.max(F.when(F.col("idx") == ROW_IDX, F.col("present"))).alias("n"),
        F.collect_list(F.struct("idx", *group, "v", "present")).alias("e"),
    )
    grouped = _settled(state, level, prefix, grouped)
    exact = method.rounded or (state.exact and method.linear)

    def finished(e):
        value, n = e["v"], F.col("n")
        if method.values:
            absent = F.struct(F.lit(0.0).alias("weight"), (n - e["present"]).alias("present"))
            value = F.when(n > e["present"], F.sort_array(F.concat(value, F.array(absent)))).otherwise(value)
        if not method.rounded:
            return method.finish(value, e["present"], n)
        if state.exact and method.linear:
            thousandths = method.finish(value, e["present"], n)
        elif method.linear:
            thousandths = method.finish(value * 1000, e["present"], n)
        else:
            thousandths = method.finish(value, e["present"], n) * 1000
        return F.rint(thousandths)

    kind = "bigint" if exact else "double"
    tokens = F.transform(
        F.filter("e", lambda e: e["idx"] != ROW_IDX),
        lambda e: token_entry(e["idx"], finished(e).cast(kind), e["rfg_idx"] if state.rfg else None),
    )
    idx, rfg_idx = vocab.special[rule]
    n = (F.col("n") * 1000 if exact else F.col("n")).cast(kind)
    count = F.array(token_entry(F.lit(idx), n, F.lit(rfg_idx) if state.rfg else None))
    rows = grouped.withColumn("tok", F.concat(tokens, count)).drop("e", "n")
    return replace(
        state, rows=rows, stand_in=None, prefix=prefix, order=prefix, exact=exact, raw=False, counts=(),
        cell=(), summed=None,
    )


def concatenate(state: State, rule: str) -> State:
    """``cat`` on lists: one list per group, rows in their order; the row
    count becomes a column."""
    level = split_rule(rule)[1]
    prefix = state.prefix[: state.prefix.index(level) + 1]
    columns = ["tok", *state.lists]
    ordered = F.sort_array(F.collect_list(F.struct(*state.order, *columns)))

    def gathered(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*CASE_KEY, level).agg(ordered.alias("e"), F.count("*").alias(rule))

    grouped = _settled(state, level, prefix, _gathered(state, level, gathered))
    joined = {c: F.flatten(each(F.col("e"), c)) for c in columns}
    rows = grouped.withColumns(joined).drop("e")
    return replace(
        state, rows=rows, stand_in=None, prefix=prefix, order=prefix, raw=False, unique=False,
        counts=(rule,), cell=(),
    )


def fill_empty(state: State) -> State:
    """Without a roll-up, the cases without rows are found by an anti join
    and keep their stand-ins."""
    empty = state.stand_in.join(state.rows.select(*CASE_KEY).distinct(), list(CASE_KEY), "left_anti")
    return replace(state, rows=state.rows.unionByName(empty), stand_in=None)


def concatenated_rows(
    state: State, rule: str, cell_us: int = UNIT_MICROS["H"]
) -> DataFrame:
    """``cat`` of single records as rows ``(case, levels, pos, idx, w)``
    instead of lists, for windows that may hold any number of records. The
    place of each entry comes from counts per time cell of ``cell_us``."""
    level = split_rule(rule)[1]
    prefix = state.prefix[: state.prefix.index(level) + 1]
    # Written once: empty cases, counts and ranks are three passes over it.
    state = replace(state, rows=materialize(state.rows))
    rows = fill_empty(state).rows.withColumn("size", F.size("tok"))
    cell = F.coalesce(bucket(micros(rows, "dt"), cell_us), F.lit(0).cast("bigint"))
    placed = with_position(
        rows.select(*CASE_KEY, level, *state.order, "tok", "size"),
        [*CASE_KEY, level], cell, state.order, "first", "size",
    )
    long = placed.select(*CASE_KEY, level, "first", F.posexplode("tok").alias("i", "t"))
    levels = [coarser(level, c).alias(c) if c != level else F.col(c) for c in prefix]
    return long.select(
        *CASE_KEY, *levels, (F.col("first") + F.col("i")).alias("pos"), "t.idx", F.col("t.w").alias("weight")
    )


def convert(state: State) -> State:
    """Back to lists, in vocabulary order; only positive weights remain."""
    listed = F.sort_array(F.filter("tok", lambda t: t["w"] > 0))
    return replace(_on_rows(state, lambda rows: rows.withColumn("tok", listed)), flat=False)


def add_suffix(state: State, sfx: str) -> State:
    """A list parallel to the tokens: grain group (``rfg``), position inside
    the group (``keyInrfg``), a time column (``DInCP``), or the index of a
    time bucket inside a coarser one (``HInD``)."""
    tok, name = F.col("tok"), f"tkn_{sfx}"
    base = sfx.replace("InCP", "")

    def repeated(value: str):
        return lambda rows: rows.withColumn(name, F.array_repeat(F.col(value), F.size(tok)))

    if sfx == "keyInrfg":
        ranks = rank_in_group(each(tok, "rfg_idx"))
        state = _on_rows(state, lambda rows: rows.withColumn(name, ranks))
    elif base in (*state.prefix, *state.counts):
        state = _on_rows(state, repeated(base))
    elif sfx != "rfg":
        indexed = _on_rows(state, lambda rows: _bucket_index(rows, sfx, state.raw))
        state = _on_rows(_on_rows(indexed, repeated("__i")), lambda rows: rows.drop("__i"))
    return replace(state, sfx=(*state.sfx, sfx))


def _bucket_index(rows: DataFrame, rule: str, raw: bool) -> DataFrame:
    """``__i``: index of bucket A among the buckets A of the row's B."""
    source, target = split_rule(rule)
    # Rows of single records run from old to new, so buckets count down.
    order = F.desc(source) if raw else F.asc(source)
    index = F.dense_rank().over(Window.partitionBy(*CASE_KEY, target).orderBy(order)) - 1
    if not raw:
        return rows.withColumn("__i", index)
    # Records have no bound per case: rank their distinct buckets only.
    keys = [*CASE_KEY, target, source]
    return rows.join(rows.select(*keys).distinct().withColumn("__i", index), keys)


def run_program(state: State, program: Compress, vocab: Vocabulary) -> State:
    methods = {**METHODS, **program.methods}
    for step in program.steps:
        for action, *args in step.actions:
            if action == "flatten":
                state = flatten(state)
            elif action == "convert":
                state = convert(state)
            elif action == "add_sfx":
                for sfx in args[0]:
                    state = add_suffix(state, sfx)
            elif args[0] not in methods:
                raise ValueError(f"unknown compress method {args[0]!r}")
            elif state.flat:
                state = roll_up(state, step.rule, methods[args[0]], vocab)
            else:
                state = concatenate(state, step.rule)
    return state


def weight_of(state: State) -> Callable[[Column], Column]:
    """Natural weight of a token entry."""
    return (lambda t: t["w"] / 1000) if state.exact else (lambda t: t["w"])


def value_columns(state: State) -> dict[str, Column]:
    """The feature's parallel lists: ids, weights, and every suffix."""
    tok, weight = F.col("tok"), weight_of(state)
    columns = {
        "keyidx": each(tok, "idx"),
        "wgt": F.transform(tok, weight),
    }
    for sfx in state.sfx:
        if sfx == "rfg":
            columns["rfgidx"] = each(tok, "rfg_idx")
        else:
            columns[sfx] = F.col(f"tkn_{sfx}")
    return columns


def decoded(state: State, vocab: Vocabulary) -> DataFrame:
    """Long form with token names: one row per list entry."""
    weight = weight_of(state)
    kept = [*CASE_KEY, *state.prefix, *state.counts]
    long = state.rows.select(*kept, F.posexplode("tok").alias("pos", "t"))
    long = long.select(*kept, "pos", "t.idx", weight(F.col("t")).alias("weight"))
    names = vocab.lookup(long, "idx", by="idx")
    return names.select(*kept, "pos", "idx", F.col("grn").alias("token"), "rfg", "rfg_idx", "weight")


def wide(state: State, vocab: Vocabulary, tokens: Sequence[str] | None = None) -> DataFrame:
    """Flat tokens as one column per named token, absent ones 0; by default
    one per token of the vocabulary, in its order. A table of more than
    ``MAX_COLUMNS`` columns is refused: take the long form then."""
    if tokens is None:
        if vocab.size > MAX_COLUMNS:
            raise ValueError(f"{vocab.size} tokens are too many columns; name the ones wanted")
        tokens = [r.grn for r in vocab.df.select("idx", "grn").orderBy("idx").collect()]
    long = decoded(state, vocab)
    by_row = [*CASE_KEY, *state.prefix]
    pivoted = long.groupBy(*by_row).pivot("token", list(tokens)).agg(F.first("weight"))
    return pivoted.na.fill(0.0, list(tokens))
