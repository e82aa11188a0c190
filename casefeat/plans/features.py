"""The feature chain as one lazy plan over all cases."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Feature, Tokens, split_rule
from ..constants import CASE_KEY, LEVELS, UNK_IDX
from ..functions.timing import DISTANCE, add_relative_time
from ..functions.tokens import last_per_idx
from ..operators import compress as cmp
from ..operators.filters import (
    can_be_listed,
    counts_bare_times,
    filter_condition,
    filter_rows,
    good_buckets,
    keep_full,
    keep_listed,
    with_good_lists,
)
from ..operators.nest import nest, one_row_per_case
from ..operators.observe import MAX_WINDOWS, check_period, join_form, join_survey, observe, observe_windows
from ..operators.running import summed_in_line
from ..operators.tokens import TOKEN_LISTS, attach_tokens, encode_tokens, encoded_records, record_label, with_unk
from ..operators.vocab import Vocabulary, build_vocab
from ..session import materialize, written
from ..sources.records import load_records


def observation(cases: DataFrame, feature: Feature, records: DataFrame, **how) -> DataFrame:
    return observe(cases.select(*CASE_KEY), records, feature.period, **how)


def source_records(feature: Feature) -> DataFrame:
    """The feature's records that its filter's predicate keeps."""
    return filter_rows(load_records(feature.source), feature.filter)


def filtered_rows(cases: DataFrame, feature: Feature, records: DataFrame, **how) -> DataFrame:
    """Observed and filtered records.

    Thresholds are settled first, on bare times, and their good buckets
    travel with the cases into the one join that carries tokens: rows of
    failing buckets are never produced, and no row is shuffled to be kept.
    """
    period = feature.period
    rules = feature.filter.rules_for(feature.source.name)
    keys = cases.select(*CASE_KEY)
    listed, joined = [], []
    if how.get("how", "auto") == "auto":
        how = {**how, "how": join_form(records, how.get("hot_cell_rows"))}
    if how["how"] == "surveyed" and "found" not in how:
        # One survey serves the thresholds and the join that carries tokens.
        thin = source_records(feature).select("pid", "dt")
        how = {**how, "found": join_survey(keys, thin, period, how.get("width_us"))}
    if rules:
        bare = source_records(feature).select("pid", "rec_id", "dt")
        times_only = counts_bare_times(rules)
        if times_only:
            bare = bare.select("pid", "dt").distinct()
        thin = add_relative_time(observe(keys, bare, period, keep_cell=True, **how))
        for good in good_buckets(thin, rules, times_only):
            (listed if can_be_listed(good.columns[-1], period) else joined).append(good)
    rows = observe(with_good_lists(keys, listed), records, period, keep_cell=True, **how)
    rows = keep_listed(add_relative_time(rows), listed)
    for good in joined:
        rows = rows.join(good, good.columns, "left_semi")
    return rows


def settled_rows(observed: DataFrame, feature: Feature) -> DataFrame:
    """The rows of an observation that the feature's filter keeps, with their
    levels: what :func:`filtered_rows` gives, starting from rows that were
    observed before, with all columns they have."""
    rows = add_relative_time(filter_rows(observed, feature.filter))
    return keep_full(rows, feature.filter.rules_for(feature.source.name))


def token_rows(cases: DataFrame, feature: Feature, settled: DataFrame | None = None, **how) -> DataFrame:
    """Filtered records of each case with their token lists; ``settled`` are
    its filtered records where they are known."""
    if settled is not None:
        return attach_tokens(settled, feature.tokens)
    records = attach_tokens(source_records(feature), feature.tokens)
    lists = [c for c in records.columns if c in TOKEN_LISTS]
    return filtered_rows(cases, feature, records.select("pid", "rec_id", "dt", *lists), **how)


def vocabulary(tokens: Tokens, rules: Sequence[str]) -> Vocabulary:
    """The feature's vocabulary with the count tokens of its steps."""
    if isinstance(tokens.vocab, Vocabulary):
        return tokens.vocab.extended(rules)
    return build_vocab(tokens.vocab, rules, tokens.unk)


def compressed(
    cases: DataFrame, feature: Feature, stored: DataFrame | None = None, settled: DataFrame | None = None,
    vocab: Vocabulary | None = None, **how,
) -> tuple[cmp.State, Vocabulary]:
    """The compress program's final state."""
    state, vocab = token_state(cases, feature, stored, settled, vocab, **how)
    if not any(step.method for step in feature.compress.steps):
        state = cmp.fill_empty(state)
    return cmp.run_program(state, feature.compress, vocab), vocab


def _flat(feature: Feature) -> bool:
    """Whether the program flattens first. Flattening keeps the last of
    repeated tokens, which depends on the record alone."""
    steps = feature.compress.steps
    return bool(steps) and steps[0].actions[0][0] == "flatten"


def _grouped(feature: Feature) -> bool:
    """Whether the program asks for grain groups."""
    wanted = {s for step in feature.compress.steps for a in step.actions if a[0] == "add_sfx" for s in a[1]}
    return not wanted.isdisjoint({"rfg", "keyInrfg"})


def _adds_up(feature: Feature) -> bool:
    """Whether the program starts with plain sums over all observed records."""
    if not _flat(feature) or _grouped(feature) or feature.filter.rules_for(feature.source.name):
        return False
    steps = feature.compress.steps
    action = steps[0].actions[1] if len(steps[0].actions) > 1 else ("",)
    methods = {**cmp.METHODS, **feature.compress.methods}
    method = methods.get(action[1]) if action[0] == "method" else None
    return method is not None and method.linear and method.agg is F.sum and method.merge is F.sum


def token_state(
    cases: DataFrame, feature: Feature, stored: DataFrame | None = None, settled: DataFrame | None = None,
    vocab: Vocabulary | None = None, **how,
) -> tuple[cmp.State, Vocabulary]:
    """Where the compress program starts. Tokens are turned into ids once per
    record, so cases and their windows only ever move numbers. ``stored`` are
    finished token rows of the cases (the feature cut off after its tokens),
    ``settled`` their filtered records, with or without their ids: then
    nothing is observed again. ``vocab`` is the vocabulary with the program's
    count tokens, where it is there already."""
    tokens, program = feature.tokens, feature.compress
    vocab = vocab or vocabulary(tokens, program.rules)
    flat, rfg = _flat(feature), _grouped(feature)
    if stored is not None:
        seen = stored.where(F.col("dt").isNotNull()).withColumnRenamed("R", "rec_id")
        seen = seen.select(*CASE_KEY, *LEVELS, "dt", "rec_id", "tkn_key", "tkn_wgt")
        records = encode_tokens(seen, vocab, tokens.on_unknown, rfg)
    elif settled is not None and "tok" in settled.columns:
        return cmp.start(settled, cases, vocab, unique=flat, rfg=rfg), vocab
    elif settled is not None:
        kept = [*[c for c in CASE_KEY if c != "pid"], *LEVELS]
        records = encoded_records(settled, tokens, vocab, tokens.on_unknown, rfg, kept)
    else:
        records = encoded_records(source_records(feature), tokens, vocab, tokens.on_unknown, rfg)
    if flat:
        records = records.withColumn("tok", last_per_idx(F.col("tok")))
    given = stored is not None or settled is not None
    rows = records if given else filtered_rows(cases, feature, records, **how)
    state = cmp.start(rows, cases, vocab, unique=flat, rfg=rfg)
    if not given and not how and _adds_up(feature):
        level = split_rule(program.steps[0].rule)[1]
        keys = cases.select(*CASE_KEY)
        state = replace(state, summed=summed_in_line(keys, records, feature.period, level, cmp.ROW_IDX, UNK_IDX))
    return state, vocab


def feature_rows(
    cases: DataFrame, feature: Feature, stored: DataFrame | None = None, settled: DataFrame | None = None,
    vocab: Vocabulary | None = None, **how,
) -> DataFrame:
    """A compressed feature's output rows by case, ``CP`` left out."""
    state, _ = compressed(cases, feature, stored, settled, vocab, **how)
    program = feature.compress
    values = cmp.value_columns(state)
    layers = dict.fromkeys([*program.prefix_layers, *program.focal_layers])
    rows = state.rows.select(*CASE_KEY, *layers, *[v.alias(k) for k, v in values.items()])
    if program.prefix_layers:
        rows = nest(rows, program.prefix_layers, program.focal_layers, list(values))
    return rows.drop("CP")


def build_feature(
    cases: DataFrame, feature: Feature, stored: DataFrame | None = None, settled: DataFrame | None = None, **how
) -> DataFrame:
    """Rows of one feature; the chain stops at the first stage not set.
    ``how`` picks the form of the interval join (see ``observe``). A feature
    may start from ``settled`` rows (its filtered records with their levels),
    one to compress from ``stored`` token rows as well."""
    if feature.source is None:
        return check_period(cases, feature.period)
    if feature.filter is None:
        return observation(cases, feature, load_records(feature.source), **how)
    if feature.tokens is None:
        rows = settled
        if rows is None and feature.wide:
            rows = filtered_rows(cases, feature, source_records(feature), **how)
        if feature.wide:
            inner = [c for c in rows.columns if c.startswith("__")]
            others = [c for c in rows.columns if c not in (*CASE_KEY, "rec_id", "dt", *LEVELS, *inner)]
            return rows.select(*CASE_KEY, "rec_id", "dt", *others, *LEVELS)
        if rows is None:
            rows = filtered_rows(cases, feature, source_records(feature).select("pid", "rec_id", "dt"), **how)
        return rows.select(*CASE_KEY, "rec_id", "dt")
    if feature.compress is None:
        rows = with_unk(cases, token_rows(cases, feature, settled, **how), feature.tokens.unk)
        lists = [c for c in rows.columns if c in TOKEN_LISTS]
        return rows.select(*CASE_KEY, *LEVELS, "dt", record_label(feature.source.name).alias("R"), *lists)
    return feature_rows(cases, feature, stored, settled, **how)


def row_order(feature: Feature) -> list[str]:
    """Columns that order a feature's rows within a case."""
    if feature.source is None:
        return []
    if feature.tokens is None:
        return ["dt", "rec_id"]
    if feature.compress is None:
        return ["dt", "R"]
    layers = feature.compress.prefix_layers[:1] or feature.compress.focal_layers
    return [c for c in layers if c != "CP"]


def shared_observation(cases: DataFrame, features: Sequence[Feature]) -> list[tuple[DataFrame, Vocabulary | None]]:
    """The observed rows of each of several features of one source (and the
    vocabulary they are encoded with), read off one written table: one scan, one interval join, whatever the number of
    features.

    Predicates are settled per record, as bits of the features that want it;
    tokens become ids per record, once for features that encode alike; a
    record then meets a case once and carries the bits of the windows it lies
    in. Features without tokens read the columns they show.
    """
    rows = load_records(features[0].source)
    shown = [c for c in rows.columns if c not in ("pid", "rec_id", "dt")]
    wanted, added, columns, vocabs = F.lit(0).cast("bigint"), {}, [], []
    for i, feature in enumerate(features):
        condition = None if feature.filter is None else filter_condition(feature.filter)
        bit = F.lit(1 << i).cast("bigint")
        wanted = wanted + (bit if condition is None else F.when(condition, bit).otherwise(F.lit(0).cast("bigint")))
        names, vocab = {}, None
        if feature.compress is not None:
            vocab, flat, rfg = vocabulary(feature.tokens, feature.compress.rules), _flat(feature), _grouped(feature)
            same = (id(feature.tokens), flat, rfg, tuple(feature.compress.rules))
            if same not in added:
                added[same] = f"tok__{i}"
                kept = [c for c in rows.columns if c not in ("pid", "rec_id", "dt")]
                rows = encoded_records(rows, feature.tokens, vocab, feature.tokens.on_unknown, rfg, kept, added[same])
                if flat:
                    rows = rows.withColumn(added[same], last_per_idx(F.col(added[same])))
            names = {added[same]: "tok"}
        elif feature.filter is None or feature.tokens is not None:
            names = {c: c for c in shown}
        columns.append(names)
        vocabs.append(vocab)
    moved = list(dict.fromkeys(c for names in columns for c in names))
    records = rows.select("pid", "rec_id", "dt", *moved, wanted.alias("windows"))
    pairs = written(observe_windows(cases.select(*CASE_KEY), records, [f.period for f in features]), "windows")
    out = []
    for i, (names, vocab) in enumerate(zip(columns, vocabs, strict=True)):
        mine = pairs.where(F.col("windows").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0)
        shown_as = [F.col(c).alias(n) for c, n in names.items()]
        out.append((mine.select(*CASE_KEY, "rec_id", "dt", DISTANCE, *shown_as), vocab))
    return out


def _observed_together(cases: DataFrame, features: Sequence[Feature]) -> dict[int, tuple[DataFrame, Vocabulary | None]]:
    """Observed rows of the features that share a source, by their place."""
    sources: dict[int, list[int]] = {}
    for i, f in enumerate(features):
        if f.source is not None:
            sources.setdefault(id(f.source), []).append(i)
    out = {}
    for places in sources.values():
        for at in range(0, len(places), MAX_WINDOWS):
            some = places[at : at + MAX_WINDOWS]
            if len(some) > 1:
                out |= zip(some, shared_observation(cases, [features[i] for i in some]), strict=True)
    return out


def build_features(cases: DataFrame, features: Sequence[Feature], **how) -> DataFrame:
    """Features side by side: one row per case, one column per feature with
    the feature's rows as a list (null when it has none). Features of one
    source share one interval join; ``how`` is the form of the others'."""
    names = [f.column for f in features]
    if len(set(names)) != len(names):
        raise ValueError("two features share a name; give one an alias")
    cases = materialize(cases.select(*CASE_KEY))
    together = _observed_together(cases, features)
    joined = cases
    for i, feature in enumerate(features):
        if i not in together:
            rows = build_feature(cases, feature, **how)
        elif feature.filter is None:
            rows = together[i][0].drop(DISTANCE)
        else:
            # The predicate was settled before the join.
            seen, vocab = together[i]
            seen = keep_full(add_relative_time(seen), feature.filter.rules_for(feature.source.name))
            given = {"vocab": vocab} if vocab is not None else {}
            rows = build_feature(cases, feature, settled=seen, **given)
        joined = joined.join(one_row_per_case(rows, row_order(feature), feature.column), list(CASE_KEY), "left")
    return joined


__all__ = [
    "build_feature", "build_features", "compressed", "feature_rows", "settled_rows", "shared_observation", "token_rows",
    "token_state",
]
