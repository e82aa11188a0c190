"""Registered queries: ``name -> (spark, folder of tables) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import (
    CheckPeriod,
    Compress,
    Feature,
    Filter,
    GrainColumn,
    GrainTable,
    RecordSource,
    Step,
    Tokens,
    rolled,
)
from ..constants import CASE_KEY, LEVELS
from ..functions.hashing import entity_group
from ..functions.timing import add_relative_time, bucket, daypart, micros
from ..functions.tokens import number_to_token
from ..operators import cases as case_sets
from ..operators import compress as cmp
from ..operators.nest import in_batches
from ..operators.nearest import Nearest, case_function, nearest_records
from ..operators.observe import check_period, observe, observed_count, record_count
from ..operators.observe import observe_windows as windows_of
from ..operators.tokens import attach_tokens, one_token_per_slot
from ..operators.vocab import (
    Vocabulary,
    build_vocab,
    calendar_vocab,
    calendar_years,
    extend_vocab,
    learn_vocab,
    vocab_conflicts,
    vocab_rows,
)
from ..plans.features import build_feature, build_features, compressed, token_state
from ..session import configure, scratch_folder, with_default_folder
from ..sources.chain import align_to_leaf, collect_per_leaf, id_chain
from ..sources.records import load_records, read_grouped, union_records, write_grouped
from ..sources.store import FeatureStore, lists_from_json, lists_to_json

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

REL = {"CP": "rel_cp", "M": "rel_m", "W": "rel_w", "D": "rel_d", "H": "rel_h", "5Min": "rel_5min"}
BF24H, BF7D = CheckPeriod.parse("Bf24H"), CheckPeriod.parse("Bf7D")
AF2H, AF24H = CheckPeriod.parse("Af2H"), CheckPeriod.parse("Af24H")
AFTER_TRIGGER = {p: CheckPeriod.parse(p, start_exclusive=True) for p in ("Af2H", "Af24H")}
FULL_DAYS = Filter(thresholds={"DTInD": 3})
WHOLE = Filter(thresholds={})


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def entry(spark: SparkSession) -> DataFrame:
    """The whole chain on the smallest tables."""
    return compress_mean_day(spark, "/root/testdata/sf0.001")


# -- inputs -------------------------------------------------------------


_TABLES: dict[tuple[str, str, str], DataFrame] = {}
_VOCABS: dict[tuple[str, str, str], Vocabulary] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table; its schema is read once per application."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _TABLES:
        _TABLES[key] = configure(with_default_folder(spark)).read.parquet(f"{sf}/{name}.parquet")
    return _TABLES[key]


def stored_vocab(spark, sf, name: str, tables: Callable[[], list[DataFrame]]) -> Vocabulary:
    """A vocabulary that is learned and written once per application, and
    read from then on."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _VOCABS:
        learned = vocab_rows(tables())
        path = f"{scratch_folder(spark, 'vocabulary')}"
        learned.write.parquet(path)
        _VOCABS[key] = Vocabulary.read(spark, path)
    return _VOCABS[key]


def event_source(spark, sf, *columns: str) -> RecordSource:
    return RecordSource("Events", table(spark, sf, "events"), "user_id", "event_id", "ts", columns)


def purchase_cases(spark, sf) -> DataFrame:
    purchases = table(spark, sf, "events").where(F.col("event_type") == "purchase")
    source = RecordSource("Purchase", purchases, "user_id", "event_id", "ts", ())
    return case_sets.trigger_cases(load_records(source), F.col("rec_id").cast("bigint"))


def event_grain() -> GrainColumn:
    return GrainColumn("EventGrn", lambda: [F.col("event_type")])


def value_token() -> Column:
    return number_to_token("value", F.col("value"), 50)


def value_grain(weighted: bool = False) -> GrainColumn:
    wgt = (lambda: [F.col("value")]) if weighted else None
    return GrainColumn("ValueGrn", lambda: [value_token()], wgt)


def daypart_grain() -> GrainColumn:
    return GrainColumn("MEANGrn", lambda: [daypart_token()])


def daypart_token() -> Column:
    return F.concat(F.lit("MEAN-"), daypart(F.col("dt")))


def event_vocab(spark, sf) -> DataFrame:
    return learn_vocab(table(spark, sf, "events"), F.array("event_type"), "EventGrn")


def value_vocab(spark, sf) -> DataFrame:
    return learn_vocab(table(spark, sf, "events"), F.array(value_token()), "ValueGrn")


def daypart_vocab(spark, sf) -> DataFrame:
    events = table(spark, sf, "events").withColumn("dt", F.col("ts"))
    return learn_vocab(events, F.array(daypart_token()), "MEANGrn")


def calendar(spark, sf) -> DataFrame:
    """Calendar tokens of the years that the events have."""
    return calendar_vocab(spark, *calendar_years(table(spark, sf, "events"), "ts"))


def full_tables(spark, sf) -> list[DataFrame]:
    return [event_vocab(spark, sf), value_vocab(spark, sf), calendar(spark, sf)]


def short_tables(spark, sf) -> list[DataFrame]:
    return [event_vocab(spark, sf), daypart_vocab(spark, sf)]


def short_tokens(spark, sf, **settings) -> Tokens:
    """Event type and part of the day."""
    vocab = stored_vocab(spark, sf, "short", lambda: short_tables(spark, sf))
    return Tokens("Short", [event_grain(), daypart_grain()], vocab=vocab, **settings)


def full_tokens(spark, sf, weighted: bool = False) -> Tokens:
    """Event type, binned value and calendar."""
    vocab = stored_vocab(spark, sf, "full", lambda: full_tables(spark, sf))
    return Tokens("Full", [event_grain(), value_grain(weighted)], calendar="RDTCal", vocab=vocab)


def event_feature(
    spark, sf, steps, period=BF7D, flt=FULL_DAYS, tokens=None, methods=None, source=None, **layers
) -> Feature:
    program = Compress(steps, methods=methods or {}, **(layers or {"focal_layers": ["CP"]}))
    source = source or event_source(spark, sf, "event_type", "value")
    return Feature(period, source, flt, tokens or short_tokens(spark, sf), program)


# -- output helpers -----------------------------------------------------


def case_number() -> Column:
    return F.col("case_id").cast("bigint").alias("case_id")


def rec_number() -> Column:
    return F.col("rec_id").cast("bigint").alias("rec_id")


def rel_columns(levels=LEVELS) -> list[Column]:
    return [F.col(level).alias(REL[level]) for level in levels]


def joined(col) -> Column:
    """A list as text."""
    return F.array_join(F.transform(col, lambda v: v.cast("string")), ",")


def thousandths(col) -> Column:
    """A list of weights as whole thousandths in text."""
    whole = F.transform(col, lambda w: F.rint(w * 1000).cast("bigint").cast("string"))
    return F.array_join(whole, ",")


def long_rows(cases, feature, levels, *keys: str, stored=None) -> DataFrame:
    """One row per case, bucket and token with its weight."""
    state, vocab = compressed(cases, feature, stored)
    return cmp.decoded(state, vocab).select(case_number(), *keys, *rel_columns(levels), "token", "weight")


# -- cases, ids, storage --------------------------------------------------


@query
def trigger_cases(spark, sf):
    return purchase_cases(spark, sf).select(case_number(), "pid", "pred_dt")


def customers(spark, sf) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    located = table(spark, sf, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    return located.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")


@query
def entity_groups(spark, sf):
    grouped = case_sets.entity_groups(customers(spark, sf), ["r_name", "c_mktsegment"])
    return grouped.select("c_custkey", "r_name", "c_mktsegment", "group_id")


def order_chain(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return id_chain(
        [
            ("c_custkey", table(spark, sf, "customer")),
            ("o_orderkey", orders),
            ("l_linenumber", lines),
        ]
    )


@query
def id_chain_prefix(spark, sf):
    return order_chain(spark, sf)


@query
def level_alignment(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"
    )
    aligned = align_to_leaf(order_chain(spark, sf), orders)
    return aligned.select("c_custkey", "o_orderkey", "l_linenumber", "o_totalprice")


@query
def records_per_entity(spark, sf):
    records = load_records(event_source(spark, sf))
    records = records.select(F.col("pid").alias("c_custkey"), "dt", "rec_id")
    chain = id_chain([("c_custkey", table(spark, sf, "customer"))])
    day = bucket(micros(records, "dt"), 86_400_000_000)
    lists = collect_per_leaf(
        chain, records, ["dt", "rec_id"], day, ["dt", "rec_id"], "recs", chunk_rows=25
    )
    return lists.select(
        "c_custkey",
        "chunk",
        F.coalesce(F.size("recs"), F.lit(0)).cast("bigint").alias("n"),
        F.coalesce(F.array_join(F.transform("recs", lambda r: r["rec_id"]), ","), F.lit("")).alias("ids"),
    )


def grouped_events(spark, sf, **grouping) -> str:
    """Events written in storage groups."""
    records = load_records(event_source(spark, sf, "value"))
    path = scratch_folder(spark, "grouped")
    write_grouped(records, path, **grouping)
    return path


@query
def group_pruned_read(spark, sf):
    """Two storage groups only: the others' folders are not opened."""
    records = read_grouped(spark, grouped_events(spark, sf, range_size=4), [0, 2])
    return records.select(F.col("grp").cast("bigint").alias("grp"), "pid", rec_number(), "dt", "value")


@query
def group_hash_totals(spark, sf):
    """Groups by hash: every entity in one group, nothing lost."""
    records = read_grouped(spark, grouped_events(spark, sf, groups=8))
    entities = records.groupBy("pid").agg(F.count_distinct("grp").alias("groups"), F.count("*").alias("n_records"))
    return entities.select("pid", "groups", "n_records")


@query
def group_big_ids(spark, sf):
    """Ids beyond 2^53 keep their own groups."""
    pid = F.lit(2**53).cast("bigint") + F.col("user_id")
    records = table(spark, sf, "events").select(pid.alias("pid"))
    return records.groupBy("pid", entity_group(F.col("pid"), range_size=3).alias("grp")).agg(F.count("*").alias("n"))


@query
def group_buckets(spark, sf):
    records = read_grouped(spark, grouped_events(spark, sf, range_size=10))
    per_entity = records.groupBy("pid").agg(F.count("*").alias("n"))
    entities = id_chain([("c_custkey", table(spark, sf, "customer"))])
    entities = entities.withColumnRenamed("c_custkey", "pid")
    grp = entity_group(F.col("pid"), range_size=10)
    return (
        entities.join(per_entity, "pid", "left")
        .groupBy(grp.alias("grp"))
        .agg(
            F.count("*").alias("n_entities"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"),
        )
    )


@query
def union_groups(spark, sf):
    events = load_records(event_source(spark, sf, "value"))
    orders = load_records(order_source(spark, sf))
    both = union_records([events, orders])
    return both.select("pid", "rec_id", "dt", "value", "o_totalprice")


# -- periods and observations ----------------------------------------------


@query
def check_periods(spark, sf):
    out, bounds = purchase_cases(spark, sf), []
    for name, period in {
        "bf24h": BF24H,
        "af2m10d": CheckPeriod.parse("Af2M10D"),
        "mixed": CheckPeriod("mixed", -1.5, 0.25, "D"),
    }.items():
        names = {"dt_start": f"{name}_start", "dt_end": f"{name}_end"}
        out = check_period(out, period).withColumnsRenamed(names)
        bounds += names.values()
    return out.select(case_number(), *bounds)


def observed(spark, sf, period, **how) -> DataFrame:
    cases = purchase_cases(spark, sf)
    records = load_records(event_source(spark, sf, "event_type", "value"))
    rows = observe(cases, records, period, **how)
    return rows.select(case_number(), "pid", "pred_dt", rec_number(), "dt", "event_type", "value")


@query
def observe_before_24h(spark, sf):
    return observed(spark, sf, BF24H)


@query
def observe_after_2h(spark, sf):
    return observed(spark, sf, AF2H, how="plain")


@query
def observe_after_2h_excluding_trigger(spark, sf):
    return observed(spark, sf, AFTER_TRIGGER["Af2H"])


@query
def observe_bucketed(spark, sf):
    return observed(spark, sf, BF7D, width_us=86_400_000_000)


@query
def observe_hot_cells(spark, sf):
    return observed(spark, sf, BF7D, hot_cell_rows=10)


@query
def observe_time_pruned(spark, sf):
    return observed(spark, sf, BF24H, prune=True)


@query
def observe_surveyed(spark, sf):
    """Records cut to the cells that windows reach, crowded cells split."""
    return observed(spark, sf, BF7D, how="surveyed")


def order_source(spark, sf) -> RecordSource:
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderdate", "OrderDT")
    return RecordSource("Orders", orders, "o_custkey", "o_orderkey", None, ["o_totalprice", "absent"])


@query
def observe_orders_before_2m(spark, sf):
    """A second record type: its time column is found by name, unknown
    columns are ignored, and every order is a case."""
    source = order_source(spark, sf)
    records = load_records(source)
    cases = case_sets.trigger_cases(records)
    rows = build_feature(cases, Feature(CheckPeriod.parse("Bf2M"), source))
    return rows.select(case_number(), "pid", rec_number(), "dt", "o_totalprice")


def recnum(spark, sf, period, cases=None) -> DataFrame:
    cases = purchase_cases(spark, sf) if cases is None else cases
    counts = record_count(cases, load_records(event_source(spark, sf)), period)
    return counts.select(case_number(), "rec_num")


@query
def recnum_before(spark, sf):
    return recnum(spark, sf, BF24H)


@query
def recnum_after(spark, sf):
    return recnum(spark, sf, AF2H)


@query
def recnum_every_record(spark, sf):
    """Every event is a case observed over its own entity's events."""
    cases = case_sets.trigger_cases(load_records(event_source(spark, sf)), F.col("rec_id").cast("bigint"))
    return recnum(spark, sf, BF24H, cases)


@query
def recnum_one_entity(spark, sf):
    """All events as one entity's, every event a case: the crowded extreme."""
    events = table(spark, sf, "events").withColumn("everyone", F.lit("all"))
    records = load_records(RecordSource("Events", events, "everyone", "event_id", "ts", ()))
    cases = case_sets.trigger_cases(records, F.col("rec_id").cast("bigint"))
    counts = record_count(cases, records, BF24H)
    return counts.select(case_number(), "rec_num")


@query
def recnum_joined(spark, sf):
    cases = purchase_cases(spark, sf)
    seen = observe(cases, load_records(event_source(spark, sf)), BF24H)
    return observed_count(cases, seen).select(case_number(), F.col("nrow").cast("bigint").alias("nrow"))


@query
def relative_time(spark, sf):
    around = CheckPeriod("Around", -7, 7, "D")
    rows = observe(purchase_cases(spark, sf), load_records(event_source(spark, sf)), around)
    return add_relative_time(rows).select(case_number(), rec_number(), *rel_columns())


# -- filters ------------------------------------------------------------------


def filtered(spark, sf, flt: Filter, period=BF7D) -> DataFrame:
    plan = Feature(period, event_source(spark, sf), flt)
    rows = build_feature(purchase_cases(spark, sf), plan)
    return rows.select(case_number(), "pid", "pred_dt", rec_number(), "dt")


@query
def daypart_morning(spark, sf):
    return filtered(spark, sf, Filter("Morning", thresholds={}))


@query
def daypart_afternoon(spark, sf):
    return filtered(spark, sf, Filter("Afternoon", thresholds={}))


@query
def daypart_evening(spark, sf):
    return filtered(spark, sf, Filter("Evening", thresholds={}))


@query
def daypart_legacy(spark, sf):
    return filtered(spark, sf, Filter("Evening", thresholds={}, legacy_dayparts=True))


@query
def custom_predicate(spark, sf):
    weekend = {"Weekend": lambda dt: F.dayofweek(dt).isin(1, 7)}
    return filtered(spark, sf, Filter("Weekend", thresholds={}, predicates=weekend))


@query
def value_predicate(spark, sf):
    """A condition on a record's value, then whole days of such records."""
    high = Filter("High", thresholds={"DTInD": 2}, predicates={"High": F.col("value") > 25})
    plan = Feature(BF7D, event_source(spark, sf, "value"), high)
    rows = build_feature(purchase_cases(spark, sf), plan)
    return rows.select(case_number(), "pid", "pred_dt", rec_number(), "dt")


@query
def threshold_dtind(spark, sf):
    return filtered(spark, sf, FULL_DAYS)


@query
def threshold_chain(spark, sf):
    return filtered(spark, sf, Filter(thresholds={"DTInD": 2, "RInDT": 0, "DInCP": 4}))


@query
def threshold_cascade(spark, sf):
    """Four rules on times, settled in one pass."""
    return filtered(spark, sf, Filter(thresholds={"DTInH": 2, "HInD": 2, "5MinInW": 8, "DInCP": 2}))


@query
def threshold_share(spark, sf):
    return filtered(spark, sf, Filter("Night", thresholds={"HInD": 8}))


# -- tokens -------------------------------------------------------------------


def record_tokens(spark, sf, tokens: Tokens) -> DataFrame:
    records = attach_tokens(load_records(event_source(spark, sf, "event_type", "value")), tokens)
    long = records.select(rec_number(), F.posexplode(F.arrays_zip("tkn_key", "tkn_wgt")).alias("pos", "t"))
    return long.select(
        "rec_id", F.col("pos").cast("bigint").alias("pos"),
        F.col("t.tkn_key").alias("token"), F.col("t.tkn_wgt").alias("weight"),
    )


@query
def calendar_tokens(spark, sf):
    return record_tokens(spark, sf, Tokens("Cal", calendar="RDTCal"))


@query
def grain_tokens(spark, sf):
    """Two stored grain tables; only purchases are in the second."""
    events = table(spark, sf, "events")
    ids = [F.col("user_id").cast("string").alias("pid"), F.col("event_id").cast("string").alias("rec_id")]
    types = events.select(
        *ids, F.array("event_type").alias("EventGrn_key"), F.array(F.lit(1.0)).alias("EventGrn_wgt")
    )
    amounts = events.where(F.col("event_type") == "purchase").select(
        *ids, F.array(value_token()).alias("AmountGrn_key"), F.array("value").alias("AmountGrn_wgt")
    )
    tokens = Tokens("Stored", [GrainTable("EventGrn", types), GrainTable("AmountGrn", amounts)])
    return record_tokens(spark, sf, tokens)


@query
def grain_suffix_lists(spark, sf):
    """A stored grain with its own group and place lists, beside one without."""
    events = table(spark, sf, "events")
    ids = [F.col("user_id").cast("string").alias("pid"), F.col("event_id").cast("string").alias("rec_id")]
    stored = events.where(F.col("event_type") != "view").select(
        *ids,
        F.array("event_type", value_token()).alias("Pair_key"),
        F.array(F.lit(1.0), F.col("value")).alias("Pair_wgt"),
        F.array(F.lit("Type"), F.lit("Amount")).alias("Pair_rfg"),
        F.array(F.lit(0), F.col("event_id") % 3).alias("Pair_keyInrfg"),
    )
    tokens = Tokens("Lists", [GrainTable("Pair", stored), daypart_grain()])
    records = attach_tokens(load_records(event_source(spark, sf)), tokens)
    lists = F.arrays_zip("tkn_key", "tkn_wgt", "tkn_rfg", "tkn_keyInrfg")
    long = records.select(rec_number(), F.posexplode(lists).alias("pos", "t"))
    return long.select(
        "rec_id", F.col("pos").cast("bigint").alias("pos"), F.col("t.tkn_key").alias("token"),
        F.col("t.tkn_wgt").alias("weight"), F.col("t.tkn_rfg").alias("rfg"), F.col("t.tkn_keyInrfg").alias("in_rfg"),
    )


@query
def concat_tokens(spark, sf):
    return record_tokens(spark, sf, Tokens("All", [event_grain(), value_grain(True)], calendar="RDTCal"))


@query
def n2c_tokens(spark, sf):
    token = number_to_token("value", F.col("value"), 1)
    return table(spark, sf, "events").select("event_id", token.alias("token"))


@query
def token_rows_with_unk(spark, sf):
    tokens = Tokens("Short", [event_grain(), daypart_grain()])
    plan = Feature(BF24H, event_source(spark, sf, "event_type"), WHOLE, tokens)
    rows = build_feature(purchase_cases(spark, sf), plan)
    return rows.select(
        case_number(), "pid", *rel_columns(), "dt", "R",
        F.array_join("tkn_key", ",").alias("tokens"), thousandths("tkn_wgt").alias("weights"),
    )


@query
def one_tkn_in_5min(spark, sf):
    cases = purchase_cases(spark, sf)
    records = load_records(event_source(spark, sf, "value"))
    records = records.withColumn("token", number_to_token("value", F.col("value"), 1))
    rows = add_relative_time(observe(cases, records, BF24H))
    dense = one_token_per_slot(cases, rows, F.col("token"), BF24H, F.lit("UNK"))
    return dense.select(case_number(), F.array_join("tkn", ",").alias("tkn"))


@query
def one_tkn_in_5min_tknidx(spark, sf):
    cases = purchase_cases(spark, sf)
    vocab = stored_vocab(spark, sf, "value", lambda: [value_vocab(spark, sf)])
    records = load_records(event_source(spark, sf, "value")).withColumn("grn", value_token())
    records = vocab.lookup(records, "grn").select("pid", "rec_id", "dt", "idx")
    rows = add_relative_time(observe(cases, records, AF2H))
    dense = one_token_per_slot(cases, rows, F.col("idx"), AF2H, F.lit(0))
    return dense.select(case_number(), joined("tkn").alias("tknidx"))


# -- vocabularies ---------------------------------------------------------------


def vocab_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("idx").cast("bigint").alias("idx"), "grn", "rfg", F.col("rfg_idx").cast("bigint").alias("rfg_idx")
    )


@query
def vocab_build(spark, sf):
    return vocab_columns(vocab_rows(full_tables(spark, sf)))


@query
def vocab_stored(spark, sf):
    """A vocabulary as it is read from its files, JSON text included."""
    path = scratch_folder(spark, "vocabulary")
    full_tokens(spark, sf).vocab.write(path, "json")
    return vocab_columns(Vocabulary.read(spark, path, form="json").df)


@query
def vocab_extend(spark, sf):
    vocab = short_tokens(spark, sf).vocab
    return vocab_columns(extend_vocab(vocab.df, vocab.size, ["5MinInD", "DInCP"]))


@query
def vocab_learn(spark, sf):
    """Distinct tokens of every grain, seen in the case windows."""
    tokens = Tokens("All", [event_grain(), value_grain()], calendar="RDTCal")
    records = attach_tokens(load_records(event_source(spark, sf, "event_type", "value")), tokens)
    rows = observe(purchase_cases(spark, sf), records, BF24H)
    return learn_vocab(rows, F.col("tkn_key"), "All")


@query
def vocab_conflict_report(spark, sf):
    """Event types and order priorities under shared grain names."""
    events, orders = table(spark, sf, "events"), table(spark, sf, "orders")
    by_type = learn_vocab(events, F.array("event_type"), "TypeGrn")
    merged = learn_vocab(events, F.array("event_type", value_token()), "MergedGrn")
    priority = learn_vocab(orders, F.array("o_orderpriority"), "PriorityGrn")
    found = vocab_conflicts([by_type, merged, priority])
    return found.select("grn", F.array_join("rfgs", ",").alias("rfgs"))


# -- compress -------------------------------------------------------------------


@query
def compress_mean_day(spark, sf):
    feature = event_feature(spark, sf, [rolled("5MinInD", "mean")], focal_layers=["CP", "D"])
    return long_rows(purchase_cases(spark, sf), feature, ["D"])


@query
def compress_sum_hour(spark, sf):
    feature = event_feature(
        spark, sf, [rolled("5MinInH", "sum")], tokens=full_tokens(spark, sf, weighted=True),
        focal_layers=["CP", "H"],
    )
    return long_rows(purchase_cases(spark, sf), feature, ["H"])


@query
def compress_two_level(spark, sf):
    steps = [rolled("5MinInD", "mean"), rolled("DInCP", "mean")]
    feature = event_feature(spark, sf, steps, tokens=full_tokens(spark, sf))
    return long_rows(purchase_cases(spark, sf), feature, [])


@query
def compress_flat_chain(spark, sf):
    """Hour sums, then week means, without listing in between; no filter."""
    steps = [
        Step("5MinInH", [("flatten",), ("method", "sum")]),
        Step("HInW", [("method", "mean"), ("convert",)]),
    ]
    feature = event_feature(spark, sf, steps, flt=WHOLE, focal_layers=["CP", "W"])
    return long_rows(purchase_cases(spark, sf), feature, ["W"])


@query
def compress_cat(spark, sf):
    """Records of a day as one list, in time order."""
    steps = [Step("5MinInD", [("method", "cat")])]
    feature = event_feature(spark, sf, steps, focal_layers=["CP", "D"])
    state, vocab = compressed(purchase_cases(spark, sf), feature)
    long = cmp.decoded(state, vocab)
    return long.select(
        case_number(), *rel_columns(["D"]), F.col("5MinInD").alias("n_rows"),
        F.col("pos").cast("bigint").alias("pos"), "token", "weight",
    )


@query
def compress_cat_rows(spark, sf):
    """The same entries as rows with their places, for any window size."""
    steps = [Step("5MinInD", [("method", "cat")])]
    feature = event_feature(spark, sf, steps, focal_layers=["CP", "D"])
    state, vocab = token_state(purchase_cases(spark, sf), feature)
    long = vocab.lookup(cmp.concatenated_rows(state, "5MinInD"), "idx", by="idx")
    return long.select(case_number(), *rel_columns(["D"]), "pos", F.col("grn").alias("token"), "weight")


@query
def compress_cat_flat(spark, sf):
    """``cat`` on flat tokens: weights add up, unrounded."""
    feature = event_feature(spark, sf, [rolled("5MinInD", "cat")], focal_layers=["CP", "D"])
    return long_rows(purchase_cases(spark, sf), feature, ["D"])


@query
def compress_unknown(spark, sf):
    """Tokens outside the vocabulary turn into the unknown one, flat or not."""
    known = table(spark, sf, "events").where(F.col("event_type") != "view")
    tables = [learn_vocab(known, F.array("event_type"), "EventGrn"), daypart_vocab(spark, sf)]
    vocab = stored_vocab(spark, sf, "known", lambda: tables)
    tokens = replace(short_tokens(spark, sf), vocab=vocab, on_unknown="unk")
    feature = event_feature(spark, sf, [rolled("5MinInD", "mean")], tokens=tokens, focal_layers=["CP", "D"])
    return long_rows(purchase_cases(spark, sf), feature, ["D"])


def doubled_source(spark, sf) -> RecordSource:
    """Every event twice under one id and time, the second time as a view of
    value 1: rows that only their tokens tell apart."""
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    again = events.withColumns({"event_type": F.lit("view"), "value": F.lit(1.0)})
    return RecordSource("Twice", events.unionByName(again), "user_id", "event_id", "ts", ["event_type", "value"])


def of_doubled(spark, sf, tokens: Tokens) -> DataFrame:
    feature = event_feature(
        spark, sf, [rolled("5MinInD", "mean")], flt=WHOLE, tokens=tokens, source=doubled_source(spark, sf),
        focal_layers=["CP", "D"],
    )
    return long_rows(purchase_cases(spark, sf), feature, ["D"])


@query
def repeated_records_single(spark, sf):
    return of_doubled(spark, sf, short_tokens(spark, sf))


@query
def repeated_records_array(spark, sf):
    """The same from list-valued grains: no row is merged with another."""
    grains = [
        GrainColumn("EventGrn", lambda: F.array("event_type")),
        GrainColumn("MEANGrn", lambda: F.array(daypart_token())),
    ]
    return of_doubled(spark, sf, replace(short_tokens(spark, sf), grains=grains))


@query
def compress_later_years(spark, sf):
    """Events three years on: the calendar follows the data."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts") + F.expr("INTERVAL 3 YEARS"))
    years = calendar_years(events, "ts")
    vocab = stored_vocab(spark, sf, "later", lambda: [event_vocab(spark, sf), calendar_vocab(spark, *years)])
    tokens = Tokens("Later", [event_grain()], calendar="RDTCal", vocab=vocab)
    source = RecordSource("Events", events, "user_id", "event_id", "ts", ["event_type"])
    records = load_records(replace(source, df=events.where(F.col("event_type") == "purchase")))
    cases = case_sets.trigger_cases(records, F.col("rec_id").cast("bigint"))
    feature = event_feature(
        spark, sf, [rolled("5MinInD", "mean")], tokens=tokens, source=source, focal_layers=["CP", "D"]
    )
    return long_rows(cases, feature, ["D"])


@query
def compress_crowded_entity(spark, sf):
    """All events as one entity's, every purchase a case."""
    events = table(spark, sf, "events").withColumn("everyone", F.lit("all"))
    source = RecordSource("Events", events, "everyone", "event_id", "ts", ["event_type", "value"])
    records = load_records(replace(source, df=events.where(F.col("event_type") == "purchase")))
    cases = case_sets.trigger_cases(records, F.col("rec_id").cast("bigint"))
    feature = event_feature(
        spark, sf, [rolled("5MinInD", "sum")], period=BF24H, flt=WHOLE, source=source, focal_layers=["CP", "D"]
    )
    return long_rows(cases, feature, ["D"])


# -- record ids that repeat from entity to entity ---------------------------------


def numbered_source(spark, sf, triggers: bool = False) -> RecordSource:
    """Events numbered from 1 inside each entity."""
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    events = table(spark, sf, "events").withColumn("number", number)
    events = events.where(F.col("event_type") == "purchase") if triggers else events
    return RecordSource("Numbered", events, "user_id", "number", "ts", ["event_type", "value"])


def numbered_cases(spark, sf) -> DataFrame:
    records = load_records(numbered_source(spark, sf, triggers=True))
    return case_sets.trigger_cases(records, F.col("rec_id").cast("bigint"))


@query
def local_ids_cases(spark, sf):
    return numbered_cases(spark, sf).select(case_number(), "pid", "pred_dt")


@query
def local_ids_recnum(spark, sf):
    counts = record_count(numbered_cases(spark, sf), load_records(numbered_source(spark, sf)), BF24H)
    return counts.select(case_number(), "pid", "pred_dt", "rec_num")


@query
def local_ids_feature(spark, sf):
    feature = event_feature(
        spark, sf, [rolled("5MinInD", "mean")], source=numbered_source(spark, sf), focal_layers=["CP", "D"]
    )
    return long_rows(numbered_cases(spark, sf), feature, ["D"], "pid", "pred_dt")


@query
def local_ids_store(spark, sf):
    """Half of the entities are stored: cases of the others are misses."""
    cases, store = numbered_cases(spark, sf), new_store(spark)
    feature = Feature(BF24H, numbered_source(spark, sf), WHOLE)
    store.compute_missing(feature, cases.where(F.col("pid").cast("bigint") % 2 == 0))
    return store.status(feature, cases).select(
        case_number(), "pid", "pred_dt", F.coalesce(F.col("nrow"), F.lit(-1)).cast("bigint").alias("nrow"), "status"
    )


@query
def local_ids_downsample(spark, sf):
    return case_sets.downsample(numbered_cases(spark, sf), 0.1).select(case_number(), "pid", "pred_dt")


@query
def local_ids_split(spark, sf):
    split = case_sets.split_cases(numbered_cases(spark, sf), out=0.1, test=0.1, valid=0.1)
    return split.select(case_number(), "pid", "pred_dt", "split")


@query
def local_ids_batches(spark, sf):
    rows = in_batches(numbered_cases(spark, sf), 500).select("batch", F.explode("rows").alias("r"))
    return rows.select(
        "batch", F.col("r.row_no").cast("bigint").alias("row_no"), F.col("r.case_id").cast("bigint").alias("case_id"),
        F.col("r.pid").alias("pid"), F.col("r.pred_dt").alias("pred_dt"),
    )


# -- as-of matches and functions of several observations -------------------------


def last_and_first(spark, sf) -> DataFrame:
    """The last record of the week before a case and the first of the day after."""
    wanted = {"before": Nearest(BF7D), "after": Nearest(AFTER_TRIGGER["Af24H"], "first")}
    records = load_records(event_source(spark, sf, "value"))
    return nearest_records(purchase_cases(spark, sf), records, wanted, ["value"])


@query
def nearest_values(spark, sf):
    return last_and_first(spark, sf).select(
        case_number(), "pid", "pred_dt", F.col("before.dt").alias("before_dt"), F.col("before.value").alias("before_value"),
        F.col("after.dt").alias("after_dt"), F.col("after.value").alias("after_value"),
    )


@query
def case_function_change(spark, sf):
    """A case function of three observations and an attribute of the entity."""
    cases = purchase_cases(spark, sf)
    counts = record_count(cases, load_records(event_source(spark, sf)), BF24H)
    balance = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("pid"), "c_acctbal")

    def change(near, counts, entity):
        after, before = near["after"]["value"], near["before"]["value"]
        return {
            "change": after - before,
            "n_before": F.coalesce(counts["rec_num"], F.lit(0)),
            "relative": after / (1 + F.abs(entity["c_acctbal"])),
        }

    observed = {"near": last_and_first(spark, sf), "counts": counts, "entity": balance}
    rows = case_function(cases, observed, change)
    return rows.select(case_number(), "pid", "pred_dt", "change", "n_before", "relative")


@query
def observe_windows(spark, sf):
    """Four windows, two overlapping and one far off, in one join."""
    periods = [BF7D, BF24H, AF2H, CheckPeriod("eleventh day", 240, 264)]
    rows = windows_of(purchase_cases(spark, sf).select(*CASE_KEY), load_records(event_source(spark, sf)), periods)
    return rows.select(case_number(), "pid", "pred_dt", F.col("rec_id").cast("bigint").alias("rec_id"), "dt", "windows")


@query
def compress_custom_max(spark, sf):
    highest = cmp.Method(
        F.max,
        lambda value, present, rows: F.when(present < rows, F.greatest(value, F.lit(0.0))).otherwise(value),
    )
    steps = [rolled("5MinInD", "max")]
    feature = event_feature(
        spark, sf, steps, tokens=full_tokens(spark, sf, weighted=True), methods={"max": highest},
        focal_layers=["CP", "D"],
    )
    return long_rows(purchase_cases(spark, sf), feature, ["D"])


def compress_quantile(spark, sf, q: float) -> DataFrame:
    feature = event_feature(
        spark, sf, [rolled("5MinInD", "quantile")], tokens=full_tokens(spark, sf, weighted=True),
        methods={"quantile": cmp.quantile(q)}, focal_layers=["CP", "D"],
    )
    return long_rows(purchase_cases(spark, sf), feature, ["D"])


@query
def compress_custom_median(spark, sf):
    """Median weight per day, absent zeros included."""
    return compress_quantile(spark, sf, 0.5)


@query
def compress_custom_quantile(spark, sf):
    return compress_quantile(spark, sf, 0.9)


@query
def flatten_wide(spark, sf):
    feature = event_feature(spark, sf, [rolled("5MinInD", "mean")], focal_layers=["CP", "D"])
    state, vocab = compressed(purchase_cases(spark, sf), feature)
    names = ["UNK", "click", "error", "purchase", "signup", "view", "MEAN-Night", "5MinInD"]
    wide = cmp.wide(state, vocab, names)
    columns = [F.col(f"`{n}`").alias(n.lower().replace("-", "_").replace("5minind", "n_rows")) for n in names]
    return wide.select(case_number(), *rel_columns(["D"]), *columns)


@query
def flatten_wide_all(spark, sf):
    """One column per token of the whole vocabulary."""
    feature = event_feature(spark, sf, [rolled("5MinInD", "mean")], focal_layers=["CP", "D"])
    state, vocab = compressed(purchase_cases(spark, sf), feature)
    rows = cmp.wide(state, vocab)
    names = [c for c in rows.columns if c not in (*CASE_KEY, *LEVELS)]
    columns = [F.col(f"`{n}`").alias(n.lower().replace("-", "_").replace("5minind", "n_rows")) for n in names]
    return rows.select(case_number(), *rel_columns(["D"]), *columns)


@query
def relist_tokens(spark, sf):
    feature = event_feature(spark, sf, [rolled("5MinInD", "mean")], focal_layers=["CP", "D"])
    state, vocab = compressed(purchase_cases(spark, sf), feature)
    entry = F.struct("pos", "token", "weight")
    lists = (
        cmp.decoded(state, vocab)
        .groupBy("case_id", "D")
        .agg(F.sort_array(F.collect_list(entry)).alias("e"))
    )
    return lists.select(
        case_number(), *rel_columns(["D"]),
        F.array_join(F.transform("e", lambda e: e["token"]), ",").alias("keys"),
        thousandths(F.transform("e", lambda e: e["weight"])).alias("weights"),
    )


def with_suffixes(spark, sf, sfx, rule="5MinInD", layers=("CP", "D")) -> DataFrame:
    feature = event_feature(
        spark, sf, [rolled(rule, "mean", sfx)], tokens=full_tokens(spark, sf), focal_layers=list(layers)
    )
    return build_feature(purchase_cases(spark, sf), feature)


@query
def suffix_rfg(spark, sf):
    rows = with_suffixes(spark, sf, ["rfg"])
    return rows.select(case_number(), *rel_columns(["D"]), joined("rfgidx").alias("rfgidx"))


@query
def suffix_key_in_rfg(spark, sf):
    rows = with_suffixes(spark, sf, ["rfg", "keyInrfg"])
    return rows.select(case_number(), *rel_columns(["D"]), joined("keyInrfg").alias("key_in_rfg"))


@query
def suffix_d_in_cp(spark, sf):
    rows = with_suffixes(spark, sf, ["DInCP"])
    return rows.select(case_number(), *rel_columns(["D"]), joined("DInCP").alias("d_in_cp"))


@query
def suffix_h_in_d(spark, sf):
    rows = with_suffixes(spark, sf, ["HInD"], rule="5MinInH", layers=("CP", "D", "H"))
    return rows.select(case_number(), *rel_columns(["D", "H"]), joined("HInD").alias("h_in_d"))


@query
def encode_ids(spark, sf):
    rows = with_suffixes(spark, sf, ["rfg"])
    return rows.select(
        case_number(), "pid", "pred_dt", *rel_columns(["D"]),
        joined("keyidx").alias("keyidx"), thousandths("wgt").alias("wgt"), joined("rfgidx").alias("rfgidx"),
    )


@query
def nested_layers(spark, sf):
    feature = event_feature(
        spark, sf, [rolled("5MinInH", "mean")], prefix_layers=["CP", "D"], focal_layers=["H"]
    )
    rows = build_feature(purchase_cases(spark, sf), feature)

    def brackets(nested, inner):
        return F.concat(F.lit("["), F.array_join(F.transform(nested, inner), ";"), F.lit("]"))

    text = brackets(F.col("keyidx"), lambda day: brackets(day, joined))
    wgt = brackets(F.col("wgt"), lambda day: brackets(day, thousandths))
    return rows.select(case_number(), "pid", "pred_dt", text.alias("keyidx"), wgt.alias("wgt"))


# -- features side by side, store -------------------------------------------------


@query
def multi_feature(spark, sf):
    cases = purchase_cases(spark, sf)
    source = event_source(spark, sf, "event_type", "value")
    tokens = short_tokens(spark, sf)
    by_day = Feature(
        BF7D, source, FULL_DAYS, tokens,
        Compress([rolled("5MinInD", "mean")], focal_layers=["CP", "D"]), alias="days_before",
    )
    after = Feature(
        AFTER_TRIGGER["Af24H"], source, WHOLE, tokens,
        Compress([rolled("5MinInCP", "sum")], focal_layers=["CP"]), alias="after",
    )
    records = Feature(BF24H, source, Filter("Morning", thresholds={}), alias="mornings")
    rows = build_features(cases, [by_day, after, records])

    def rows_text(name, per_row):
        return F.coalesce(F.array_join(F.transform(name, per_row), ";"), F.lit(""))

    def day_text(r):
        return F.concat(r["D"].cast("string"), F.lit(":"), joined(r["keyidx"]), F.lit(":"), thousandths(r["wgt"]))

    return rows.select(
        case_number(), "pid", "pred_dt",
        rows_text("days_before", day_text).alias("days_before"),
        rows_text("after", lambda r: F.concat(joined(r["keyidx"]), F.lit(":"), thousandths(r["wgt"]))).alias("after"),
        rows_text("mornings", lambda r: r["rec_id"]).alias("mornings"),
    )


def stored_feature(spark, sf) -> Feature:
    return event_feature(spark, sf, [rolled("5MinInD", "mean")], focal_layers=["CP", "D"])


def new_store(spark) -> FeatureStore:
    return FeatureStore(spark, scratch_folder(with_default_folder(spark), "store"), groups=8)


def early(cases: DataFrame) -> DataFrame:
    """The cases known at a first run; later ones arrive afterwards."""
    return cases.where(F.col("pred_dt") < F.lit("2024-01-16").cast("timestamp_ntz"))


@query
def store_incremental(spark, sf):
    cases, feature, store = purchase_cases(spark, sf), stored_feature(spark, sf), new_store(spark)
    store.compute_missing(feature, early(cases))
    rows = store.compute_missing(feature, cases)
    return rows.select(
        case_number(), "pid", "pred_dt", *rel_columns(["D"]),
        joined("keyidx").alias("keyidx"), thousandths("wgt").alias("wgt"),
    )


def stored_rows(rows) -> DataFrame:
    return rows.select(
        case_number(), "pid", "pred_dt", *rel_columns(["D"]),
        joined("keyidx").alias("keyidx"), thousandths("wgt").alias("wgt"),
    )


@query
def store_grown_vocabulary(spark, sf):
    """A first run with a vocabulary of two event types, a second one with
    all: nothing of the first is taken over."""
    cases, store = purchase_cases(spark, sf), new_store(spark)
    few = table(spark, sf, "events").where(F.col("event_type").isin("purchase", "view"))
    tables = [learn_vocab(few, F.array("event_type"), "EventGrn"), daypart_vocab(spark, sf)]
    feature = stored_feature(spark, sf)
    tokens = replace(feature.tokens, vocab=build_vocab(tables), on_unknown="drop")
    store.compute_missing(replace(feature, tokens=tokens), cases)
    tokens = replace(feature.tokens, on_unknown="drop")
    return stored_rows(store.compute_missing(replace(feature, tokens=tokens), cases))


@query
def store_other_groups(spark, sf):
    """Written in 8 storage groups, reopened with 3, continued, read."""
    cases, feature, store = purchase_cases(spark, sf), stored_feature(spark, sf), new_store(spark)
    store.compute_missing(feature, early(cases))
    store.groups = 3
    return stored_rows(store.compute_missing(feature, cases))


@query
def store_raced(spark, sf):
    """Two runs that both took every case for missing."""
    cases, feature, store = purchase_cases(spark, sf), stored_feature(spark, sf), new_store(spark)
    for _ in range(2):
        store.commit(feature, store.prepare(feature, cases, build_feature(cases, feature)))
    return stored_rows(store.read(feature, cases))


@query
def store_compacted(spark, sf):
    """Two runs, rewritten as one; the old ones are deleted."""
    cases, feature, store = purchase_cases(spark, sf), stored_feature(spark, sf), new_store(spark)
    store.compute_missing(feature, early(cases))
    store.compute_missing(feature, cases)
    store.compact(feature, cases)
    return stored_rows(store.read(feature, cases))


@query
def store_compacted_meanwhile(spark, sf):
    """Compacted after another writer's rows are written and before they are
    committed; half of its cases have been stored by a third one by then."""
    cases, feature, store = purchase_cases(spark, sf), stored_feature(spark, sf), new_store(spark)
    feature = store.settled(feature)
    late = cases.where(F.col("pred_dt") >= F.lit("2024-01-16").cast("timestamp_ntz"))
    store.compute_missing(feature, early(cases))
    pending = store.prepare(feature, late, build_feature(late, feature))
    store.compute_missing(feature, late.where(F.xxhash64("pid") % 2 == 0))
    store.compact(feature, cases, grace_hours=1)
    store.commit(feature, pending)
    return stored_rows(store.read(feature, cases))


@query
def store_lookup(spark, sf):
    """The last ten cases, by their folders and entities, from two runs."""
    cases, feature, store = purchase_cases(spark, sf), stored_feature(spark, sf), new_store(spark)
    feature = store.settled(feature)
    store.compute_missing(feature, early(cases))
    store.compute_missing(feature, cases)
    last = cases.orderBy(case_number().desc()).limit(10)
    return stored_rows(store.lookup(feature, last))


@query
def store_size(spark, sf):
    """Stored cases and rows after a first run."""
    cases, store = purchase_cases(spark, sf), new_store(spark)
    feature = Feature(BF24H, event_source(spark, sf), WHOLE)
    store.compute_missing(feature, early(cases))
    return store.size(feature, cases)


@query
def store_stage_reuse(spark, sf):
    """Compressed from stored token rows, not from the records."""
    cases, feature, store = purchase_cases(spark, sf), stored_feature(spark, sf), new_store(spark)
    stage = replace(feature, compress=None)
    store.compute_missing(stage, early(cases))
    return stored_rows(store.compute_missing(feature, cases, stage=stage))


@query
def store_from_observation(spark, sf):
    """From stored observations, kept by an earlier feature with another
    filter; nothing is observed again."""
    cases, feature, store = purchase_cases(spark, sf), stored_feature(spark, sf), new_store(spark)
    other = replace(feature, filter=Filter("Morning", thresholds={}), tokens=None, compress=None)
    store.through(other, cases, keep=["observation"])
    return stored_rows(store.through(feature, cases))


@query
def store_from_records(spark, sf):
    """From the filtered records that are stored for the early cases; the
    others are computed from the source."""
    cases, feature, store = purchase_cases(spark, sf), stored_feature(spark, sf), new_store(spark)
    store.through(replace(feature, compress=None), early(cases), keep=["records"])
    return stored_rows(store.through(feature, cases))


@query
def store_all_stages(spark, sf):
    """Every stage kept: the tokens are read for early cases only."""
    cases, feature, store = purchase_cases(spark, sf), stored_feature(spark, sf), new_store(spark)
    store.through(feature, early(cases), keep=["observation", "records", "tokens"])
    return stored_rows(store.through(feature, cases, keep=["observation"]))


@query
def store_two_sources(spark, sf):
    """Two sources of one name and form: each has rows of its own."""
    cases, store = purchase_cases(spark, sf), new_store(spark)
    source = event_source(spark, sf)
    errors = replace(source, df=source.df.where(F.col("event_type") == "error"))
    store.compute_missing(Feature(BF24H, source, WHOLE), cases)
    rows = store.compute_missing(Feature(BF24H, errors, WHOLE), cases)
    return rows.select(case_number(), "pid", "pred_dt", F.col("rec_id").cast("bigint").alias("rec_id"), "dt")


@query
def store_status(spark, sf):
    """After a first run over the early cases: hit, known empty, or miss."""
    cases, store = purchase_cases(spark, sf), new_store(spark)
    feature = Feature(BF24H, event_source(spark, sf), WHOLE)
    store.compute_missing(feature, early(cases))
    return store.status(feature, cases).select(
        case_number(), F.coalesce(F.col("nrow"), F.lit(-1)).cast("bigint").alias("nrow"), "status"
    )


@query
def store_json(spark, sf):
    """Feature rows through JSON text and back, next to their text."""
    rows = with_suffixes(spark, sf, ["rfg"]).select("case_id", "pred_dt", "D", "keyidx", "rfgidx")
    text = lists_to_json(rows)
    kept = [F.col("rfgidx").alias("rfgidx_json"), F.col("pred_dt").alias("pred_dt_text")]
    both = lists_from_json(text.select("*", *kept), rows.schema, ["rfgidx_json", "pred_dt_text"])
    return both.select(
        case_number(), *rel_columns(["D"]), "pred_dt", "pred_dt_text", joined("keyidx").alias("keyidx"), "rfgidx_json"
    )


# -- case sets --------------------------------------------------------------------


def before_and_after(spark, sf, after=AFTER_TRIGGER["Af24H"]) -> tuple[DataFrame, DataFrame]:
    cases = purchase_cases(spark, sf)
    records = load_records(event_source(spark, sf))
    return cases, record_count(cases, records, {"n_before": BF24H, "n_after": after})


@query
def case_filter_dev(spark, sf):
    """Cases with both inputs and outcomes."""
    cases, counts = before_and_after(spark, sf)
    both = (F.col("n_before") > 0) & (F.col("n_after") > 0)
    return case_sets.filter_cases(cases, counts, both).select(case_number(), "pid", "pred_dt")


@query
def case_filter_sftflt(spark, sf):
    """Cases with enough records on both sides."""
    cases, counts = before_and_after(spark, sf)
    enough = (F.col("n_before") >= 2) & (F.col("n_after") >= 3)
    return case_sets.filter_cases(cases, counts, enough).select(case_number(), "pid", "pred_dt")


@query
def downsample(spark, sf):
    kept = case_sets.downsample(purchase_cases(spark, sf), 0.1)
    return kept.select(case_number(), "pid")


def split(spark, sf) -> DataFrame:
    return case_sets.split_cases(purchase_cases(spark, sf), out=0.1, test=0.1, valid=0.1)


@query
def split_sets(spark, sf):
    return split(spark, sf).select(case_number(), "pid", "split")


def tagged(spark, sf) -> DataFrame:
    tags = case_sets.tag_column(
        {
            "C1": F.col("c_mktsegment").isin("BUILDING", "MACHINERY"),
            "t1": F.col("c_acctbal") < 0,
            "t2": F.col("c_acctbal") >= 0,
        }
    )
    entities = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("pid"), tags.alias("tags"))
    return split(spark, sf).join(entities, "pid", "left")


@query
def set_selector(spark, sf):
    return case_sets.select_set(tagged(spark, sf), "in_train:C1&t2").select(case_number(), "pid", "split")


@query
def set_selector_out_whole(spark, sf):
    return case_sets.select_set(tagged(spark, sf), "out_whole:t2").select(case_number(), "pid", "split")


@query
def batch_export(spark, sf):
    batches = in_batches(purchase_cases(spark, sf), 500)
    rows = batches.select("batch", F.posexplode("rows").alias("pos", "r"))
    return rows.select(
        "batch", F.col("pos").cast("bigint").alias("pos"), F.col("r.row_no").cast("bigint").alias("row_no"),
        F.col("r.case_id").cast("bigint").alias("case_id"), F.col("r.pred_dt").alias("pred_dt"),
    )
