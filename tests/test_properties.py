"""Same result whatever the join form, partitioning, input order or skew."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from conftest import SF_DIR
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casefeat import CheckPeriod, Compress, Feature, Filter, GrainColumn, RecordSource, Tokens
from casefeat.catalog import queries
from casefeat.config import rolled
from casefeat.functions.timing import add_relative_time, bucket
from casefeat.operators import compress as cmp
from casefeat.operators.nest import in_batches
from casefeat.operators.observe import observe, prune_records, record_count
from casefeat.operators.ranking import with_position
from casefeat.operators.vocab import build_vocab
from casefeat.plans.features import compressed

START = datetime(2024, 1, 1)


def key(df):
    return sorted(df.select("case_id", "rec_id").collect())


def frames(spark, cases, records):
    cases = [(f"c{i}", f"p{p}", START + timedelta(seconds=s)) for i, (p, s) in enumerate(cases)]
    records = [(f"p{p}", f"r{i}", START + timedelta(seconds=s)) for i, (p, s) in enumerate(records)]
    return (
        spark.createDataFrame(cases, "case_id string, pid string, pred_dt timestamp_ntz"),
        spark.createDataFrame(records, "pid string, rec_id string, dt timestamp_ntz"),
        cases,
        records,
    )


moments = st.lists(st.tuples(st.integers(0, 2), st.integers(-50_000, 50_000)), min_size=1, max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(moments, moments, st.integers(-9, 5), st.integers(1, 9), st.booleans())
def test_join_forms_agree_with_brute_force(spark, case_list, record_list, start, length, exclusive):
    period = CheckPeriod("x", start, start + length, "H", start_exclusive=exclusive)
    cases, records, case_rows, record_rows = frames(spark, case_list, record_list)
    expected = []
    for case_id, pid, at in case_rows:
        low, high = at + timedelta(hours=start), at + timedelta(hours=start + length)
        for rec_pid, rec_id, dt in record_rows:
            if rec_pid == pid and (low < dt if exclusive else low <= dt) and dt < high:
                expected.append((case_id, rec_id))
    expected.sort()
    assert key(observe(cases, records, period, how="plain")) == expected
    assert key(observe(cases, records, period)) == expected
    assert key(observe(cases, records, period, width_us=3_333_333_333)) == expected
    assert key(observe(cases, records, period, hot_cell_rows=3)) == expected
    assert key(observe(cases, prune_records(cases, records, period), period)) == expected
    counts = {r.case_id: r.rec_num for r in record_count(cases, records, period, width_us=7_777_777_777).collect()}
    assert counts == {c[0]: sum(e[0] == c[0] for e in expected) for c in case_rows}


def test_zoned_timestamps(spark):
    cases, records, _, _ = frames(spark, [(0, 100_000)], [(0, 99_000), (0, 100_000)])
    cases = cases.withColumn("pred_dt", F.col("pred_dt").cast("timestamp"))
    records = records.withColumn("dt", F.col("dt").cast("timestamp"))
    period = CheckPeriod.parse("Bf24H")
    assert key(observe(cases, records, period)) == [("c0", "r0")]
    assert key(observe(cases, prune_records(cases, records, period), period)) == [("c0", "r0")]
    assert record_count(cases, records, period).first().rec_num == 1


def test_buckets_floor(spark):
    df = spark.createDataFrame([(-1,), (0,), (9,), (10,), (1_700_000_000_000_001,)], "u bigint")
    assert [r[0] for r in df.select(bucket(F.col("u"), 10)).collect()] == [-1, 0, 0, 1, 170_000_000_000_000]


def test_positions_equal_row_numbers(spark):
    df = spark.range(1000).select(
        (F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 1000).alias("v")
    )
    placed = with_position(df, ["k"], F.expr("v div 100"), ["v"]).toPandas().sort_values(["k", "v"])
    assert (placed.groupby("k").cumcount() == placed["pos"]).all()


def test_batches_are_full_and_whole(spark):
    cases = spark.range(1003).select(F.col("id").cast("string").alias("case_id"))
    sizes = [len(r.rows) for r in in_batches(cases, 100, cells=16).orderBy("batch").collect()]
    assert sizes == [100] * 10 + [3]


def wide_brute_force(pairs, program):
    """Two-level mean on wide pandas frames, with exact half-even rounding."""
    from decimal import ROUND_HALF_EVEN, Decimal
    from fractions import Fraction

    def mean(values):
        exact = sum(map(Fraction, values), Fraction(0)) / len(values)
        cut = Decimal(exact.numerator) / Decimal(exact.denominator)
        return Fraction(cut.quantize(Decimal("0.001"), ROUND_HALF_EVEN))

    out = {}
    for case_id, rows in pairs.groupby("case_id"):
        days = []
        for _, day in rows.groupby("D"):
            names = sorted({t for toks in day["toks"] for t in toks})
            sums = {n: mean([toks.get(n, 0) for toks in day["toks"]]) for n in names}
            days.append({n: v for n, v in {**sums, "5MinInD": Fraction(len(day))}.items() if v > 0})
        names = {n for d in days for n in d}
        top = {n: mean([d.get(n, Fraction(0)) for d in days]) for n in names}
        top["DInCP"] = Fraction(len(days))
        out[case_id] = {n: float(v) for n, v in top.items() if v > 0}
    return out


def event_inputs(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    source = RecordSource("Events", events, "user_id", "event_id", "ts", ["event_type", "value"])
    cases = events.where("event_type = 'purchase'").select(
        F.col("event_id").cast("string").alias("case_id"),
        F.col("user_id").cast("string").alias("pid"),
        F.col("ts").alias("pred_dt"),
    )
    table = events.select(F.col("event_type").alias("grn")).distinct().selectExpr(
        "grn", "'T' AS rfg", "row_number() OVER (ORDER BY grn) AS pos"
    )
    tokens = Tokens("T", [GrainColumn("T", lambda: [F.col("event_type")])], vocab=build_vocab([table]))
    steps = [rolled("5MinInD", "mean"), rolled("DInCP", "mean")]
    program = Compress(steps, focal_layers=["CP"])
    return cases, Feature(CheckPeriod.parse("Bf7D"), source, Filter(thresholds={}), tokens, program)


def test_two_level_mean_equals_wide_brute_force(spark):
    cases, feature = event_inputs(spark)
    state, vocab = compressed(cases, feature)
    got = {}
    for r in cmp.decoded(state, vocab).collect():
        got.setdefault(r.case_id, {})[r.token] = r.weight
    from casefeat.sources.records import load_records

    pairs = add_relative_time(observe(cases, load_records(feature.source), feature.period)).toPandas()
    pairs["toks"] = [{t: 1} for t in pairs["event_type"]]
    expected = wide_brute_force(pairs, feature.compress)
    empty = {"UNK": 1.0, "5MinInD": 1.0, "DInCP": 1.0}
    ids = [r.case_id for r in cases.collect()]
    assert got == {c: expected.get(c, empty) for c in ids}


def long_result(cases, feature, **how):
    state, vocab = compressed(cases, feature, **how)
    return sorted(cmp.decoded(state, vocab).select("case_id", "token", "pos", "weight").collect())


def variant(feature, **changes):
    from dataclasses import replace

    return replace(feature, **changes)


def test_features_do_not_depend_on_the_join_form(spark):
    cases, feature = event_inputs(spark)
    feature = variant(feature, filter=Filter(thresholds={"DTInD": 2, "HInCP": 3}))
    base = long_result(cases, feature)
    assert base == long_result(cases, feature, how="plain")
    assert base == long_result(cases, feature, hot_cell_rows=5)
    assert base == long_result(cases, feature, width_us=40_000_000_000, partitions=13)


def test_good_buckets_as_list_or_semi_join(spark, monkeypatch):
    cases, feature = event_inputs(spark)
    feature = variant(feature, filter=Filter(thresholds={"RInH": 2, "DTInD": 3, "DInCP": 2}))
    listed = long_result(cases, feature)
    monkeypatch.setattr("casefeat.plans.features.can_be_listed", lambda target, period: False)
    assert long_result(cases, feature) == listed
    assert {r.case_id for r in listed} == {r.case_id for r in cases.collect()}


def test_few_buckets_are_listed():
    from casefeat.operators.filters import can_be_listed

    week, years = CheckPeriod.parse("Bf7D"), CheckPeriod("x", -3650, 0, "D")
    assert [can_be_listed(x, week) for x in ("CP", "D", "H", "5Min", "dt")] == [True, True, True, False, False]
    assert [can_be_listed(x, years) for x in ("CP", "M", "W", "D")] == [True, True, False, False]


def test_single_columns_and_arrays_encode_alike(spark, monkeypatch):
    cases, feature = event_inputs(spark)
    words = F.when(F.col("value") > 40, F.col("event_type"))  # null: no token
    single = GrainColumn("T", lambda: [words, F.lit("click")], lambda: [F.col("value"), F.lit(2)])
    array = GrainColumn(
        "T",
        lambda: F.array_compact(F.array(words, F.lit("click"))),
        lambda: F.when(words.isNull(), F.array(F.lit(2.0))).otherwise(F.array("value", F.lit(2.0))),
    )
    steps = [rolled("5MinInH", "sum"), rolled("HInCP", "mean")]
    results = []
    for grain in (single, array):
        tokens = Tokens("T", [grain], vocab=feature.tokens.vocab)
        results.append(long_result(cases, variant(feature, tokens=tokens, compress=Compress(steps))))
    monkeypatch.setattr("casefeat.operators.tokens.MAX_BROADCAST_TOKENS", 0)
    tokens = Tokens("T", [single], vocab=feature.tokens.vocab)
    results.append(long_result(cases, variant(feature, tokens=tokens, compress=Compress(steps))))
    assert results[0] == results[1] == results[2]


def test_left_join_by_parts(spark):
    from casefeat.operators.joins import keep_all_left

    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, l string")
    right = spark.createDataFrame([(1, "x")] * 4 + [(3, "y"), (9, "z")], "k int, r string")
    expected = sorted(map(str, left.join(right, "k", "left").collect()))
    assert sorted(map(str, keep_all_left(left, right, ["k"]).collect())) == expected


def test_partitioning_and_input_order_do_not_matter(spark):
    cases, feature = event_inputs(spark)

    def result():
        state, vocab = compressed(cases, feature)
        return sorted(cmp.decoded(state, vocab).select("case_id", "token", "pos", "weight").collect())

    base = result()
    shuffled = feature.source.df.orderBy(F.md5(F.col("event_id").cast("string"))).repartition(7)
    feature = Feature(
        feature.period, RecordSource("Events", shuffled, "user_id", "event_id", "ts", ["event_type"]),
        feature.filter, feature.tokens, feature.compress,
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert result() == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_entity_with_most_records(spark):
    """A crowded entity: every form gives the whole result."""
    n = 3000
    records = spark.range(n).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("pid"),
        F.col("id").cast("string").alias("rec_id"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 20)").alias("dt"),
    )
    cases = records.where("rec_id % 40 = 0").select(
        F.col("rec_id").alias("case_id"), "pid", F.col("dt").alias("pred_dt")
    )
    period = CheckPeriod.parse("Bf6H")
    plain = key(observe(cases, records, period, how="plain"))
    assert len(plain) > 10_000
    assert key(observe(cases, records, period, hot_cell_rows=50)) == plain
    counts = {r.case_id: r.rec_num for r in record_count(cases, records, period, width_us=3_600_000_000).collect()}
    expected = pd.Series([c for c, _ in plain]).value_counts()
    assert counts == {r.case_id: int(expected.get(r.case_id, 0)) for r in cases.collect()}


PLANS = [
    "compress_mean_day", "compress_two_level", "compress_cat", "encode_ids", "nested_layers",
    "multi_feature", "threshold_chain", "recnum_before", "observe_before_24h", "token_rows_with_unk",
    "one_tkn_in_5min", "records_per_entity", "batch_export", "split_sets",
]


@pytest.mark.parametrize("name", PLANS)
def test_plans_stay_in_the_engine(spark, name):
    plan = queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{bad} in {name}"


def test_scans_read_only_needed_columns(spark):
    plan = queries()["recnum_before"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "value" not in plan
    plan = queries()["trigger_cases"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in plan


def test_later_steps_do_not_shuffle(spark):
    """Two roll-ups need no more exchanges than one."""
    cases, feature = event_inputs(spark)

    def exchanges(steps, layer):
        program = Compress(steps, focal_layers=["CP", layer])
        plan = Feature(feature.period, feature.source, feature.filter, feature.tokens, program)
        state, _ = compressed(cases, plan)
        return state.rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    one = exchanges(feature.compress.steps[:1], "D")
    assert exchanges(feature.compress.steps, "CP") == one


def test_time_pruning_reaches_the_scan(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    records = events.selectExpr("cast(user_id as string) AS pid", "event_id AS rec_id", "ts AS dt")
    cases = spark.createDataFrame([("c", "1", START + timedelta(days=3))], "case_id string, pid string, pred_dt timestamp_ntz")
    pruned = prune_records(cases, records, CheckPeriod.parse("Bf24H"))
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-03T00:00" in plan
