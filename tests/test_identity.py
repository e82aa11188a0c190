"""Cases by entity and time, rows that stay rows, a store that cannot lie."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from casefeat import CheckPeriod, Compress, Feature, Filter, GrainColumn, GrainTable, RecordSource, Tokens
from casefeat import build_feature, build_features
from casefeat.catalog import queries
from casefeat.config import rolled
from casefeat.functions.hashing import entity_group
from casefeat.operators import compress as cmp
from casefeat.operators.cases import trigger_cases
from casefeat.operators.observe import observe, record_count
from casefeat.operators.ranking import with_rank
from casefeat.operators.tokens import attach_tokens, encode_tokens, one_token_per_slot, slot_range
from casefeat.operators.vocab import build_vocab, calendar_vocab, calendar_years
from casefeat.plans.features import compressed
from casefeat.session import shared_folder
from casefeat.sources.chain import id_chain
from casefeat.sources.records import load_records
from casefeat.sources.store import FeatureStore

BF24 = CheckPeriod.parse("Bf24H")
START = datetime(2024, 1, 1)
WHOLE = Filter(thresholds={})


@pytest.fixture
def twins(spark):
    """Two entities whose records carry the same ids."""
    rows = [(p, str(i), START + timedelta(hours=i + (p == "p2")), "ab"[i % 2]) for p in ("p1", "p2") for i in range(1, 4)]
    records = spark.createDataFrame(rows, "pid string, rec_id string, DT_s timestamp_ntz, token string")
    source = RecordSource("Rec", records)
    return source, trigger_cases(load_records(source))


def mean_by_day(source, tokens):
    return Feature(BF24, source, WHOLE, tokens, Compress([rolled("5MinInD", "mean")], focal_layers=["CP", "D"]))


@pytest.fixture
def plan(source, tokens):
    return mean_by_day(source, tokens)


@pytest.fixture
def store(spark, tmp_path):
    return FeatureStore(spark, str(tmp_path / "store"), groups=2)


def content(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_ids_that_repeat_between_entities(twins, tokens):
    source, cases = twins
    assert cases.count() == 6 and cases.select("case_id").distinct().count() == 3
    counts = {(r.case_id, r.pid): r.rec_num for r in record_count(cases, load_records(source), BF24).collect()}
    assert counts == {(str(i), p): i - 1 for i in range(1, 4) for p in ("p1", "p2")}
    rows = build_feature(cases, mean_by_day(source, tokens)).collect()
    count = {(r.case_id, r.pid): r.wgt[-1] for r in rows}
    assert count == {(str(i), p): max(i - 1, 1) for i in range(1, 4) for p in ("p1", "p2")}


def test_store_knows_entities_apart(twins, store):
    source, cases = twins
    plain = Feature(BF24, source, WHOLE)
    store.compute_missing(plain, cases.where("pid = 'p1'"))
    status = {(r.case_id, r.pid): r.status for r in store.status(plain, cases).collect()}
    assert {p: {s for (_, q), s in status.items() if q == p} for p in ("p1", "p2")} == {"p1": {"empty", "hit"}, "p2": {"miss"}}


def test_a_renamed_case_is_still_known(cases, plan, store):
    store.compute_missing(plan, cases)
    renamed = cases.withColumn("case_id", F.concat(F.lit("new-"), "case_id"))
    assert {r.status for r in store.status(plan, renamed).collect()} == {"hit"}
    assert {r.case_id for r in store.read(plan, renamed).collect()} == {"new-c1", "new-c2"}


@pytest.mark.parametrize("groups", [1, 5, 64])
def test_reopened_with_other_groups(spark, cases, plan, store, groups):
    rows = store.compute_missing(plan, cases)
    again = FeatureStore(spark, store.path.split("/group=")[0], groups=groups)
    assert content(again.read(plan, cases)) == content(rows)


def test_raced_runs_count_once(cases, plan, store):
    rows = build_feature(cases, plan)
    for _ in range(3):
        store.commit(plan, store.prepare(plan, cases, rows))
    assert content(store.read(plan, cases)) == content(rows)
    assert store.size(plan, cases).first() == (2, 3) and store.status(plan, cases).count() == 2


def test_compaction(spark, cases, plan, store):
    assert store.compact(plan, cases) is None
    store.compute_missing(plan, cases.where("case_id = 'c1'"))
    rows = store.compute_missing(plan, cases)
    build_feature(cases, plan).withColumn("grp", F.lit(0)).write.partitionBy("grp").parquet(
        f"{store._folder('rows', plan)}/run=rlost"
    )
    want = content(rows)
    first = store.compact(plan, cases, grace_hours=0)
    assert {*store._folders("rows", plan)} == {*store._folders("manifest", plan)} == {first}
    assert content(store.read(plan, cases)) == want
    assert store.compact(plan, cases) != first and content(store.read(plan, cases)) == want


def test_another_vocabulary_is_another_feature(spark, cases, source, tok_table, plan, store):
    store.compute_missing(plan, cases)
    more = spark.createDataFrame([("0new", "Tok", -1)], tok_table.schema)
    grown = build_vocab([tok_table.unionByName(more)])
    other = replace(plan, tokens=replace(plan.tokens, vocab=grown))
    assert other.config_hash != plan.config_hash
    assert content(store.compute_missing(other, cases)) == content(build_feature(cases, other))


def test_expressions_are_settings(source, vocab, plan):
    def with_grain(key, wgt=None):
        return mean_by_day(source, Tokens("Tok", [GrainColumn("Tok", key, wgt)], vocab=vocab)).config_hash

    hashes = [
        plan.config_hash, with_grain(lambda: [F.upper("token")]), with_grain(lambda: [F.col("token")], lambda: [F.lit(2.0)]),
        replace(plan, source=replace(source, rec_id="DT_s")).config_hash,
        *[replace(plan, filter=Filter("H", thresholds={}, predicates={"H": p})).config_hash
          for p in (F.col("token") == "a", F.col("token") == "b", lambda dt: F.hour(dt) < 2, lambda dt: F.hour(dt) > 2)],
        *[replace(plan, compress=replace(plan.compress, methods={"m": cmp.Method(a)})).config_hash for a in (F.max, F.min)],
    ]
    assert len(set(hashes)) == len(hashes)
    lists = lambda: F.transform(F.array("token"), lambda t: F.lower(t))
    assert with_grain(lists) == with_grain(lists)


def test_stage_reuse(cases, plan, store):
    stage = replace(plan, compress=None)
    store.compute_missing(stage, cases.where("case_id = 'c1'"))
    rows = store.compute_missing(plan, cases, stage=stage)
    assert content(rows) == content(build_feature(cases, plan))
    assert {r.status for r in store.status(stage, cases).collect()} == {"hit"}


def test_equal_records_stay_apart(spark, cases, tokens, monkeypatch):
    at = datetime(2024, 1, 1, 12)
    rows = [("p1", "r1", at, "a"), ("p1", "r1", at, "a"), ("p1", "r1", at, "b"), ("p1", "r2", at, "b")]
    source = RecordSource("Rec", spark.createDataFrame(rows, "pid string, rec_id string, DT_s timestamp_ntz, token string"))
    listed = replace(tokens, grains=[GrainColumn("Tok", lambda: F.array("token"))])
    single = replace(tokens, grains=[GrainColumn("Tok", lambda: [F.col("token")])])

    def weights(t):
        row = build_feature(cases, mean_by_day(source, t)).where("case_id = 'c1'").first()
        return row.keyidx, row.wgt

    want = weights(single)
    assert want[1] == [0.5, 0.5, 4.0] and weights(listed) == want
    monkeypatch.setattr("casefeat.operators.tokens.MAX_BROADCAST_TOKENS", 0)
    monkeypatch.setattr("casefeat.operators.vocab.MAX_BROADCAST_TOKENS", 0)
    assert weights(single) == want and weights(listed) == want


def test_unknown_tokens_on_the_flat_path(cases, source, tok_table):
    short = build_vocab([tok_table.where("grn = 'a'")])

    def weights(how):
        t = Tokens("Tok", [GrainColumn("Tok", lambda: [F.col("token")])], vocab=short, on_unknown=how)
        rows = build_feature(cases, mean_by_day(source, t)).where("case_id = 'c1' AND D = 0").first()
        return dict(zip(rows.keyidx, rows.wgt, strict=True))

    assert weights("drop") == {1: 0.5, 2: 2.0}
    assert weights("unk") == {0: 0.5, 1: 0.5, 2: 2.0}
    with pytest.raises(Exception, match="outside the vocabulary: b"):
        weights("fail")


def test_calendar_years_follow_the_data(spark):
    rows = spark.createDataFrame([(datetime(2019, 5, 1),), (datetime(2031, 5, 1),)], "dt timestamp_ntz")
    assert calendar_years(rows) == (2019, 2031)
    tokens = {r.grn for r in calendar_vocab(spark, *calendar_years(rows)).collect()}
    assert {"Year-2019", "Year-2031"} <= tokens and "Year-2018" not in tokens
    with pytest.raises(ValueError):
        calendar_years(rows.limit(0))


def test_slots_follow_the_period(spark, cases, source):
    assert slot_range(BF24) == (0, 288) and slot_range(CheckPeriod.parse("Af2H")) == (0, 23)
    assert slot_range(CheckPeriod("x", -24, -12)) == (144, 288)
    assert slot_range(CheckPeriod("x", 1, 3), "H") == (1, 2)
    assert slot_range(CheckPeriod("x", -24, 0, "H", start_exclusive=True)) == (0, 287)
    with pytest.raises(ValueError):
        slot_range(CheckPeriod("x", -1, 1))
    from casefeat.functions.timing import add_relative_time

    rows = add_relative_time(observe(cases, load_records(source), BF24))
    got = {r.case_id: r.tkn for r in one_token_per_slot(cases, rows, F.col("rec_id"), BF24, F.lit("-")).collect()}
    assert len(got["c1"]) == 289 and [got["c1"][k] for k in (0, 216, 288)] == ["r3", "r2", "r1"]
    assert set(got["c2"]) == {"-"} and got["c1"].count("-") == 286


def test_value_predicates(cases, source):
    flt = Filter("OnlyB", thresholds={"DTInD": 1}, predicates={"OnlyB": F.col("token") == "b"})
    got = build_feature(cases, Feature(BF24, source, flt)).collect()
    assert [r.rec_id for r in got] == ["r3"]


def test_crowded_time_lines(spark):
    n = 900
    records = spark.range(n).selectExpr("'p' AS pid", "CAST(id AS string) AS rec_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 3) AS dt")
    cases = records.selectExpr("rec_id AS case_id", "pid", "dt AS pred_dt")
    periods = {"before": CheckPeriod.parse("Bf10min"), "after": CheckPeriod("x", 5, 10, "min")}
    plain = content(record_count(cases, records, periods))
    assert content(record_count(cases, records, periods, max_cell_rows=20)) == plain
    before = {r.case_id: r.before for r in record_count(cases, records, periods, max_cell_rows=20).collect()}
    assert before == {str(i): min(i, 200) for i in range(n)}


def test_ranks(spark):
    df = spark.range(500).selectExpr("md5(CAST(id AS string)) AS k").repartition(5)
    got = {r.k: r.pos for r in with_rank(df, ["k"], "pos").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}
    assert with_rank(df.limit(0), ["k"], "pos").count() == 0


def test_big_ids_keep_their_groups(spark):
    ids = [2**53 + 1, 2**62 + 3, 7, -1]
    df = spark.createDataFrame([(i,) for i in ids], "pid bigint")
    for size in (1, 10):
        got = [r[0] for r in df.select(entity_group(F.col("pid"), range_size=size)).collect()]
        assert got == [i // size for i in ids]


def test_stored_suffix_lists(spark, source):
    stored = spark.createDataFrame(
        [("p1", "r1", ["x", "y"], [1.0, 2.0], ["G", "H"], [0, 7])],
        "pid string, rec_id string, S_key array<string>, S_wgt array<double>, S_rfg array<string>, S_keyInrfg array<int>",
    )
    tokens = Tokens("T", [GrainTable("S", stored), GrainColumn("Tok", lambda: F.array("token"))], calendar="Cal")
    rows = {r.rec_id: r for r in attach_tokens(load_records(source), tokens).collect()}
    assert rows["r1"].tkn_key[:3] == ["x", "y", "a"]
    assert rows["r1"].tkn_rfg == ["G", "H", "Tok", *["Cal"] * 6]
    assert rows["r1"].tkn_keyInrfg == [0, 7, 0, *range(6)]
    assert rows["r2"].tkn_rfg == ["Tok", *["Cal"] * 6] and len(rows["r2"].tkn_key) == 7
    assert "S_rfg" not in rows["r1"].asDict()


def test_wide_over_the_vocabulary(cases, plan, monkeypatch):
    state, vocab = compressed(cases, plan)
    row = cmp.wide(state, vocab).where("case_id = 'c1' AND D = 0").first().asDict()
    assert {k: v for k, v in row.items() if isinstance(v, float) and v} == {"a": 0.5, "b": 0.5, "5MinInD": 2.0}
    assert len(row) == vocab.size + len(state.prefix) + 3
    monkeypatch.setattr(cmp, "MAX_COLUMNS", 3)
    with pytest.raises(ValueError):
        cmp.wide(state, vocab)


def test_encoding_keeps_every_row(spark, vocab):
    rows = spark.createDataFrame([("r", ["a"], [1.0]), ("r", ["a"], [1.0]), ("r", [], [])], "rec_id string, tkn_key array<string>, tkn_wgt array<double>")
    assert sorted(len(r.tok) for r in encode_tokens(rows, vocab).collect()) == [0, 1, 1]


def test_chain_keeps_every_parent(spark):
    a = spark.createDataFrame([(k,) for k in range(5)], "a int")
    b = spark.createDataFrame([(0, "b0"), (0, "b1"), (1, "b2"), (9, "lost"), (0, "b0")], "a int, b string")
    c = spark.createDataFrame([("b0", 1), ("b0", 2), ("lost", 3)], "b string, c int")
    got = sorted(map(tuple, id_chain([("a", a), ("b", b), ("c", c)]).collect()))
    assert got == sorted(
        [("0", "b0", "1"), ("0", "b0", "2"), ("0", "b1", "Mb1"), ("1", "b2", "Mb2")]
        + [(str(k), f"M{k}", f"MM{k}") for k in (2, 3, 4)]
    )
    both = spark.createDataFrame([(0, "b0", 1), (1, "b0", 2)], "a int, b string, c int")
    got = sorted(map(tuple, id_chain([("a", a.where("a < 2")), ("b", b), ("c", both)]).collect()))
    assert got == [("0", "b0", "1"), ("0", "b1", "Mb1"), ("1", "b2", "Mb2")]


def test_a_folder_is_required(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder


def scans(df, table="events"):
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return sum("FileScan parquet" in line and f"{table}.parquet" in line for line in lines)


def test_sources_are_scanned_once(spark, source, tokens, cases):
    plans = {n: queries()[n](spark, SF_DIR) for n in ("check_periods", "case_filter_dev", "compress_cat_rows", "id_chain_prefix", "multi_feature")}
    assert scans(plans["check_periods"]) == 1
    assert "Join" not in plans["check_periods"]._jdf.queryExecution().executedPlan().toString()
    assert scans(plans["case_filter_dev"]) <= 2
    assert scans(plans["compress_cat_rows"]) <= 4
    # Distinct ids, cases and shared records are written in one pass each.
    assert [scans(plans["id_chain_prefix"], t) for t in ("customer", "orders", "lineitem")] == [0, 0, 0]
    assert scans(plans["multi_feature"]) == 0


def test_features_of_one_source(cases, source, tokens):
    first, second = mean_by_day(source, tokens), Feature(CheckPeriod.parse("Af2H"), source, WHOLE)
    rows = {r.case_id: r for r in build_features(cases, [first, second, replace(second, alias="again")]).collect()}
    assert [x.rec_id for x in rows["c1"][second.name]] == ["r4", "r5"] == [x.rec_id for x in rows["c1"]["again"]]
