"""The store: idempotent, incremental, blind to interrupted runs."""

import pytest
from pyspark.sql import functions as F

from casefeat import CheckPeriod, Compress, Feature, Filter, RecordSource, build_feature
from casefeat.config import rolled
from casefeat.sources.records import load_records, read_grouped, time_column, union_records, write_grouped
from casefeat.sources.store import FeatureStore, lists_from_json, lists_to_json

BF24 = CheckPeriod.parse("Bf24H")


@pytest.fixture
def plan(source, tokens):
    program = Compress([rolled("5MinInD", "mean")], focal_layers=["CP", "D"])
    return Feature(BF24, source, Filter(thresholds={}), tokens, program)


@pytest.fixture
def store(spark, tmp_path):
    return FeatureStore(spark, str(tmp_path / "store"), groups=2)


def content(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_incremental_equals_from_scratch(spark, cases, plan, store):
    computed = []

    def compute(missing):
        computed.append(sorted(r.case_id for r in missing.collect()))
        return build_feature(missing, plan)

    first = cases.where("case_id = 'c1'")
    nothing = store.read(plan, cases)
    assert nothing.count() == 0 and set(nothing.columns) == set(build_feature(cases, plan).columns)
    store.compute_missing(plan, first, compute)
    rows = store.compute_missing(plan, cases, compute)
    again = store.compute_missing(plan, cases, compute)
    assert computed == [["c1"], ["c2"]]
    assert content(rows) == content(again) == content(build_feature(cases, plan))
    assert store.read(plan, first).select("case_id").distinct().collect() == [("c1",)]
    assert store.size(plan, cases).first() == (2, 3)


def test_append_twice_stores_once(cases, plan, store):
    rows = build_feature(cases, plan)
    store.append(plan, cases, rows)
    store.append(plan, cases, rows)
    assert content(store.read(plan, cases)) == content(rows)


def test_known_empty_cases(cases, source, store):
    plain = Feature(BF24, source, Filter(thresholds={}))
    store.append(plain, cases, build_feature(cases, plain))
    status = {r.case_id: (r.nrow, r.status) for r in store.status(plain, cases).collect()}
    assert status == {"c1": (3, "hit"), "c2": (0, "empty")}


def test_only_empty_cases(cases, source, store):
    plain = Feature(BF24, source, Filter(thresholds={}))
    empty = cases.where("case_id = 'c2'")
    assert store.compute_missing(plain, empty).count() == 0
    assert store.status(plain, empty).first().status == "empty"
    assert store.compute_missing(plain, cases).count() == 3


def test_changed_settings_miss(cases, source, plan, store):
    plain = Feature(BF24, source, Filter(thresholds={}))
    store.append(plain, cases, build_feature(cases, plain))
    stricter = Feature(BF24, source, Filter(thresholds={"DTInD": 2}))
    assert {r.status for r in store.status(stricter, cases).collect()} == {"miss"}


def test_interrupted_run_is_invisible(cases, plan, store):
    rows = build_feature(cases, plan)
    store.append(plan, cases, rows)
    # Rows without a manifest, as a run leaves them that died in between.
    lost = rows.withColumn("grp", F.lit(0))
    lost.write.partitionBy("grp").parquet(f"{store._folder('rows', plan)}/run=rlost")
    assert content(store.read(plan, cases)) == content(rows)


def test_json_round_trip(cases, plan):
    rows = build_feature(cases, plan)
    text = lists_to_json(rows)
    assert dict(text.dtypes)["keyidx"] == "string" and dict(text.dtypes)["pred_dt"] == "string"
    assert content(lists_from_json(text, rows.schema)) == content(rows)


def test_grouped_records(spark, source, tmp_path):
    records = load_records(source).withColumn("pid", F.lit("17"))
    write_grouped(records, f"{tmp_path}/r", range_size=10)
    assert read_grouped(spark, f"{tmp_path}/r", [1]).drop("grp").count() == 5
    assert read_grouped(spark, f"{tmp_path}/r", [4]).count() == 0
    plan = read_grouped(spark, f"{tmp_path}/r", [1])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(grp" in plan


def test_time_column_and_projection(spark, record_df):
    assert time_column(record_df) == "DT_s"
    kept = load_records(RecordSource("Rec", record_df, columns=["token", "no_such"]))
    assert kept.columns == ["pid", "rec_id", "dt", "token"]
    with pytest.raises(ValueError):
        time_column(record_df.select("pid"))


def test_union_fills_missing_columns(record_df, source):
    records = load_records(source)
    both = union_records([records, records.drop("token")])
    assert both.count() == 10 and both.where("token IS NULL").count() == 5
