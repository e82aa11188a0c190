"""Commits of the store: writers, readers and compactions side by side; keyed lookup."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from casefeat import CheckPeriod, Feature, Filter, RecordSource, build_feature
from casefeat.sources import store as S
from casefeat.sources.commits import CommitLog
from casefeat.sources.store import FeatureStore

PLAIN = CheckPeriod.parse("Bf24H")


def content(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def many(spark):
    """200 entities with a case and two records each; every tenth has none."""
    day = datetime(2024, 1, 2)
    cases = [(f"c{k}", f"p{k}", day) for k in range(200)]
    rows = [(f"p{k}", f"r{k}-{i}", day - timedelta(hours=i + 1)) for k in range(200) if k % 10 for i in range(2)]
    records = spark.createDataFrame(rows, "pid string, rec_id string, DT_s timestamp_ntz")
    feature = Feature(PLAIN, RecordSource("Rec", records), Filter(thresholds={}), version="1")
    return spark.createDataFrame(cases, "case_id string, pid string, pred_dt timestamp_ntz"), feature


@pytest.fixture
def store(spark, tmp_path):
    return FeatureStore(spark, str(tmp_path / "store"), groups=16)


def test_a_number_is_taken_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.latest() == (0, [])
    assert log.put(1, [{"run": "a"}]) and not log.put(1, [{"run": "b"}])
    assert log.latest() == (1, [{"run": "a"}]) and log.put(2, [])
    assert log.latest() == (2, []) and log.entries(1) == [{"run": "a"}]
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if p.suffix == ".json") == ["1.json", "2.json"]
    assert not [p for p in (tmp_path / "log").iterdir() if "draft" in p.name]


def test_a_writer_that_lost_takes_out_what_others_stored(many, store):
    cases, feature = many
    rows = build_feature(cases, feature)
    first = store.prepare(feature, cases, rows)
    some = cases.where("pid < 'p5'")
    store.compute_missing(feature, some)
    assert store.commit(feature, first) == 2
    lines = store.manifest(feature, cases)
    assert lines.count() == lines.select("pid", "pred_dt").distinct().count() == 200
    assert lines.where(F.col("run") == first.run).count() == 200 - some.count()
    assert content(store.read(feature, cases)) == content(rows)


def test_lost_between_reading_and_putting(many, store, monkeypatch):
    """Another commit lands after the writer has looked: its number is taken."""
    cases, feature = many
    rows = build_feature(cases, feature)
    pending, other = store.prepare(feature, cases, rows), store.prepare(feature, cases.where("pid < 'p5'"), rows)
    put, done = CommitLog.put, []

    def slow(log, number, entries):
        if not done:
            done.append(number)
            store.commit(feature, other)
        return put(log, number, entries)

    monkeypatch.setattr(CommitLog, "put", slow)
    assert store.commit(feature, pending) == 2 and done == [1]
    assert store.size(feature, cases).first() == (200, 360)
    assert content(store.read(feature, cases)) == content(rows)


def test_everything_stored_by_others_is_no_commit(many, store):
    cases, feature = many
    pending = store.prepare(feature, cases, build_feature(cases, feature))
    store.compute_missing(feature, cases)
    assert store.commit(feature, pending) == 1 == store.version(feature)


def test_compaction_between_rows_and_commit(many, store):
    cases, feature = many
    rows = build_feature(cases, feature)
    store.compute_missing(feature, cases.where("pid < 'p3'"))
    store.compute_missing(feature, cases.where("pid < 'p5'"))
    pending = store.prepare(feature, cases.where("pid >= 'p4'"), rows.where("pid >= 'p4'"))
    run = store.compact(feature, cases, grace_hours=1)
    assert {r["run"] for r in store._visible(feature)} == {run}
    store.commit(feature, pending)
    assert {r["run"] for r in store._visible(feature)} == {run, pending.run}
    assert content(store.read(feature, cases)) == content(rows)


def test_commit_between_rows_of_a_compaction_and_its_commit(many, store, monkeypatch):
    cases, feature = many
    store.compute_missing(feature, cases.where("pid < 'p3'"))
    prepare, seen = store.prepare, []

    def slow(*args, **kwargs):
        pending = prepare(*args, **kwargs)
        if kwargs.get("run") and not seen:
            seen.append(pending.run)
            store.compute_missing(feature, cases)
        return pending

    monkeypatch.setattr(store, "prepare", slow)
    run = store.compact(feature, cases, grace_hours=0)
    assert [run] == seen and len(store._visible(feature)) == 2
    assert content(store.read(feature, cases)) == content(build_feature(cases, feature))


def test_second_compaction_gives_way(many, store, monkeypatch):
    cases, feature = many
    store.compute_missing(feature, cases)
    prepare, inner = store.prepare, []

    def slow(*args, **kwargs):
        pending = prepare(*args, **kwargs)
        if not inner:
            inner.append(None)
            inner[0] = store.compact(feature, cases)
        return pending

    monkeypatch.setattr(store, "prepare", slow)
    assert store.compact(feature, cases) is None
    assert [r["run"] for r in store._visible(feature)] == inner
    assert content(store.read(feature, cases)) == content(build_feature(cases, feature))


def test_a_reader_keeps_its_commit(many, store):
    cases, feature = many
    some = cases.where("pid < 'p3'")
    store.compute_missing(feature, some)
    want, reader = content(store.read(feature, cases)), store.read(feature, cases)
    store.compute_missing(feature, cases)
    store.compact(feature, cases)
    assert content(reader) == content(store.read(feature, cases, version=1)) == want
    assert content(store.lookup(feature, cases.where("pid = 'p99'"), version=1)) == []
    store.vacuum(feature, grace_hours=0)
    assert content(store.read(feature, cases)) == content(build_feature(cases, feature))
    assert len(store._folders("rows", feature)) == 1 and store._log(feature).times().keys() == {3}


def test_lookup_opens_few_files(many, store):
    cases, feature = many
    store.compute_missing(feature, cases.where("pid < 'p5'"))
    store.compute_missing(feature, cases)
    ten = cases.where(F.col("pid").isin([f"p{k}" for k in range(25, 200, 18)]))
    found = store.lookup(feature, ten)
    assert ten.count() == 10 and content(found) == content(store.read(feature, ten)) == content(build_feature(ten, feature))
    everything = len(store._rows(feature, store._visible(feature)).inputFiles())
    opened = len(found.inputFiles())
    assert opened <= 10 < 25 <= everything
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(pid" in plan or "PushedFilters: [IsNotNull(pid), In(pid" in plan or "In(pid," in plan


def test_lookup_of_unknown_empty_renamed_and_many(many, store, monkeypatch):
    cases, feature = many
    some = cases.where("pid IN ('p11', 'p20', 'p12')")
    assert content(store.lookup(feature, some)) == []
    store.compute_missing(feature, cases.where("pid IN ('p11', 'p20')"))
    renamed = some.withColumn("case_id", F.concat(F.lit("new-"), "case_id"))
    none = some.sparkSession.createDataFrame([(None, None, None)], some.schema)
    twice = renamed.unionByName(some).unionByName(none)
    got = store.lookup(feature, twice)
    assert content(got) == content(store.read(feature, twice)) and got.count() == 4
    assert store.lookup(feature, cases.where("pid = 'p20'")).columns == got.columns
    assert store.lookup(feature, cases.limit(0)).count() == 0
    want = content(got)
    monkeypatch.setattr(S, "FEW", 2)
    assert content(store.lookup(feature, twice)) == want


def test_one_case_of_two_names_is_stored_once(many, store):
    cases, feature = many
    both = cases.unionByName(cases.withColumn("case_id", F.concat(F.lit("again-"), "case_id")))
    rows = store.compute_missing(feature, both)
    assert store.size(feature, cases).first() == (200, 360)
    assert content(rows) == content(build_feature(both, feature))
