"""Stored stages: keys, what is read and what is computed again."""

from dataclasses import replace

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from casefeat import CheckPeriod, Feature, Filter
from casefeat.catalog import queries
from casefeat.catalog.queries import early, new_store, purchase_cases, stored_feature, stored_rows
from casefeat.plans.features import build_feature
from casefeat.sources import store as stores


@pytest.fixture
def setup(spark):
    return purchase_cases(spark, SF_DIR), stored_feature(spark, SF_DIR), new_store(spark)


def rows_of(df):
    return sorted(map(repr, stored_rows(df).collect()))


def test_keys_are_a_chain(setup):
    _, feature, _ = setup
    keys = feature.stage_keys
    assert len(set(keys)) == 5 and feature.config_hash == keys[-1]
    other = replace(feature, compress=replace(feature.compress, focal_layers=["CP"]))
    assert other.stage_keys[:-1] == keys[:-1] and other.stage_keys[-1] != keys[-1]
    later = replace(feature, filter=replace(feature.filter, thresholds={"DTInD": 2}))
    assert later.stage_keys[:2] == keys[:2] and not set(later.stage_keys[2:]) & set(keys)
    assert set(replace(feature, version="2").stage_keys).isdisjoint(keys)


def test_a_key_sees_the_files(setup):
    _, feature, store = setup
    source = feature.source
    errors = replace(source, df=source.df.where(F.col("event_type") == "error"))
    again = replace(source, df=source.df.sparkSession.read.parquet(f"{SF_DIR}/events.parquet"))
    assert store.key(replace(feature, source=errors)) != store.key(feature) == store.key(replace(feature, source=again))


def test_records_from_memory(cases, source, spark):
    """They enter by their rows: other rows are other records, even of one form."""
    key = new_store(spark).key
    feature = Feature(CheckPeriod.parse("Bf24H"), source, Filter(thresholds={}))
    rows = source.df.collect()
    same = replace(source, df=spark.createDataFrame(rows[::-1], source.df.schema))
    fewer = replace(source, df=spark.createDataFrame(rows[:-1], source.df.schema))
    assert key(replace(feature, source=same)) == key(feature) != key(replace(feature, source=fewer))


@pytest.mark.parametrize("kept", [["observation"], ["records"], ["tokens"]])
def test_nothing_is_read_again(setup, monkeypatch, kept):
    """With a stage stored for all cases no plan reads the records."""
    cases, feature, store = setup
    expected = rows_of(build_feature(cases, store.settled(feature)))
    store.through(feature.prefixes[-1], cases, keep=kept)
    built = []

    def watched(some, stage, *args, **kwargs):
        rows = build_feature(some, stage, *args, **kwargs)
        built.append(rows.inputFiles())
        return rows

    monkeypatch.setattr(stores, "build_feature", watched)
    assert rows_of(store.through(feature, cases)) == expected
    assert built and not any("events.parquet" in f for files in built for f in files)


def test_cases_start_from_different_stages(setup):
    cases, feature, store = setup
    expected = rows_of(build_feature(cases, store.settled(feature)))
    third = F.pmod(F.xxhash64("pid"), F.lit(3))
    observed, filtered, _ = feature.prefixes
    store.through(observed, cases.where(third == 0))
    store.through(filtered, cases.where(third == 1))
    assert rows_of(store.through(feature, cases)) == expected
    assert rows_of(store.through(feature, early(cases))) == rows_of(build_feature(early(cases), store.settled(feature)))


def test_filters_share_an_observation(setup):
    cases, feature, store = setup
    whole = replace(feature, filter=Filter("Evening", thresholds={"DTInD": 1}), tokens=None, compress=None)
    store.through(feature, cases, keep=["observation"])
    narrow = store.through(whole, cases)
    plain = build_feature(cases, whole)
    assert narrow.columns == plain.columns
    assert sorted(map(repr, narrow.collect())) == sorted(map(repr, plain.collect()))


def test_wrong_names_are_refused(setup):
    cases, feature, store = setup
    with pytest.raises(ValueError):
        store.through(feature, cases, keep=["windows"])
    with pytest.raises(ValueError):
        replace(feature, wide=True)


def test_queries_are_registered():
    assert {"store_from_observation", "store_from_records", "store_all_stages", "store_two_sources"} <= set(queries())
