"""As-of matches, functions of several observations, many windows in one join."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from casefeat import CheckPeriod, Feature, Filter
from casefeat.catalog import queries
from casefeat.operators import cases as case_sets
from casefeat.operators.nearest import Nearest, case_function, nearest_records
from casefeat.operators.observe import hull, observe, observe_windows
from casefeat.plans import features as plans

T0 = datetime(2024, 1, 10)
CASE = "case_id string, pid string, pred_dt timestamp_ntz"
RECORD = "pid string, rec_id string, dt timestamp_ntz, value double"


def tables(spark, seed, crowd=0):
    rng = random.Random(seed)
    at = lambda: T0 + timedelta(minutes=rng.choice([0, 5, 30, 60, 1440, 2880, 7000]) * rng.randint(-4, 4))
    cases = [(f"c{k}", rng.choice(["p1", "p2", "p3", None]), at()) for k in range(40)]
    records = [(rng.choice(["p1", "p2", None]), f"r{k}", at(), float(k)) for k in range(60)]
    records += [("p1", "r5", T0, 500.0), ("p1", None, T0, None), ("p2", "r1", None, 1.0)]
    records += [("p2", f"x{k}", T0 + timedelta(seconds=k), float(k)) for k in range(crowd)]
    return cases, records, spark.createDataFrame(cases, CASE), spark.createDataFrame(records, RECORD)


def plain_nearest(case, records, wanted):
    low, high = wanted.bounds
    us = timedelta(microseconds=1)
    first, last = case[2] + low * us, case[2] + high * us
    inside = [r for r in records if r[0] is not None and r[0] == case[1] and r[2] is not None and first <= r[2] <= last]
    if not inside:
        return None
    edge = (max if wanted.pick == "last" else min)(r[2] for r in inside)
    best = min((r for r in inside if r[2] == edge), key=lambda r: (r[1] is not None, r[1] or ""))
    return edge, best[1], best[3]


WANTED = {
    "before": Nearest(CheckPeriod.parse("Bf7D")),
    "after": Nearest(CheckPeriod.parse("Af24H", start_exclusive=True), "first"),
    "at_or_after": Nearest(CheckPeriod.parse("Af24H"), "first"),
    "oldest": Nearest(CheckPeriod.parse("Bf7D"), "first"),
    "latest_after": Nearest(CheckPeriod("both", -24, 24)),
}


@pytest.mark.parametrize(("seed", "crowd", "limit"), [(1, 0, 10**6), (2, 0, 3), (3, 300, 20)])
def test_nearest_equals_brute_force(spark, seed, crowd, limit):
    cases, records, case_df, record_df = tables(spark, seed, crowd)
    out = nearest_records(case_df, record_df, WANTED, ["value"], max_cell_rows=limit)
    got = {r["case_id"]: r for r in out.collect()}
    assert len(got) == len(cases)
    for case in cases:
        for name, wanted in WANTED.items():
            row = got[case[0]][name]
            assert (row and tuple(row)) == plain_nearest(case, records, wanted), (case, name)


def test_nearest_without_rows(spark):
    _, _, case_df, record_df = tables(spark, 1)
    assert nearest_records(case_df.limit(0), record_df, WANTED).count() == 0
    alone = nearest_records(case_df, record_df.limit(0), WANTED, ["value"])
    assert alone.where("before IS NULL AND oldest IS NULL").count() == 40


def test_nearest_has_no_pairs(spark):
    """Cases and records meet on a time line: no join by condition."""
    plan = queries()["nearest_values"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "cell" in plan


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Nearest(CheckPeriod.parse("Bf7D"), "middle")


def test_case_function(spark):
    cases = spark.createDataFrame([("a", "p1", T0), ("b", "p2", T0)], CASE)
    one = spark.createDataFrame([("a", "p1", T0, 3.0)], CASE + ", v double")
    entity = spark.createDataFrame([("p1", 10.0), ("p2", 20.0)], "pid string, h double")
    out = case_function(
        cases, {"one": one, "who": entity}, lambda one, who: {"sum": F.coalesce(one["v"], F.lit(0.0)) + who["h"]}
    )
    assert {r["case_id"]: r["sum"] for r in out.collect()} == {"a": 13.0, "b": 20.0}
    with pytest.raises(ValueError):
        case_function(cases, {"x": entity.withColumnRenamed("pid", "entity")}, lambda x: {})


PERIODS = [
    CheckPeriod.parse("Bf7D"), CheckPeriod.parse("Bf24H"), CheckPeriod.parse("Af2H", start_exclusive=True), CheckPeriod("far", 100, 130),
    CheckPeriod("both", -3, 3),
]


def test_hull():
    assert hull(PERIODS) == [(-7 * 86_400_000_000, 3 * 3_600_000_000), (100 * 3_600_000_000, 130 * 3_600_000_000)]


@pytest.mark.parametrize("width", [None, 3_600_000_000 * 5])
def test_windows_equal_single_joins(spark, width):
    _, _, cases, records = tables(spark, 7, 50)
    together = observe_windows(cases, records, PERIODS, width_us=width)
    assert together.groupBy("case_id", "pid", "pred_dt", "rec_id", "dt", "value").count().where("count > 1").count() == 0
    for i, period in enumerate(PERIODS):
        mine = together.where(F.col("windows").bitwiseAND(1 << i) != 0).drop("windows", "__distance")
        alone = observe(cases, records, period)
        assert sorted(map(repr, mine.collect())) == sorted(map(repr, alone.select(*mine.columns).collect()))


def test_windows_that_nobody_wants(spark):
    _, _, cases, records = tables(spark, 8)
    masked = records.withColumn("windows", F.when(F.col("value") % 2 == 0, 1).otherwise(0).cast("bigint"))
    rows = observe_windows(cases, masked, PERIODS)
    assert rows.where("windows != 1 OR value % 2 = 1").count() == 0 and rows.count() > 0
    with pytest.raises(ValueError):
        observe_windows(cases, records, PERIODS * 13)


def test_features_of_one_source_share_one_join(spark, monkeypatch, cases, source, tokens):
    joins, scans = [], []
    monkeypatch.setattr(plans, "observe_windows", lambda *a, f=plans.observe_windows, **k: joins.append(1) or f(*a, **k))
    monkeypatch.setattr(plans, "observe", lambda *a, f=plans.observe, **k: scans.append(1) or f(*a, **k))
    periods = {"a": "Bf24H", "b": "Af2H", "c": "Bf7D"}
    features = [
        Feature(CheckPeriod.parse(p), source, Filter("Morning", thresholds={"DTInD": 1}) if n == "a" else Filter(thresholds={}), alias=n)
        for n, p in periods.items()
    ]
    rows = plans.build_features(cases, [*features, Feature(CheckPeriod.parse("Bf24H"), source, alias="raw")])
    got = {r["case_id"]: r.asDict(True) for r in rows.collect()}
    assert joins == [1] and scans == []
    assert [r["rec_id"] for r in got["c1"]["b"]] == ["r4", "r5"] and [r["rec_id"] for r in got["c1"]["c"]] == ["r1", "r2", "r3"]
    assert [r["rec_id"] for r in got["c1"]["a"]] == ["r2"] and [r["token"] for r in got["c1"]["raw"]] == ["a", "a", "b"]
    assert got["c2"]["a"] is None


def test_draws_go_by_entity_and_time(spark):
    """Local ids: the name of a case does not enter, nor does a missing one lose it."""
    rows = [(str(k % 3), f"p{k // 3}", T0 + timedelta(hours=k)) for k in range(3_000)]
    cases = spark.createDataFrame(rows, CASE)
    renamed = cases.withColumn("case_id", F.lit(None).cast("string"))
    key = lambda df: {(r["pid"], r["pred_dt"]) for r in df.collect()}
    for ratio in (0.1, 0.5):
        kept = key(case_sets.downsample(cases, ratio))
        assert abs(len(kept) / 3_000 - ratio) < 0.04 and kept == key(case_sets.downsample(renamed, ratio))
    nobody = spark.createDataFrame([("a", None, T0), (None, "p", None)], CASE)
    assert case_sets.downsample(nobody, 1.0).count() == 2
    split = case_sets.split_cases(cases, 0.1, 0.1, 0.1).groupBy("split").count()
    shares = {r["split"]: r["count"] / 3_000 for r in split.collect()}
    assert abs(shares["in_test"] - 0.09) < 0.03 and abs(shares["in_valid"] - 0.09) < 0.03 and abs(shares["out_test"] - 0.1) < 0.05
