"""The surveyed interval join: same rows, records cut below the shuffle."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from casefeat import CheckPeriod
from casefeat.catalog import queries
from casefeat.operators import survey as module
from casefeat.operators.observe import join_survey, observe, observe_windows
from casefeat.operators.survey import reached, survey

SF_DIR = "/root/testdata/sf0.001"
SIX_HOURS = CheckPeriod.parse("Bf6H")


def key(df):
    return sorted((r.case_id, r.rec_id) for r in df.select("case_id", "rec_id").collect())


def sides(spark, n=3000):
    """Two thirds of the records are one entity's; most entities have no case."""
    records = spark.range(n).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 100)).alias("pid"),
        F.col("id").cast("string").alias("rec_id"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 20)").alias("dt"),
    )
    cases = records.where("rec_id % 40 = 0").select(
        F.col("rec_id").alias("case_id"), "pid", F.col("dt").alias("pred_dt")
    )
    return cases, records


def test_same_rows_as_the_plain_join(spark, monkeypatch):
    cases, records = sides(spark)
    plain = key(observe(cases, records, SIX_HOURS, how="plain"))
    assert len(plain) > 10_000
    assert key(observe(cases, records, SIX_HOURS, how="surveyed")) == plain
    monkeypatch.setattr(module.survey, "__defaults__", (500,))
    found = join_survey(cases, records, SIX_HOURS)
    assert found.crowded.agg(F.max("parts")).first()[0] > 10
    assert key(observe(cases, records, SIX_HOURS, how="surveyed", found=found)) == plain


def test_entities_where_cells_are_too_many(spark, monkeypatch):
    cases, records = sides(spark, 6000)
    hour = CheckPeriod.parse("Bf1H")
    narrow = cases.where("pid = 'hot' OR pid < 'p2'")
    plain = key(observe(narrow, records, hour, how="plain"))
    for words, by in ((16, ("pid", "__b")), (1, ("pid",)), (0, ())):
        monkeypatch.setattr(module, "MAX_WORDS", words)
        found = join_survey(narrow, records, hour)
        assert found.by == by and (found.words is None) == (words == 0)
        assert key(observe(narrow, records, hour, how="surveyed", found=found)) == plain


def test_only_cells_with_windows_pass(spark):
    cases, records = sides(spark)
    few = cases.where("case_id IN ('200', '320')")
    width = SIX_HOURS.length_us
    windows = few.select("pid", F.lit(0).cast("bigint").alias("__b"), F.lit(0).alias("__s"), F.lit(width).alias("__e"))
    rows = records.withColumns({"__u": F.lit(0), "__b": F.lit(0).cast("bigint")})
    found = survey(windows, rows)
    entities = {r.pid for r in few.collect()}
    passed = reached(rows, found)
    assert passed.columns == rows.columns
    assert entities <= {r.pid for r in passed.collect()}
    assert passed.count() < rows.count()


def test_slots_of_many_small_cells_are_not_crowded(spark):
    """Every slot holds cells that only hash alike."""
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("pid"), F.lit(0).cast("bigint").alias("__b"))
    windows = rows.withColumns({"__s": F.lit(0), "__e": F.lit(1)})
    assert module._crowded(windows, rows.withColumn("__u", F.lit(0)), 40) is None
    hot = rows.unionByName(spark.range(500).select(F.lit("7").alias("pid"), F.lit(0).cast("bigint").alias("__b")))
    assert module._crowded(windows, hot, 40).count() == 1


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_other_types_of_entity(spark, kind):
    """Types whose equal values may hash apart are not filtered by hash."""
    cases, records = sides(spark)
    numbered = records.where("pid <> 'hot'").withColumn("pid", F.expr("cast(substr(pid, 2) as bigint)"))
    mine = cases.where("pid <> 'hot'").withColumn("pid", F.expr(f"cast(substr(pid, 2) as {kind})"))
    assert (join_survey(mine, numbered, SIX_HOURS).words is None) == (kind == "double")
    plain = key(observe(mine, numbered, SIX_HOURS, how="plain"))
    assert plain and key(observe(mine, numbered, SIX_HOURS, how="surveyed")) == plain


def test_nulls_and_empty_sides(spark):
    cases, records = sides(spark, 300)
    odd = spark.createDataFrame(
        [(None, None, None), ("x", None, datetime(2024, 1, 1)), ("y", "hot", None)],
        "case_id string, pid string, pred_dt timestamp_ntz",
    )
    strange = spark.createDataFrame(
        [(None, None, None), (None, "a", datetime(2024, 1, 1)), ("hot", None, None)],
        "pid string, rec_id string, dt timestamp_ntz",
    )
    plain = key(observe(cases, records, SIX_HOURS, how="plain"))
    assert plain and key(observe(cases.unionByName(odd), records.unionByName(strange), SIX_HOURS, how="surveyed")) == plain
    nothing = cases.where("false")
    assert key(observe(nothing, records, SIX_HOURS, how="surveyed")) == []
    assert key(observe(odd.where("pid IS NULL"), records, SIX_HOURS, how="surveyed")) == []
    assert key(observe(cases, records.where("false"), SIX_HOURS, how="surveyed")) == []


def test_several_windows(spark, monkeypatch):
    cases, records = sides(spark)
    monkeypatch.setattr(module.survey, "__defaults__", (500,))
    periods = [SIX_HOURS, CheckPeriod.parse("Af2H")]
    both = [
        sorted((r.case_id, r.rec_id, r.windows) for r in observe_windows(cases, records, periods, how=how).collect())
        for how in ("bucketed", "surveyed")
    ]
    assert both[0] and both[0] == both[1]


def test_records_are_cut_below_the_shuffle(spark):
    """The membership test stands between the scan and the exchange of the
    records, the time range in the scan itself."""
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    records = events.selectExpr("cast(user_id as string) AS pid", "event_id AS rec_id", "ts AS dt")
    last = events.agg(F.max("ts")).first()[0]
    cases = spark.createDataFrame(
        [(f"c{i}", str(i), last - timedelta(hours=i)) for i in range(1, 4)],
        "case_id string, pid string, pred_dt timestamp_ntz",
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = observe(cases, records, CheckPeriod.parse("Bf24H"), how="surveyed")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    test_line = next(i for i, x in enumerate(lines) if "getbit" in x.lower() or "bit_get" in x.lower())
    exchange = max(i for i, x in enumerate(lines[:test_line]) if "Exchange hashpartitioning" in x)
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "GreaterThanOrEqual(ts" in x)
    assert exchange < test_line < scan


def test_features_survey_large_records(spark, monkeypatch):
    names = ["compress_crowded_entity", "threshold_chain", "observe_windows"]
    before = {n: sorted(map(str, queries()[n](spark, SF_DIR).collect())) for n in names}
    monkeypatch.setattr("casefeat.operators.observe.SURVEY_BYTES", 0)
    monkeypatch.setattr(module.survey, "__defaults__", (1000,))
    seen = []
    inner = module._crowded

    def watched(*args):
        seen.append(inner(*args))
        return seen[-1]

    monkeypatch.setattr(module, "_crowded", watched)
    for name in names:
        assert sorted(map(str, queries()[name](spark, SF_DIR).collect())) == before[name]
        # One survey a query, also where thresholds are settled first.
        assert len(seen) == 1
        assert name != "compress_crowded_entity" or seen[0] is not None
        seen.clear()
