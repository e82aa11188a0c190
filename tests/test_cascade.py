"""Rules settled in one pass, and compress methods that see every weight."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casefeat import CheckPeriod, Feature, Filter, RecordSource
from casefeat.catalog import queries
from casefeat.functions.timing import add_relative_time
from casefeat.operators import compress as cmp
from casefeat.operators.filters import good_buckets, keep_full
from casefeat.operators.observe import observe
from casefeat.plans.features import filtered_rows

SF_DIR = "/root/testdata/sf0.001"
AT = datetime(2024, 1, 10)


@pytest.fixture(scope="module")
def seen(spark):
    """Observed rows on both sides of their cases, clustered and repeated."""
    draw = random.Random(3)
    rows = []
    for i in range(900):
        minutes = draw.choice([draw.randrange(-9000, 9000), draw.randrange(-400, 400)])
        rows.append((f"p{draw.randrange(6)}", f"r{i % 700}", AT + timedelta(minutes=minutes, seconds=draw.randrange(3))))
    records = spark.createDataFrame(rows, "pid string, rec_id string, dt timestamp_ntz")
    cases = spark.createDataFrame(
        [(f"c{i}{j}", f"p{i}", AT + timedelta(hours=j)) for i in range(6) for j in (0, 30)],
        "case_id string, pid string, pred_dt timestamp_ntz",
    )
    period = CheckPeriod("both", -120, 120, "H")
    return add_relative_time(observe(cases, records, period)).checkpoint()


def by_hand(frame: pd.DataFrame, rules) -> pd.DataFrame:
    """Rule by rule, each on what the ones before it left."""
    names = {"DT": "dt", "R": "rec_id"}
    for rule, need in rules.items():
        source, target = (names.get(p, p) for p in rule.split("In"))
        frame = frame[frame.groupby(["case_id", target])[source].transform("nunique") >= need]
    return frame


@pytest.mark.parametrize(
    "rules",
    [
        {"DTInH": 2, "HInD": 2, "DInCP": 3},
        {"DInCP": 4, "DTInD": 9, "5MinInH": 2},
        {"HInD": 3, "DTInH": 2, "HInW": 5, "DTInCP": 30, "DTIn5Min": 2},
        {"DInH": 1, "WInCP": 1, "DTInD": 4},
        {"DTInD": 1000, "DInCP": 1},
        {"RInD": 5, "DTInH": 2, "RInCP": 20},
    ],
)
def test_cascade_equals_rule_by_rule(seen, rules):
    expected = by_hand(seen.toPandas(), rules)
    got = keep_full(seen, rules).toPandas()
    columns = ["case_id", "rec_id", "dt"]
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, expected[columns].astype(str).values))
    if rules.get("DTInD") != 1000:
        assert 0 < len(expected) < seen.count()


def test_one_set_of_buckets_for_rules_on_times(seen):
    times = seen.drop("rec_id").distinct()
    found = good_buckets(times, {"DTInH": 2, "HInD": 2, "DInCP": 2}, True)
    assert [g.columns[-1] for g in found] == ["H"]
    found = good_buckets(times, {"DTInD": 2}, True)
    assert [g.columns[-1] for g in found] == ["D"]


def test_events_are_read_twice_at_most(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").withColumn("pid", F.col("user_id").cast("string"))
    source = RecordSource("Events", events, "pid", "event_id", "ts", ["event_type"])
    cases = spark.createDataFrame([("c", "1", AT)], "case_id string, pid string, pred_dt timestamp_ntz")
    rules = {"DTInH": 1, "HInD": 1, "5MinInD": 1, "DTInW": 1, "DInCP": 1}
    feature = Feature(CheckPeriod.parse("Bf7D"), source, Filter(thresholds=rules))
    records = events.select("pid", F.col("event_id").alias("rec_id"), F.col("ts").alias("dt"))
    plan = filtered_rows(cases, feature, records)._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("FileScan") <= 2
    plan = queries()["threshold_cascade"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    # Cases, thresholds and tokens: one read each.
    assert plan.count("Relation [") <= 4


def weighted(spark, n=400):
    draw = random.Random(5)
    rows = [
        (f"p{i % 3}", f"r{i}", AT - timedelta(minutes=draw.randrange(1, 4000)), draw.choice("aab"), draw.choice([0.5, 1.0, 2.25, 3.0]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "pid string, rec_id string, dt timestamp_ntz, token string, w double")


def state_of(spark, vocab, frame):
    """Single flat records as a program state."""
    ids = {r.grn: r.idx for r in vocab.df.select("grn", "idx").collect()}
    idx = F.when(F.col("token") == "a", F.lit(ids["a"])).otherwise(F.lit(ids["b"]))
    rows = add_relative_time(
        frame.select(F.concat(F.lit("c"), "pid").alias("case_id"), "pid", F.lit(AT).cast("timestamp_ntz").alias("pred_dt"),
                     "rec_id", "dt", F.array(F.struct(idx.alias("idx"), F.col("w").alias("w"))).alias("tok"))
    )
    return cmp.flatten(cmp.start(rows, None, vocab, unique=True)), {v: k for k, v in ids.items()}


@pytest.mark.parametrize("q", [0, 0.25, 0.5, 0.9, 1])
def test_quantiles_count_absent_zeros(spark, vocab, q):
    frame = weighted(spark)
    state, names = state_of(spark, vocab.extended(["5MinInD"]), frame)
    out = cmp.roll_up(state, "5MinInD", cmp.quantile(q), vocab.extended(["5MinInD"]))
    got = {
        (r.pid, r.D, names[t.idx]): t.w
        for r in out.rows.select("pid", "D", "tok").collect() for t in r.tok if names.get(t.idx) in ("a", "b")
    }
    local = frame.toPandas()
    local["D"] = ((AT - local.dt).dt.total_seconds() // 86_400).astype(int)
    expected = {}
    for (pid, day), group in local.groupby(["pid", "D"]):
        for token in group.token.unique():
            weights = np.where(group.token == token, group.w, 0.0)
            expected[(pid, day, token)] = float(np.quantile(weights, q))
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k], abs=1e-12) for k in expected)


def test_quantile_after_a_roll_up_sees_natural_weights(spark, vocab):
    """A second step gets whole thousandths; the method sees natural weights."""
    named = vocab.extended(["5MinInD", "DInCP"])
    state, names = state_of(spark, named, weighted(spark))
    days = cmp.roll_up(state, "5MinInD", cmp.METHODS["sum"], named)
    out = cmp.roll_up(days, "DInCP", cmp.quantile(0.5), named)
    inner = {}
    for r in days.rows.select("pid", "D", "tok").collect():
        for t in r.tok:
            if names.get(t.idx) == "a":
                inner.setdefault(r.pid, {})[r.D] = t.w / 1000
        inner.setdefault(r.pid, {}).setdefault(r.D, 0.0)
    got = {r.pid: t.w for r in out.rows.select("pid", "tok").collect() for t in r.tok if names.get(t.idx) == "a"}
    assert got == pytest.approx({p: float(np.median(list(d.values()))) for p, d in inner.items()})


def test_equal_weights_are_counted_before_the_shuffle(spark, vocab):
    named = vocab.extended(["5MinInD"])
    state, _ = state_of(spark, named, weighted(spark))
    out = cmp.roll_up(state, "5MinInD", cmp.quantile(0.5), named)
    plan = out.rows._jdf.queryExecution().executedPlan().toString()
    lowest = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "partial_count" in lowest and "collect_list" not in lowest


def test_quantile_out_of_range():
    with pytest.raises(ValueError, match="between 0 and 1"):
        cmp.quantile(1.5)
