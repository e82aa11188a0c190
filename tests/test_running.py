"""Sums from running sums equal sums of joined rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from casefeat import CheckPeriod, Compress, Feature, Filter, GrainColumn, RecordSource, Tokens
from casefeat.config import rolled
from casefeat.operators import compress as cmp
from casefeat.operators import running as module
from casefeat.operators.vocab import build_vocab
from casefeat.plans.features import compressed, token_state

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def sides(spark):
    """400 records of one entity within a day and a half, equal times among
    them, few of another; cases at every tenth time, two without records."""
    rows = [("all", i, START + timedelta(minutes=5 * i if i % 7 else 5 * i + 5), "abc"[i % 3], float(i % 4)) for i in range(400)]
    rows += [("few", i, START + timedelta(hours=i), "a", 1.0) for i in range(4)]
    rows += [(None, 1, START, "b", 1.0), ("all", 2, None, "b", 1.0), ("all", 3, START, None, 1.0)]
    records = spark.createDataFrame(rows, "pid string, rec_id bigint, dt timestamp_ntz, token string, value double")
    cases = [(f"c{i}", "all", START + timedelta(minutes=5 * i)) for i in range(0, 400, 10)]
    cases += [("f", "few", START + timedelta(hours=2)), ("g", "few", START - timedelta(days=9)), ("n", None, START), ("m", "all", None)]
    cases += [("c50", "all", START + timedelta(minutes=250))]
    return spark.createDataFrame(cases, "case_id string, pid string, pred_dt timestamp_ntz"), records


def feature(spark, records, period, rule, method, weight=None):
    vocab = build_vocab([spark.createDataFrame([(t, "Tok", i) for i, t in enumerate("abc")], "grn string, rfg string, pos bigint")], [rule])
    grain = GrainColumn("Tok", lambda: [F.col("token")], weight)
    source = RecordSource("R", records, "pid", "rec_id", "dt", ["token", "value"])
    tokens = Tokens("T", [grain], vocab=vocab)
    return Feature(period, source, Filter(thresholds={}), tokens, Compress([rolled(rule, method)], focal_layers=["CP"]))


def rows_of(cases, feature):
    state, vocab = compressed(cases, feature)
    level = state.prefix[-1]
    long = cmp.decoded(state, vocab).select("case_id", "pid", "pred_dt", level, "token", "weight")
    return sorted(map(str, long.collect()))


@pytest.mark.parametrize(
    "period, rule, method", [("Bf24H", "5MinInD", "sum"), ("both", "5MinInH", "mean"), ("Af2H", "5MinInCP", "cat")]
)
def test_equals_joined_rows(spark, sides, monkeypatch, period, rule, method):
    cases, records = sides
    period = CheckPeriod("both", -3, 2) if period == "both" else CheckPeriod.parse(period)
    weight = lambda: [F.col("value")]
    f = feature(spark, records, period, rule, method, weight)
    monkeypatch.setattr(module, "MAX_STRETCHES", 0)
    assert token_state(cases, f)[0].summed is None
    joined = rows_of(cases, f)
    monkeypatch.setattr(module, "MAX_STRETCHES", 30)
    monkeypatch.setattr(module, "PAIRS_PER_ROW", 0)
    monkeypatch.setattr(module.summed_in_line, "__defaults__", (40,))
    assert token_state(cases, f)[0].summed is not None
    assert joined and rows_of(cases, f) == joined


def test_fractions_and_loose_windows_are_joined(spark, sides, monkeypatch):
    cases, records = sides
    period = CheckPeriod.parse("Af2H")
    assert token_state(cases, feature(spark, records, period, "5MinInD", "sum"))[0].summed is None
    monkeypatch.setattr(module, "PAIRS_PER_ROW", 0)
    half = lambda: [F.col("value") + 0.5]
    assert token_state(cases, feature(spark, records, period, "5MinInD", "sum", half))[0].summed is None
    assert token_state(cases, feature(spark, records, period, "5MinInD", "sum"))[0].summed is not None


def test_crowded_windows_are_never_joined(spark, sides):
    """Pairs outnumber the rows: the plan joins no case with a record."""
    cases, records = sides
    many = spark.range(10).crossJoin(records.where("pid = 'all'")).drop("id")
    f = feature(spark, many, CheckPeriod.parse("Bf24H"), "5MinInD", "sum")
    state, _ = compressed(cases, f)
    assert "__b" not in state.rows._jdf.queryExecution().optimizedPlan().toString()
