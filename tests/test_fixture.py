"""Hand-worked values for every stage of the chain."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from casefeat import CheckPeriod, Compress, Feature, Filter, GrainColumn, GrainTable, RecordSource, Step, Tokens
from casefeat import build_feature, build_features
from casefeat.config import rolled
from casefeat.operators import compress as cmp
from casefeat.operators.observe import check_period, observe, observed_count, record_count
from casefeat.operators.tokens import encode_tokens
from casefeat.operators.vocab import Vocabulary, build_vocab, vocab_conflicts
from casefeat.plans.features import compressed
from casefeat.sources.records import load_records

BF24, AF2 = CheckPeriod.parse("Bf24H"), CheckPeriod.parse("Af2H")


def ids(df):
    return sorted(r.rec_id for r in df.collect())


def decoded(state, vocab, keys=("D",)):
    """{bucket: ([tokens], [weights])} of case c1."""
    out = {}
    for r in sorted(cmp.decoded(state, vocab).where("case_id = 'c1'").collect(), key=lambda r: r.pos):
        names, weights = out.setdefault(tuple(r[k] for k in keys), ([], []))
        names.append(r.token)
        weights.append(r.weight)
    return out


def feature(source, tokens, steps, period=BF24, flt=Filter(thresholds={}), **layers):
    layers = layers or {"focal_layers": ["CP", "D"]}
    return Feature(period, source, flt, tokens, Compress(steps, **layers))


def test_period_bounds(cases):
    row = check_period(cases, CheckPeriod("x", -1.5, 0.25, "H")).first()
    assert row.dt_start == datetime(2024, 1, 1, 22, 30)
    assert row.dt_end == datetime(2024, 1, 2, 0, 15)


def test_period_names():
    day = 86_400_000_000
    assert (BF24.start_us, BF24.end_us) == (-day, 0)
    assert CheckPeriod.parse("Af2M10D").end_us == 66 * day
    assert CheckPeriod.parse("Af1W").end_us == 7 * day
    assert CheckPeriod.parse("Bf90min").start_us == -5_400_000_000
    with pytest.raises(ValueError):
        CheckPeriod.parse("Bf24")
    with pytest.raises(ValueError):
        CheckPeriod("x", 0, 1, "weeks")
    with pytest.raises(ValueError):
        CheckPeriod("x", 1, 1)


@pytest.mark.parametrize("how", [{"how": "plain"}, {}, {"width_us": 7_000_000_000}, {"hot_cell_rows": 1}])
def test_observation(cases, source, how):
    records = load_records(source)
    assert ids(observe(cases, records, BF24, **how)) == ["r1", "r2", "r3"]
    assert ids(observe(cases, records, AF2, **how)) == ["r4", "r5"]
    late = CheckPeriod.parse("Af2H", start_exclusive=True)
    assert ids(observe(cases, records, late, **how)) == ["r5"]


def test_record_numbers(cases, source):
    records = load_records(source)
    for period, expected in ((BF24, {"c1": 3, "c2": 0}), (AF2, {"c1": 2, "c2": 0})):
        got = {r.case_id: r.rec_num for r in record_count(cases, records, period).collect()}
        assert got == expected
        seen = observed_count(cases, observe(cases, records, period))
        assert {r.case_id: r.nrow for r in seen.collect()} == expected


def test_relative_time(cases, source):
    from casefeat.functions.timing import add_relative_time

    week = CheckPeriod("x", -24, 24)
    rows = add_relative_time(observe(cases, load_records(source), week)).orderBy("rec_id").collect()
    got = [(r["5Min"], r.H, r.D, r.W, r.M, r.CP) for r in rows]
    assert got == [
        (288, 24, 1, 0, 0, 0),
        (216, 18, 0, 0, 0, 0),
        (0, 0, 0, 0, 0, 0),
        (0, 0, 0, 0, 0, 0),
        (-2, 0, 0, 0, 0, 0),
    ]


def test_dayparts_and_legacy(cases, source):
    def kept(name, legacy=False):
        flt = Filter(name, thresholds={}, legacy_dayparts=legacy)
        return ids(build_feature(cases, Feature(BF24, source, flt)))

    assert kept("Whl") == ["r1", "r2", "r3"]
    assert kept("Morning") == ["r2"]
    assert kept("Afternoon") == []
    assert kept("Evening") == ["r3"]
    assert kept("Night") == ["r1"]
    assert kept("Afternoon", legacy=True) == ["r2"]
    assert kept("Evening", legacy=True) == []


def test_custom_predicate(cases, source):
    flt = Filter("Late", thresholds={}, predicates={"Late": lambda dt: F.minute(dt) > 30})
    assert ids(build_feature(cases, Feature(BF24, source, flt))) == ["r3"]
    with pytest.raises(ValueError):
        build_feature(cases, Feature(BF24, source, Filter("Late", thresholds={})))


def test_thresholds(cases, source):
    def kept(**kw):
        return ids(build_feature(cases, Feature(BF24, source, Filter(**kw))))

    assert kept(thresholds={"DTInD": 2}) == ["r2", "r3"]
    assert kept(thresholds={"DTInD": 2, "DInCP": 2}) == []
    assert kept(thresholds={"RInCP": 3, "DTInD": 0}) == ["r1", "r2", "r3"]
    assert kept(thresholds={"RInDT": 1}) == ["r1", "r2", "r3"]
    assert kept(thresholds={"RInDT": 2}) == []
    assert kept(thresholds={"DTInD": 4}, share=0.5) == ["r2", "r3"]
    # The share of a part of the day is a quarter.
    assert kept(name="Evening", thresholds={"DTInD": 4}) == ["r3"]


def test_default_thresholds():
    assert Filter().rules_for("CGM5Min") == {"DTInD": 288 * 0.7}
    assert Filter("Night").rules_for("CGM5Min") == {"DTInD": 288 * 0.7 * 0.25}
    assert Filter().rules_for("Other") == {}


def test_calendar_tokens(cases, source):
    plan = Feature(BF24, source, Filter(), Tokens("Cal", calendar="Cal"))
    rows = {r.R: r for r in build_feature(cases, plan).collect()}
    assert rows["Recr3"].tkn_key == [
        "Year-2024", "Month-1", "Date-1", "MEAN-Evening", "Hour-23", "Min-56",
    ]
    assert rows["Recr3"].tkn_wgt == [1.0] * 6


def test_unknown_row(cases, source, tokens):
    rows = [r for r in build_feature(cases, Feature(BF24, source, Filter(), tokens)).collect() if r.case_id == "c2"]
    assert len(rows) == 1
    row = rows[0]
    assert (row.tkn_key, row.tkn_wgt) == (["UNK"], [1.0])
    assert [row[c] for c in ("CP", "M", "W", "D", "H", "5Min")] == [0] * 6
    assert row.dt is None and row.R is None


def test_grain_tables(spark, cases, source):
    first = spark.createDataFrame(
        [("p1", "r1", ["x"], [2.0]), ("p1", "r3", ["y", "z"], [1.0, 3.0])],
        "pid string, rec_id string, G1_key array<string>, G1_wgt array<double>",
    )
    mixed = Tokens("Mix", [GrainTable("G1", first), GrainColumn("Tok", lambda: F.array("token"))])
    rows = {r.R: r for r in build_feature(cases, Feature(BF24, source, Filter(), mixed)).collect()}
    assert (rows["Recr1"].tkn_key, rows["Recr1"].tkn_wgt) == (["x", "a"], [2.0, 1.0])
    assert (rows["Recr2"].tkn_key, rows["Recr2"].tkn_wgt) == (["a"], [1.0])
    assert rows["Recr3"].tkn_key == ["y", "z", "b"]


def test_number_ids(spark, cases, tokens):
    """Ids may stay numbers; stored grains are matched in the records' type."""
    rows = [(1, i, datetime(2024, 1, 1, 20 + i)) for i in range(3)]
    records = spark.createDataFrame(rows, "pid bigint, rec_id bigint, dt timestamp_ntz")
    grain = spark.createDataFrame(
        [("1", "2", ["x"], [1.0])], "pid string, rec_id string, G_key array<string>, G_wgt array<double>"
    )
    numbered = cases.withColumn("pid", F.lit(1).cast("bigint")).where("case_id = 'c1'")
    source = RecordSource("Rec", records, dt="dt", text_ids=False)
    plan = Feature(BF24, source, Filter(), Tokens("G", [GrainTable("G", grain)]))
    got = {r.R: r.tkn_key for r in build_feature(numbered, plan).collect()}
    assert got == {"Rec0": [], "Rec1": [], "Rec2": ["x"]}


def test_vocab(vocab):
    rows = {r.grn: r for r in vocab.df.collect()}
    assert [rows[t].idx for t in ("UNK", "a", "b", "Year-2024", "Month-1")] == [0, 1, 2, 3, 4]
    assert rows["Min-59"].idx == 2 + 1 + 12 + 31 + 4 + 24 + 60
    assert [rows[t].rfg_idx for t in ("Min-0", "a", "UNK")] == [0, 1, 2]
    more = {r.grn: r for r in vocab.extended(["5MinInD", "DInCP"]).df.collect()}
    assert more["DInCP"].idx == more["5MinInD"].idx + 1 == len(more) - 1
    assert [more[t].rfg_idx for t in ("5MinInD", "a", "UNK", "DInCP")] == [0, 3, 4, 2]


def test_vocab_conflicts(spark, tok_table):
    other = spark.createDataFrame([("b", "Other", 0), ("c", "Other", 1), ("c", "Other", 2)], tok_table.schema)
    rows = {r.grn: (r.idx, r.rfg) for r in build_vocab([tok_table, other]).df.collect()}
    assert rows == {"UNK": (0, "UNK"), "a": (1, "Tok"), "b": (2, "Tok"), "c": (3, "Other")}
    assert [(r.grn, r.rfgs) for r in vocab_conflicts([tok_table, other]).collect()] == [("b", ["Other", "Tok"])]


def test_vocab_on_disk(spark, vocab, tmp_path):
    for form in ("parquet", "json"):
        vocab.write(f"{tmp_path}/{form}", form)
        again = Vocabulary.read(spark, f"{tmp_path}/{form}", form=form)
        assert sorted(again.df.collect()) == sorted(vocab.df.collect())
        assert (again.size, again.special) == (vocab.size, vocab.special)


def test_salted_lookup(spark, vocab, monkeypatch):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("q", 3)], "grn string, n int")
    small = sorted(vocab.lookup(rows, "grn").select("n", "idx").collect())
    monkeypatch.setattr("casefeat.operators.vocab.MAX_BROADCAST_TOKENS", 0)
    salted = vocab.lookup(rows, "grn").select("n", "idx")
    assert sorted(salted.collect()) == small == [(1, 1), (2, 1), (3, None)]


def test_mean_step(cases, source, tokens):
    plan = feature(source, tokens, [rolled("5MinInD", "mean")])
    state, vocab = compressed(cases, plan)
    got = decoded(state, vocab)
    assert got[(0,)] == (["a", "b", "5MinInD"], [0.5, 0.5, 2.0])
    assert got[(1,)] == (["a", "5MinInD"], [1.0, 1.0])
    strict = feature(source, tokens, [rolled("5MinInD", "mean")], flt=Filter(thresholds={"DTInD": 2}))
    state, vocab = compressed(cases, strict)
    assert decoded(state, vocab) == {(0,): (["a", "b", "5MinInD"], [0.5, 0.5, 2.0])}


def test_unknown_case_is_compressed(cases, source, tokens):
    state, vocab = compressed(cases, feature(source, tokens, [rolled("5MinInD", "mean")]))
    rows = cmp.decoded(state, vocab).where("case_id = 'c2'").orderBy("pos").collect()
    assert [(r.token, r.weight) for r in rows] == [("UNK", 1.0), ("5MinInD", 1.0)]


def test_mean_of_means(cases, source, tokens):
    steps = [rolled("5MinInD", "mean"), rolled("DInCP", "mean")]
    state, vocab = compressed(cases, feature(source, tokens, steps, focal_layers=["CP"]))
    names, weights = decoded(state, vocab, ["CP"])[(0,)]
    assert dict(zip(names, weights)) == {"a": 0.75, "b": 0.25, "5MinInD": 1.5, "DInCP": 2.0}
    stay_flat = [
        Step("5MinInD", [("flatten",), ("method", "mean")]),
        Step("DInCP", [("method", "mean"), ("convert",)]),
    ]
    again, vocab = compressed(cases, feature(source, tokens, stay_flat, focal_layers=["CP"]))
    assert decoded(again, vocab, ["CP"])[(0,)] == (names, weights)


def test_cat_after_mean(cases, source, tokens):
    steps = [rolled("5MinInD", "mean"), Step("DInCP", [("method", "cat")])]
    state, vocab = compressed(cases, feature(source, tokens, steps, focal_layers=["CP"]))
    names, weights = decoded(state, vocab, ["CP"])[(0,)]
    assert names == ["a", "b", "5MinInD", "a", "5MinInD"]
    assert weights == [0.5, 0.5, 2.0, 1.0, 1.0]
    assert state.rows.where("case_id = 'c1'").first()["DInCP"] == 2


def test_cat_on_records_keeps_time_order(cases, source, tokens):
    steps = [Step("5MinInCP", [("add_sfx", ["5Min"]), ("method", "cat")])]
    state, vocab = compressed(cases, feature(source, tokens, steps, focal_layers=["CP"]))
    assert decoded(state, vocab, ["CP"])[(0,)] == (["a", "a", "b"], [1.0, 1.0, 1.0])
    assert state.rows.where("case_id = 'c1'").first()["tkn_5Min"] == [288, 216, 0]
    assert state.rows.where("case_id = 'c2'").first()["tkn_5Min"] == [0]


def test_suffixes(cases, source, tokens):
    sfx = ["rfg", "keyInrfg", "DInCP", "DInW"]
    plan = feature(source, tokens, [rolled("5MinInD", "mean", sfx)], focal_layers=["CP", "D"])
    rows = {r.D: r for r in build_feature(cases, plan).where("case_id = 'c1'").collect()}
    assert rows[0].keyInrfg == [0, 1, 0] and rows[1].keyInrfg == [0, 0]
    assert rows[0].rfgidx[0] == rows[0].rfgidx[1] != rows[0].rfgidx[2]
    assert rows[1].DInCP == [1, 1] and rows[1].DInW == [1, 1] and rows[0].DInW == [0, 0, 0]


def test_bucket_index(cases, source, tokens):
    plan = feature(source, tokens, [rolled("5MinInH", "mean", ["HInD"])], focal_layers=["CP", "D", "H"])
    rows = build_feature(cases, plan).where("case_id = 'c1'").collect()
    assert {(r.D, r.H): r.HInD[0] for r in rows} == {(0, 0): 0, (0, 18): 1, (1, 24): 0}
    # Before any roll-up, rows run from old to new.
    raw = feature(source, tokens, [Step("5MinInH", [("add_sfx", ["HInD"])])], focal_layers=["CP", "D", "H"])
    rows = build_feature(cases, raw).where("case_id = 'c1'").collect()
    assert {(r.D, r.H): r.HInD[0] for r in rows} == {(0, 18): 0, (0, 0): 1, (1, 24): 0}
    empty = build_feature(cases, raw).where("case_id = 'c2'").collect()
    assert [(r.keyidx, r.wgt, r.HInD) for r in empty] == [([0], [1.0], [0])]


def keyed(df):
    return df.withColumns({"pid": F.lit("p1"), "pred_dt": F.lit("2024-01-02").cast("timestamp_ntz")})


def token_state(spark, vocab, lists, level="D"):
    """Rows of one case with given (token, weight) lists, one bucket each."""
    rows = [
        ("c1", *[0] * 6, f"r{i}", [k for k, _ in row], [float(w) for _, w in row])
        for i, row in enumerate(lists)
    ]
    df = spark.createDataFrame(
        rows,
        "case_id string, CP bigint, M bigint, W bigint, D bigint, H bigint, `5Min` bigint,"
        " rec_id string, tkn_key array<string>, tkn_wgt array<double>",
    ).withColumn("dt", F.lit("2024-01-01").cast("timestamp_ntz"))
    return cmp.start(encode_tokens(keyed(df), vocab, "drop"), None, vocab)


def test_last_weight_of_a_repeated_token_counts(spark, vocab):
    state = cmp.convert(cmp.flatten(token_state(spark, vocab, [[("a", 1), ("b", 5), ("a", 3)]])))
    assert decoded(state, vocab)[(0,)] == (["a", "b"], [3.0, 5.0])


def test_only_positive_weights_are_listed(spark, vocab):
    v = vocab.extended(["5MinInD"])
    state = cmp.flatten(token_state(spark, v, [[("a", 2), ("b", -1)], [("a", -2), ("b", 5)]]))
    state = cmp.convert(cmp.roll_up(state, "5MinInD", cmp.METHODS["sum"], v))
    assert decoded(state, v)[(0,)] == (["b", "5MinInD"], [4.0, 2.0])


def test_rows_without_known_tokens_still_count(spark, vocab):
    v = vocab.extended(["5MinInD"])
    state = cmp.flatten(token_state(spark, v, [[("a", 1)], [("nowhere", 1)]]))
    state = cmp.convert(cmp.roll_up(state, "5MinInD", cmp.METHODS["mean"], v))
    assert decoded(state, v)[(0,)] == (["a", "5MinInD"], [0.5, 2.0])


@pytest.mark.parametrize(
    "weights, expected",
    [([2.0625], 2.062), ([0.619, 0.620], 0.620), ([0.294, 0.295], 0.294)],
)
def test_rounding_half_even(spark, vocab, weights, expected):
    v = vocab.extended(["5MinInH", "HInD"])
    # Each weight is its own first-level group by its hour.
    rows = [("c1", 0, 0, 0, 0, i, i, f"r{i}", ["a"], [w]) for i, w in enumerate(weights)]
    df = spark.createDataFrame(
        rows,
        "case_id string, CP bigint, M bigint, W bigint, D bigint, H bigint, `5Min` bigint,"
        " rec_id string, tkn_key array<string>, tkn_wgt array<double>",
    ).withColumn("dt", F.lit("2024-01-01").cast("timestamp_ntz"))
    state = cmp.start(encode_tokens(keyed(df), v), None, v)
    for rule in ("5MinInH", "HInD"):
        state = cmp.convert(cmp.roll_up(cmp.flatten(state), rule, cmp.METHODS["mean"], v))
    names, got = decoded(state, v)[(0,)]
    assert dict(zip(names, got))["a"] == expected


def test_custom_method_sees_absent_zeros(spark, vocab):
    v = vocab.extended(["5MinInD"])
    highest = cmp.Method(
        F.max, lambda value, present, rows: F.when(present < rows, F.greatest(value, F.lit(0.0))).otherwise(value)
    )
    lists = [[("a", -2), ("b", 3)], [("b", 5)]]
    state = cmp.roll_up(cmp.flatten(token_state(spark, v, lists)), "5MinInD", highest, v)
    assert dict(zip(*decoded(state, v)[(0,)])) == {"a": 0.0, "b": 5.0, "5MinInD": 2.0}


def test_custom_method_after_rounding_sees_natural_weights(spark, vocab):
    v = vocab.extended(["5MinInH", "HInD"])
    squares = cmp.Method(lambda w: F.sum(w * w))
    state = cmp.flatten(token_state(spark, v, [[("a", 1.5)], [("a", 0.5)]]))
    state = cmp.roll_up(state, "5MinInH", cmp.METHODS["sum"], v)
    state = cmp.roll_up(state, "HInD", squares, v)
    names, weights = decoded(state, v)[(0,)]
    assert dict(zip(names, weights)) == {"a": 4.0, "5MinInH": 4.0, "HInD": 1.0}


def test_unknown_tokens(spark, vocab):
    rows = spark.createDataFrame(
        [("r1", ["a", "q", "b"], [1.0, 2.0, 3.0]), ("r2", [], [])],
        "rec_id string, tkn_key array<string>, tkn_wgt array<double>",
    )

    def encoded(how):
        got = encode_tokens(rows, vocab, how).orderBy("rec_id").collect()
        return [[(t.idx, t.w) for t in r.tok] for r in got]

    assert encoded("drop") == [[(1, 1.0), (2, 3.0)], []]
    assert encoded("unk") == [[(1, 1.0), (0, 2.0), (2, 3.0)], []]
    with pytest.raises(Exception, match="token outside the vocabulary: q"):
        encoded("fail")


def test_wide(spark, vocab):
    state = cmp.flatten(token_state(spark, vocab, [[("a", 2)], [("b", 3)]]))
    state = cmp.roll_up(state, "5MinInD", cmp.METHODS["sum"], vocab.extended(["5MinInD"]))
    v = vocab.extended(["5MinInD"])
    row = cmp.wide(state, v, ["a", "b", "Min-0"]).first()
    assert (row.a, row.b, row["Min-0"]) == (2.0, 3.0, 0.0)


def test_nesting(cases, source, tokens):
    plan = feature(
        source, tokens, [rolled("5MinInH", "mean", ["rfg"])], prefix_layers=["CP", "D"], focal_layers=["H"]
    )
    rows = {r.case_id: r for r in build_feature(cases, plan).collect()}
    # D=0: H=0 has b, H=18 has a; D=1: H=24 has a. Each with its row count.
    count = rows["c1"].keyidx[0][0][1]
    assert rows["c1"].keyidx == [[[2, count], [1, count]], [[1, count]]]
    assert rows["c1"].wgt == [[[1.0, 1.0], [1.0, 1.0]], [[1.0, 1.0]]]
    assert rows["c2"].keyidx == [[[0, count]]]


def test_features_side_by_side(cases, source, tokens):
    first = feature(source, tokens, [rolled("5MinInD", "mean")])
    plain = Feature(AF2, source, Filter())
    rows = {r.case_id: r for r in build_features(cases, [first, plain]).collect()}
    assert [x.D for x in rows["c1"][first.name]] == [0, 1]
    assert [x.rec_id for x in rows["c1"][plain.name]] == ["r4", "r5"]
    assert rows["c2"][plain.name] is None and len(rows["c2"][first.name]) == 1
    with pytest.raises(ValueError, match="share a name"):
        build_features(cases, [first, first])


def test_names(source, tokens):
    steps = [rolled("5MinInD", "mean"), rolled("DInCP", "sum")]
    plan = feature(source, tokens, steps, prefix_layers=["CP"], focal_layers=[])
    assert plan.name == "Bf24H.Rec.Whl.CP-CP:sum-D:mean-RofRec-Tok"
    other = feature(source, tokens, steps, flt=Filter(thresholds={"DTInD": 2}), prefix_layers=["CP"], focal_layers=[])
    assert other.name == plan.name and other.config_hash != plan.config_hash


@pytest.mark.parametrize(
    "steps, layers",
    [
        ([Step("5MinInD", [("method", "mean")])], ["CP"]),
        ([Step("5MinInD", [("flatten",), ("method", "mean")])], ["CP"]),
        ([rolled("5MinInD", "mean"), rolled("HInH", "mean")], ["CP"]),
        ([rolled("5MinInD", "mean", ["keyInrfg"])], ["CP"]),
        ([rolled("5MinInD", "mean", ["HInD"])], ["CP"]),
        ([rolled("5MinInD", "mean")], ["D"]),
        ([rolled("5MinInD", "mean")], ["CP", "H"]),
        ([Step("5MinInD", [("convert",)])], ["CP"]),
        ([Step("5MinInD", [("shuffle",)])], ["CP"]),
    ],
)
def test_bad_programs(steps, layers):
    with pytest.raises(ValueError):
        Compress(steps, focal_layers=layers)


def test_stages_must_be_in_order(source, tokens):
    with pytest.raises(ValueError):
        Feature(BF24, source, None, tokens)
    with pytest.raises(ValueError):
        Feature(BF24, source, Filter(), Tokens("T", calendar="C"), Compress([rolled("5MinInD", "mean")]))


def test_unknown_method(cases, source, tokens):
    with pytest.raises(ValueError, match="unknown compress method"):
        build_feature(cases, feature(source, tokens, [rolled("5MinInD", "mode")]))
