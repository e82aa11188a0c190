"""SQL twins of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000

CASES = """cases AS (
  SELECT min(event_id) AS case_id, CAST(user_id AS VARCHAR) AS pid, ts AS pred_dt
  FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)"""

EV = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS pid, event_id AS rec_id, ts AS dt, event_type, value FROM events)"""

DAYPART = """CASE WHEN hour(dt) < 6 THEN 'Night' WHEN hour(dt) < 12 THEN 'Morning'
  WHEN hour(dt) < 18 THEN 'Afternoon' ELSE 'Evening' END"""

REL = """CAST(0 AS BIGINT) AS rel_cp,
  date_diff('microsecond', dt, pred_dt) // 300000000 // 12 // 24 // 7 // 4 AS rel_m,
  date_diff('microsecond', dt, pred_dt) // 300000000 // 12 // 24 // 7 AS rel_w,
  date_diff('microsecond', dt, pred_dt) // 300000000 // 12 // 24 AS rel_d,
  date_diff('microsecond', dt, pred_dt) // 300000000 // 12 AS rel_h,
  date_diff('microsecond', dt, pred_dt) // 300000000 AS rel_5min"""

VALUE_TOKEN = "'value-' || CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR)"


def obs(start_us: int, end_us: int, cases: str = "cases", records: str = "ev") -> str:
    """Windowed records per case, with relative times."""
    return f"""obs AS (
  SELECT *, {REL} FROM (
    SELECT c.case_id, c.pid, c.pred_dt, r.* EXCLUDE (pid)
    FROM {cases} c JOIN {records} r ON c.pid = r.pid
     AND r.dt >= c.pred_dt + to_microseconds({start_us}) AND r.dt < c.pred_dt + to_microseconds({end_us})))"""


BF24H = obs(-DAY_US, 0)
BF7D = obs(-7 * DAY_US, 0)
AF2H = obs(0, 2 * HOUR_US)

# Rows of days with at least three distinct times.
FULL_DAYS = """kept AS (
  SELECT * FROM obs SEMI JOIN (
    SELECT case_id, rel_d FROM obs GROUP BY 1, 2 HAVING count(DISTINCT dt) >= 3) USING (case_id, rel_d))"""
WHOLE = "kept AS (SELECT * FROM obs)"

EVENT_VOCAB = """SELECT 0 AS src, row_number() OVER (ORDER BY grn) - 1 AS pos, grn, 'EventGrn' AS rfg
  FROM (SELECT DISTINCT event_type AS grn FROM events)"""
VALUE_VOCAB = f"""SELECT 1 AS src, row_number() OVER (ORDER BY grn) - 1 AS pos, grn, 'ValueGrn' AS rfg
  FROM (SELECT DISTINCT {VALUE_TOKEN} AS grn FROM events)"""
MEAN_VOCAB = f"""SELECT 1 AS src, row_number() OVER (ORDER BY grn) - 1 AS pos, grn, 'MEANGrn' AS rfg
  FROM (SELECT DISTINCT 'MEAN-' || ({DAYPART.replace('dt', 'ts')}) AS grn FROM events)"""
CAL_VOCAB = """SELECT 2 AS src, block * 100 + i AS pos, grn, 'RDTCal' AS rfg FROM (
    SELECT 0 AS block, i, 'Year-' || i AS grn FROM (SELECT unnest(range((SELECT min(year(ts)) FROM events), (SELECT max(year(ts)) + 1 FROM events))) AS i)
    UNION ALL SELECT 30, i, 'Month-' || i FROM (SELECT unnest(range(1, 13)) AS i)
    UNION ALL SELECT 31, i, 'Date-' || i FROM (SELECT unnest(range(1, 32)) AS i)
    UNION ALL SELECT 32, i, 'MEAN-' || ['Night', 'Morning', 'Afternoon', 'Evening'][i + 1]
      FROM (SELECT unnest(range(0, 4)) AS i)
    UNION ALL SELECT 33, i, 'Hour-' || i FROM (SELECT unnest(range(0, 24)) AS i)
    UNION ALL SELECT 34, i, 'Min-' || i FROM (SELECT unnest(range(0, 60)) AS i))"""


def vocab(*grains: str, rules: tuple[str, ...] = ()) -> str:
    """``vocab(idx, grn, rfg, rfg_idx)`` of grains in order, then rules."""
    parts = ["SELECT -1 AS src, 0 AS pos, 'UNK' AS grn, 'UNK' AS rfg", *grains]
    parts += [f"SELECT 9, {i}, '{r}', '{r}'" for i, r in enumerate(rules)]
    return f"""vocab AS (
  SELECT row_number() OVER (ORDER BY src, pos) - 1 AS idx, grn, rfg, dense_rank() OVER (ORDER BY rfg) - 1 AS rfg_idx
  FROM ({' UNION ALL '.join(parts)}))"""


def short_vocab(*rules):
    return vocab(EVENT_VOCAB, MEAN_VOCAB, rules=rules)


def full_vocab(*rules):
    return vocab(EVENT_VOCAB, VALUE_VOCAB, CAL_VOCAB, rules=rules)


def toks(source: str, kind: str = "short", weighted: bool = False) -> str:
    """``toks``: one row per row of ``source`` and token, with list position."""
    value_weight = "value" if weighted else "1.0"
    lists = {"short": [("event_type", "1.0"), (f"'MEAN-' || ({DAYPART})", "1.0")]}
    lists["cal"] = [
        ("'Year-' || year(dt)", "1.0"), ("'Month-' || month(dt)", "1.0"), ("'Date-' || day(dt)", "1.0"),
        (f"'MEAN-' || ({DAYPART})", "1.0"), ("'Hour-' || hour(dt)", "1.0"), ("'Min-' || minute(dt)", "1.0"),
    ]
    lists["full"] = [("event_type", "1.0"), (VALUE_TOKEN, value_weight), *lists["cal"]]
    parts = [
        f"SELECT *, {i} AS pos, {token} AS token, CAST({weight} AS DOUBLE) AS w FROM {source}"
        for i, (token, weight) in enumerate(lists[kind])
    ]
    return f"toks AS ({' UNION ALL '.join(parts)})"


def rolled(name: str, rows: str, tokens: str, keys: str, rule: str, method: str, first: bool = True) -> str:
    """One compress step as ``name(case_id, keys, token, m)`` in thousandths.
    ``rows`` has one row per group member, ``tokens`` its weights."""
    by = f"case_id{', ' + keys if keys else ''}"
    if first:
        total = {"mean": "sum(w) * 1000.0 / any_value(n)", "sum": "sum(w) * 1000.0"}[method]
    else:
        total = {"mean": "sum(m) / any_value(n)", "sum": "sum(m) * 1.0"}[method]
    return f"""{name}_n AS (SELECT {by}, count(*) AS n FROM {rows} GROUP BY ALL),
{name} AS (
  SELECT {by}, token, CAST(round_even({total}, 0) AS BIGINT) AS m
  FROM {tokens} JOIN {name}_n USING ({by}) GROUP BY ALL
  UNION ALL SELECT {by}, '{rule}', n * 1000 FROM {name}_n)"""


def empties(of: str) -> str:
    return f"empty AS (SELECT case_id FROM cases ANTI JOIN {of} USING (case_id))"


def unk_tokens(rules: list[str], columns: str) -> str:
    """Rolled-up rows of the cases without records."""
    parts = [f"SELECT case_id{columns}, '{t}' AS token, CAST(1000 AS BIGINT) AS m FROM empty" for t in ["UNK", *rules]]
    return " UNION ALL ".join(parts)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


MEAN_DAY = [
    CASES, EV, BF7D, FULL_DAYS, toks("kept"),
    rolled("step", "kept", "toks", "rel_d", "5MinInD", "mean"), empties("kept"),
    f"""day AS (SELECT * FROM step WHERE m > 0 UNION ALL {unk_tokens(['5MinInD'], ', 0 AS rel_d')})""",
]
FULL_DAY = [
    CASES, EV, BF7D, FULL_DAYS, toks("kept", "full"),
    rolled("step", "kept", "toks", "rel_d", "5MinInD", "mean"), empties("kept"),
    f"""day AS (SELECT * FROM step WHERE m > 0 UNION ALL {unk_tokens(['5MinInD'], ', 0 AS rel_d')})""",
    full_vocab("5MinInD"),
    """ids AS (SELECT case_id, rel_d, idx, rfg_idx, m,
      row_number() OVER (PARTITION BY case_id, rel_d, rfg_idx ORDER BY idx) - 1 AS in_rfg
      FROM day JOIN vocab ON token = grn)""",
]


def listed(expr: str, order: str = "idx") -> str:
    return f"string_agg(CAST({expr} AS VARCHAR), ',' ORDER BY {order})"


def _count(start_us, end_us, cases="cases"):
    return f"""SELECT c.case_id, count(e.rec_id) AS rec_num FROM {cases} c LEFT JOIN ev e
  ON c.pid = e.pid AND e.dt >= c.pred_dt + to_microseconds({start_us})
 AND e.dt < c.pred_dt + to_microseconds({end_us}) GROUP BY 1"""


def _hash(key: str, seed: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}' || {key}), 1, 8) AS BIGINT)"


def _below(key: str, seed: str, ratio: float) -> str:
    return f"{_hash(key, seed)} < {round(ratio * 2**32)}"


OBS_COLUMNS = "SELECT case_id, pid, pred_dt, rec_id, dt, event_type, value FROM obs"
FILTER_COLUMNS = "SELECT case_id, pid, pred_dt, rec_id, dt"

CHAIN = """chain AS (
  SELECT c_custkey, o_orderkey, coalesce(l_linenumber, 'M' || o_orderkey) AS l_linenumber FROM (
    SELECT c_custkey, coalesce(o_orderkey, 'M' || c_custkey) AS o_orderkey, l_linenumber FROM (
      SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer)
    LEFT JOIN (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS c_custkey, CAST(o_orderkey AS VARCHAR) AS o_orderkey
      FROM orders) USING (c_custkey)
    LEFT JOIN (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS o_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber
      FROM lineitem) USING (o_orderkey)))"""

BEFORE_AFTER = f"""counts AS (
  SELECT c.case_id, any_value(c.pid) AS pid, any_value(c.pred_dt) AS pred_dt,
    count(*) FILTER (e.dt < c.pred_dt AND e.dt >= c.pred_dt - to_microseconds({DAY_US})) AS n_before,
    count(*) FILTER (e.dt > c.pred_dt AND e.dt < c.pred_dt + to_microseconds({DAY_US})) AS n_after
  FROM cases c JOIN ev e ON c.pid = e.pid GROUP BY 1)"""

# A case draws by entity and time.
CASE_DRAW = "(pid || '@' || epoch_us(pred_dt))"

SPLIT = f"""split AS (
  SELECT case_id, pid, CASE WHEN {_below('pid', 'split', 0.1)} THEN 'out_test'
    WHEN {_hash(CASE_DRAW, 'split')} < {round(0.1 * 2**32)} THEN 'in_test'
    WHEN {_hash(CASE_DRAW, 'split')} < {round(0.2 * 2**32)} THEN 'in_valid' ELSE 'in_train' END AS split
  FROM cases)"""


def _vocab_query(body: str) -> str:
    return with_(body) + "SELECT idx, grn, rfg, rfg_idx FROM vocab"


def _slots(token: str, n: int, window: str, fill: str, name: str, extra: tuple[str, ...] = ()) -> str:
    return with_(
        CASES, EV, window, *extra,
        f"""latest AS (SELECT case_id, abs(rel_5min) AS slot, arg_max({token}, dt) AS tkn FROM obs GROUP BY 1, 2)""",
    ) + f"""SELECT c.case_id, string_agg(coalesce(CAST(tkn AS VARCHAR), '{fill}'), ',' ORDER BY s.slot) AS {name}
FROM cases c CROSS JOIN (SELECT unnest(range(0, {n})) AS slot) s
LEFT JOIN latest l ON l.case_id = c.case_id AND l.slot = s.slot GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["trigger_cases"] = with_(CASES) + "SELECT * FROM cases"
    sql["entity_groups"] = """SELECT c_custkey, r_name, c_mktsegment,
  dense_rank() OVER (ORDER BY r_name, c_mktsegment) - 1 AS group_id
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""
    sql["id_chain_prefix"] = with_(CHAIN) + "SELECT * FROM chain"
    sql["level_alignment"] = with_(CHAIN) + """SELECT chain.*, o.o_totalprice FROM chain LEFT JOIN orders o
  ON chain.c_custkey = CAST(o.o_custkey AS VARCHAR) AND chain.o_orderkey = CAST(o.o_orderkey AS VARCHAR)"""
    sql["records_per_entity"] = """WITH placed AS (
  SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) - 1) AS pos
  FROM events)
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, coalesce(pos // 25, 0) AS chunk, count(event_id) AS n,
  coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY pos), '') AS ids
FROM customer LEFT JOIN placed ON user_id = c_custkey GROUP BY 1, 2"""
    sql["group_buckets"] = """SELECT c_custkey // 10 AS grp, count(DISTINCT c_custkey) AS n_entities,
  count(event_id) AS n_records FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1"""
    sql["group_pruned_read"] = """SELECT user_id // 4 AS grp, CAST(user_id AS VARCHAR) AS pid, event_id AS rec_id, ts AS dt, value
FROM events WHERE user_id // 4 IN (0, 2)"""
    sql["group_hash_totals"] = """SELECT CAST(user_id AS VARCHAR) AS pid, CAST(1 AS BIGINT) AS groups, count(*) AS n_records
FROM events GROUP BY 1"""
    sql["group_big_ids"] = """SELECT 9007199254740992 + user_id AS pid, (9007199254740992 + user_id) // 3 AS grp, count(*) AS n
FROM events GROUP BY 1, 2"""
    sql["union_groups"] = """SELECT CAST(user_id AS VARCHAR) AS pid, CAST(event_id AS VARCHAR) AS rec_id, ts AS dt,
  value, CAST(NULL AS DOUBLE) AS o_totalprice FROM events
UNION ALL SELECT CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), o_orderdate, NULL, o_totalprice FROM orders"""
    sql["check_periods"] = with_(CASES) + """SELECT case_id,
  pred_dt - INTERVAL 24 HOUR AS bf24h_start, pred_dt AS bf24h_end,
  pred_dt AS af2m10d_start, pred_dt + INTERVAL 66 DAY AS af2m10d_end,
  pred_dt - INTERVAL 36 HOUR AS mixed_start, pred_dt + INTERVAL 6 HOUR AS mixed_end FROM cases"""

    before_7d = with_(CASES, EV, BF7D) + OBS_COLUMNS
    before_24h = with_(CASES, EV, BF24H) + OBS_COLUMNS
    sql["observe_before_24h"] = before_24h
    sql["observe_after_2h"] = with_(CASES, EV, AF2H) + OBS_COLUMNS
    sql["observe_after_2h_excluding_trigger"] = with_(CASES, EV, AF2H) + OBS_COLUMNS + " WHERE dt > pred_dt"
    sql["observe_bucketed"] = before_7d
    sql["observe_hot_cells"] = before_7d
    sql["observe_surveyed"] = before_7d
    sql["observe_time_pruned"] = before_24h
    sql["observe_orders_before_2m"] = f"""WITH recs AS (
  SELECT CAST(o_custkey AS VARCHAR) AS pid, CAST(o_orderkey AS VARCHAR) AS rec_id, o_orderdate AS dt, o_totalprice FROM orders),
order_cases AS (SELECT pid, dt AS pred_dt, min(rec_id) AS case_id FROM recs GROUP BY 1, 2)
SELECT CAST(c.case_id AS BIGINT) AS case_id, c.pid, CAST(r.rec_id AS BIGINT) AS rec_id, r.dt, r.o_totalprice
FROM order_cases c JOIN recs r ON c.pid = r.pid
 AND r.dt >= c.pred_dt - to_microseconds({56 * DAY_US}) AND r.dt < c.pred_dt"""

    sql["recnum_before"] = with_(CASES, EV) + _count(-DAY_US, 0)
    sql["recnum_after"] = with_(CASES, EV) + _count(0, 2 * HOUR_US)
    sql["recnum_every_record"] = with_(
        EV, "every AS (SELECT min(rec_id) AS case_id, pid, dt AS pred_dt FROM ev GROUP BY pid, dt)"
    ) + _count(-DAY_US, 0, "every")
    sql["recnum_one_entity"] = """WITH moments AS (SELECT min(event_id) AS case_id, ts, count(*) AS n FROM events GROUP BY ts)
SELECT case_id, CAST(coalesce(sum(n) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING
  AND INTERVAL 1 MICROSECOND PRECEDING), 0) AS BIGINT) AS rec_num FROM moments"""
    sql["recnum_joined"] = with_(CASES, EV) + _count(-DAY_US, 0).replace("rec_num", "nrow")
    sql["relative_time"] = with_(CASES, EV, obs(-7 * DAY_US, 7 * DAY_US)) + """SELECT case_id, rec_id,
  rel_cp, rel_m, rel_w, rel_d, rel_h, rel_5min FROM obs"""

    def hours(condition):
        return with_(CASES, EV, BF7D) + f"{FILTER_COLUMNS} FROM obs WHERE {condition}"

    sql["daypart_morning"] = hours("hour(dt) BETWEEN 6 AND 11")
    sql["daypart_afternoon"] = hours("hour(dt) BETWEEN 12 AND 17")
    sql["value_predicate"] = with_(
        CASES, EV, BF7D, "high AS (SELECT * FROM obs WHERE value > 25)"
    ) + f"""{FILTER_COLUMNS} FROM high SEMI JOIN (SELECT case_id, rel_d FROM high GROUP BY 1, 2
  HAVING count(DISTINCT dt) >= 2) USING (case_id, rel_d)"""
    sql["daypart_evening"] = hours("hour(dt) BETWEEN 18 AND 23")
    sql["daypart_legacy"] = hours("hour(dt) BETWEEN 12 AND 17")
    sql["custom_predicate"] = hours("dayofweek(dt) IN (0, 6)")
    sql["threshold_dtind"] = with_(CASES, EV, BF7D, FULL_DAYS) + f"{FILTER_COLUMNS} FROM kept"
    sql["threshold_chain"] = with_(
        CASES, EV, BF7D,
        """first AS (SELECT * FROM obs SEMI JOIN (SELECT case_id, rel_d FROM obs GROUP BY 1, 2
  HAVING count(DISTINCT dt) >= 2) USING (case_id, rel_d))""",
        """second AS (SELECT * FROM first SEMI JOIN (SELECT case_id FROM first GROUP BY 1
  HAVING count(DISTINCT rel_d) >= 4) USING (case_id))""",
    ) + f"{FILTER_COLUMNS} FROM second"
    steps, before = [], "obs"
    for i, (source, target, need) in enumerate(
        [("dt", "rel_h", 2), ("rel_h", "rel_d", 2), ("rel_5min", "rel_w", 8), ("rel_d", "rel_cp", 2)]
    ):
        steps.append(
            f"""rule{i} AS (SELECT * FROM {before} SEMI JOIN (SELECT case_id, {target} FROM {before} GROUP BY 1, 2
  HAVING count(DISTINCT {source}) >= {need}) USING (case_id, {target}))"""
        )
        before = f"rule{i}"
    sql["threshold_cascade"] = with_(CASES, EV, BF7D, *steps) + f"{FILTER_COLUMNS} FROM {before}"
    sql["threshold_share"] = with_(
        CASES, EV, BF7D, "night AS (SELECT * FROM obs WHERE hour(dt) < 6)"
    ) + f"""{FILTER_COLUMNS} FROM night SEMI JOIN (SELECT case_id, rel_d FROM night GROUP BY 1, 2
  HAVING count(DISTINCT rel_h) >= 2) USING (case_id, rel_d)"""

    token_columns = "SELECT rec_id, CAST(pos AS BIGINT) AS pos, token, w AS weight FROM toks"
    sql["calendar_tokens"] = with_(EV, toks("ev", "cal")) + token_columns
    sql["concat_tokens"] = with_(EV, toks("ev", "full", weighted=True)) + token_columns
    sql["grain_tokens"] = with_(EV) + f"""SELECT rec_id, CAST(0 AS BIGINT) AS pos, event_type AS token,
  CAST(1 AS DOUBLE) AS weight FROM ev
UNION ALL SELECT rec_id, 1, {VALUE_TOKEN}, value FROM ev WHERE event_type = 'purchase'"""
    sql["grain_suffix_lists"] = with_(EV) + f"""SELECT rec_id, CAST(0 AS BIGINT) AS pos, event_type AS token,
  CAST(1 AS DOUBLE) AS weight, 'Type' AS rfg, CAST(0 AS BIGINT) AS in_rfg FROM ev WHERE event_type <> 'view'
UNION ALL SELECT rec_id, 1, {VALUE_TOKEN}, value, 'Amount', rec_id % 3 FROM ev WHERE event_type <> 'view'
UNION ALL SELECT rec_id, CASE WHEN event_type = 'view' THEN 0 ELSE 2 END, 'MEAN-' || ({DAYPART}), 1, 'MEANGrn', 0 FROM ev"""
    sql["n2c_tokens"] = """SELECT event_id, 'value-' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS token FROM events"""
    sql["token_rows_with_unk"] = with_(CASES, EV, BF24H, empties("obs")) + f"""
SELECT case_id, pid, rel_cp, rel_m, rel_w, rel_d, rel_h, rel_5min, dt, 'Events' || rec_id AS R,
  event_type || ',MEAN-' || ({DAYPART}) AS tokens, '1000,1000' AS weights FROM obs
UNION ALL SELECT case_id, pid, 0, 0, 0, 0, 0, 0, NULL, NULL, 'UNK', '1000' FROM empty JOIN cases USING (case_id)"""
    one_value = "'value-' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)"
    sql["one_tkn_in_5min"] = _slots(one_value, 289, BF24H, "UNK", "tkn")
    sql["one_tkn_in_5min_tknidx"] = _slots(
        f"(SELECT idx FROM vocab WHERE grn = {VALUE_TOKEN})", 24, AF2H, "0", "tknidx", (vocab(VALUE_VOCAB),)
    )

    sql["vocab_build"] = _vocab_query(full_vocab())
    sql["vocab_stored"] = sql["vocab_build"]
    sql["vocab_extend"] = _vocab_query(short_vocab("5MinInD", "DInCP"))
    sql["vocab_learn"] = with_(CASES, EV, BF24H, toks("obs", "full")) + """SELECT grn, 'All' AS rfg,
  row_number() OVER (ORDER BY grn) - 1 AS pos FROM (SELECT DISTINCT token AS grn FROM toks)"""
    sql["vocab_conflict_report"] = f"""SELECT grn, string_agg(rfg, ',' ORDER BY rfg) AS rfgs FROM (
  SELECT DISTINCT event_type AS grn, 'TypeGrn' AS rfg FROM events
  UNION SELECT event_type, 'MergedGrn' FROM events UNION SELECT {VALUE_TOKEN}, 'MergedGrn' FROM events
  UNION SELECT o_orderpriority, 'PriorityGrn' FROM orders) GROUP BY 1 HAVING count(*) > 1"""

    sql["compress_mean_day"] = with_(*MEAN_DAY) + "SELECT case_id, rel_d, token, m / 1000.0 AS weight FROM day"
    sql["compress_sum_hour"] = with_(
        CASES, EV, BF7D, FULL_DAYS, toks("kept", "full", weighted=True),
        rolled("step", "kept", "toks", "rel_h", "5MinInH", "sum"), empties("kept"),
    ) + f"""SELECT case_id, rel_h, token, m / 1000.0 AS weight FROM (
  SELECT * FROM step WHERE m > 0 UNION ALL {unk_tokens(['5MinInH'], ', 0 AS rel_h')})"""
    sql["compress_two_level"] = with_(
        CASES, EV, BF7D, FULL_DAYS, toks("kept", "full"),
        rolled("step", "kept", "toks", "rel_d", "5MinInD", "mean"), empties("kept"),
        "days AS (SELECT DISTINCT case_id, rel_d FROM kept)",
        rolled("top", "days", "step", "", "DInCP", "mean", first=False),
    ) + f"""SELECT case_id, token, m / 1000.0 AS weight FROM (
  SELECT * FROM top WHERE m > 0 UNION ALL {unk_tokens(['5MinInD', 'DInCP'], '')})"""
    sql["compress_flat_chain"] = with_(
        CASES, EV, BF7D, WHOLE, toks("kept"),
        rolled("step", "kept", "toks", "rel_w, rel_h", "5MinInH", "sum"), empties("kept"),
        "hours AS (SELECT DISTINCT case_id, rel_w, rel_h FROM kept)",
        rolled("top", "hours", "step", "rel_w", "HInW", "mean", first=False),
    ) + f"""SELECT case_id, rel_w, token, m / 1000.0 AS weight FROM (
  SELECT * FROM top WHERE m > 0 UNION ALL {unk_tokens(['5MinInH', 'HInW'], ', 0 AS rel_w')})"""
    sql["compress_cat"] = with_(CASES, EV, BF7D, FULL_DAYS, toks("kept"), empties("kept")) + """
SELECT case_id, rel_d, count(*) FILTER (pos = 0) OVER (PARTITION BY case_id, rel_d) AS n_rows,
  row_number() OVER (PARTITION BY case_id, rel_d ORDER BY dt, pos) - 1 AS pos, token, w AS weight FROM toks
UNION ALL SELECT case_id, 0, 1, 0, 'UNK', 1.0 FROM empty"""
    sql["compress_cat_rows"] = with_(CASES, EV, BF7D, FULL_DAYS, toks("kept"), empties("kept")) + """
SELECT case_id, rel_d, row_number() OVER (PARTITION BY case_id, rel_d ORDER BY dt, pos) - 1 AS pos, token, w AS weight
FROM toks UNION ALL SELECT case_id, 0, 0, 'UNK', 1.0 FROM empty"""
    sql["compress_cat_flat"] = with_(
        CASES, EV, BF7D, FULL_DAYS, toks("kept"), empties("kept"),
        "step_n AS (SELECT case_id, rel_d, count(*) AS n FROM kept GROUP BY ALL)",
    ) + """SELECT case_id, rel_d, token, sum(w) AS weight FROM toks GROUP BY ALL
UNION ALL SELECT case_id, rel_d, '5MinInD', CAST(n AS DOUBLE) FROM step_n
UNION ALL SELECT case_id, 0, 'UNK', 1.0 FROM empty UNION ALL SELECT case_id, 0, '5MinInD', 1.0 FROM empty"""
    def mean_day(cases=CASES, ev=EV, window=BF7D, keep=FULL_DAYS, method="mean", kind="short"):
        return with_(
            cases, ev, window, keep, toks("kept", kind),
            rolled("step", "kept", "toks", "rel_d", "5MinInD", method), empties("kept"),
            f"day AS (SELECT * FROM step WHERE m > 0 UNION ALL {unk_tokens(['5MinInD'], ', 0 AS rel_d')})",
        ) + "SELECT case_id, rel_d, token, m / 1000.0 AS weight FROM day"

    few = """ev AS (SELECT CAST(user_id AS VARCHAR) AS pid, event_id AS rec_id, ts AS dt,
  CASE WHEN event_type = 'view' THEN 'UNK' ELSE event_type END AS event_type, value FROM events)"""
    sql["compress_unknown"] = mean_day(ev=few)
    twice = """ev AS (SELECT CAST(user_id AS VARCHAR) AS pid, event_id AS rec_id, ts AS dt, event_type, value FROM events
  UNION ALL SELECT CAST(user_id AS VARCHAR), event_id, ts, 'view', 1.0 FROM events)"""
    sql["repeated_records_single"] = mean_day(ev=twice, keep=WHOLE)
    sql["repeated_records_array"] = sql["repeated_records_single"]
    later = "(SELECT * REPLACE (ts + INTERVAL 3 YEAR AS ts) FROM events)"
    dated = toks("kept", "full").split(" UNION ALL ")
    dated = "toks AS (" + " UNION ALL ".join(p.removeprefix("toks AS (") for i, p in enumerate(dated) if i != 1)
    sql["compress_later_years"] = mean_day(
        CASES.replace("FROM events", f"FROM {later}"), EV.replace("FROM events", f"FROM {later}"), kind="full"
    ).replace(toks("kept", "full"), dated)
    one = [CASES.replace("CAST(user_id AS VARCHAR) AS pid", "'all' AS pid").replace("GROUP BY user_id, ts", "GROUP BY ts"),
           EV.replace("CAST(user_id AS VARCHAR) AS pid", "'all' AS pid")]
    sql["compress_crowded_entity"] = mean_day(*one, BF24H, WHOLE, "sum")

    # Events numbered inside each entity; cases are told apart by all of
    # (number, entity, time), so the twins join and group by the pair.
    local = """numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM events)"""
    local_cases = """cases AS (SELECT min(number) AS local_id, CAST(user_id AS VARCHAR) || '@' || ts AS case_id,
  CAST(user_id AS VARCHAR) AS pid, ts AS pred_dt FROM numbered WHERE event_type = 'purchase' GROUP BY user_id, ts)"""
    sql["local_ids_cases"] = with_(local, local_cases) + "SELECT local_id AS case_id, pid, pred_dt FROM cases"
    sql["local_ids_recnum"] = with_(local, local_cases, EV) + f"""SELECT local_id AS case_id, pid, pred_dt, rec_num
FROM cases JOIN ({_count(-DAY_US, 0)}) USING (case_id)"""
    sql["local_ids_feature"] = mean_day(f"{local},\n{local_cases}").replace(
        "SELECT case_id, rel_d, token, m / 1000.0 AS weight FROM day",
        "SELECT local_id AS case_id, pid, pred_dt, rel_d, token, m / 1000.0 AS weight FROM day JOIN cases USING (case_id)",
    )
    sql["local_ids_store"] = with_(local, local_cases, EV) + f"""SELECT local_id AS case_id, pid, pred_dt,
  CASE WHEN CAST(pid AS BIGINT) % 2 = 0 THEN rec_num ELSE -1 END AS nrow,
  CASE WHEN CAST(pid AS BIGINT) % 2 = 1 THEN 'miss' WHEN rec_num = 0 THEN 'empty' ELSE 'hit' END AS status
FROM cases JOIN ({_count(-DAY_US, 0)}) USING (case_id)"""
    sql["local_ids_downsample"] = with_(local, local_cases) + f"""SELECT local_id AS case_id, pid, pred_dt FROM cases
WHERE {_below(CASE_DRAW, 'downsample', 0.1)}"""
    sql["local_ids_split"] = with_(local, local_cases, SPLIT.replace("SELECT case_id, pid,", "SELECT local_id AS case_id, pid, pred_dt,", 1)) + "SELECT * FROM split"
    sql["local_ids_batches"] = with_(
        local, local_cases,
        f"""placed AS (SELECT *, row_number() OVER (ORDER BY {_hash(CASE_DRAW, 'batch')} % 1024, local_id, pid, pred_dt) - 1 AS row_no
  FROM cases)""",
    ) + "SELECT row_no // 500 AS batch, row_no, local_id AS case_id, pid, pred_dt FROM placed"
    before, after = (
        f"""SELECT c.case_id, max_by(e.{{v}}, (e.dt, -e.rec_id)) AS v, max(e.dt) AS dt FROM cases c JOIN ev e ON c.pid = e.pid
 AND e.dt >= c.pred_dt - to_microseconds({7 * DAY_US}) AND e.dt < c.pred_dt GROUP BY 1""".format(v="value"),
        f"""SELECT c.case_id, min_by(e.value, (e.dt, e.rec_id)) AS v, min(e.dt) AS dt FROM cases c JOIN ev e ON c.pid = e.pid
 AND e.dt > c.pred_dt AND e.dt < c.pred_dt + to_microseconds({DAY_US}) GROUP BY 1""",
    )
    # The id as text decides between records of one instant.
    before = before.replace("(e.dt, -e.rec_id)", "{'dt': e.dt, 'n': -rank}").replace("JOIN ev e", "JOIN ranked e")
    after = after.replace("(e.dt, e.rec_id)", "{'dt': e.dt, 'n': rank}").replace("JOIN ev e", "JOIN ranked e")
    ranked = "ranked AS (SELECT *, row_number() OVER (ORDER BY CAST(rec_id AS VARCHAR)) AS rank FROM ev)"
    sql["nearest_values"] = with_(CASES, EV, ranked) + f"""SELECT c.case_id, c.pid, c.pred_dt, b.dt AS before_dt, b.v AS before_value,
  a.dt AS after_dt, a.v AS after_value
FROM cases c LEFT JOIN ({before}) b USING (case_id) LEFT JOIN ({after}) a USING (case_id)"""
    sql["case_function_change"] = with_(CASES, EV, ranked) + f"""SELECT c.case_id, c.pid, c.pred_dt,
  a.v - b.v AS change, coalesce(n.rec_num, 0) AS n_before, a.v / (1 + abs(c_acctbal)) AS relative
FROM cases c LEFT JOIN ({before}) b USING (case_id) LEFT JOIN ({after}) a USING (case_id)
LEFT JOIN ({_count(-DAY_US, 0)}) n USING (case_id) LEFT JOIN customer ON c.pid = CAST(c_custkey AS VARCHAR)"""
    sql["observe_windows"] = with_(CASES, EV) + f"""SELECT c.case_id, c.pid, c.pred_dt, e.rec_id, e.dt,
  CAST(CASE WHEN e.dt < c.pred_dt THEN 1 ELSE 0 END + CASE WHEN e.dt < c.pred_dt AND e.dt >= c.pred_dt - to_microseconds({DAY_US}) THEN 2 ELSE 0 END
    + CASE WHEN e.dt >= c.pred_dt AND e.dt < c.pred_dt + to_microseconds({2 * HOUR_US}) THEN 4 ELSE 0 END
    + CASE WHEN e.dt >= c.pred_dt + to_microseconds({240 * HOUR_US}) THEN 8 ELSE 0 END AS BIGINT) AS windows
FROM cases c JOIN ev e ON c.pid = e.pid AND e.dt >= c.pred_dt - to_microseconds({7 * DAY_US})
  AND (e.dt < c.pred_dt + to_microseconds({2 * HOUR_US}) OR e.dt >= c.pred_dt + to_microseconds({240 * HOUR_US}))
  AND e.dt < c.pred_dt + to_microseconds({264 * HOUR_US})"""
    sql["compress_custom_max"] = with_(
        CASES, EV, BF7D, FULL_DAYS, toks("kept", "full", weighted=True), empties("kept"),
        "step_n AS (SELECT case_id, rel_d, count(*) AS n FROM kept GROUP BY ALL)",
    ) + """SELECT * FROM (
  SELECT case_id, rel_d, token, CASE WHEN count(*) < any_value(n) THEN greatest(max(w), 0) ELSE max(w) END AS weight
  FROM toks JOIN step_n USING (case_id, rel_d) GROUP BY ALL) WHERE weight > 0
UNION ALL SELECT case_id, rel_d, '5MinInD', CAST(n AS DOUBLE) FROM step_n
UNION ALL SELECT case_id, 0, 'UNK', 1.0 FROM empty UNION ALL SELECT case_id, 0, '5MinInD', 1.0 FROM empty"""
    for name, q in (("compress_custom_median", 0.5), ("compress_custom_quantile", 0.9)):
        sql[name] = with_(
            CASES, EV, BF7D, FULL_DAYS, toks("kept", "full", weighted=True), empties("kept"),
            "step_n AS (SELECT case_id, rel_d, count(*) AS n FROM kept GROUP BY ALL)",
            f"""lists AS (SELECT case_id, rel_d, token, CAST({q} AS DOUBLE) * (any_value(n) - 1) AS place, list_sort(list_concat(
  list(CAST(w AS DOUBLE)), list_transform(range(any_value(n) - count(*)), lambda i: CAST(0 AS DOUBLE)))) AS l
  FROM toks JOIN step_n USING (case_id, rel_d) GROUP BY ALL)""",
            """ends AS (SELECT case_id, rel_d, token, place - floor(place) AS part,
  l[CAST(floor(place) AS BIGINT) + 1] AS low, l[CAST(ceil(place) AS BIGINT) + 1] AS high FROM lists)""",
        ) + """SELECT case_id, rel_d, token, low + (high - low) * part AS weight FROM ends WHERE low + (high - low) * part > 0
UNION ALL SELECT case_id, rel_d, '5MinInD', CAST(n AS DOUBLE) FROM step_n
UNION ALL SELECT case_id, 0, 'UNK', 1.0 FROM empty UNION ALL SELECT case_id, 0, '5MinInD', 1.0 FROM empty"""
    names = {
        "unk": "UNK", "click": "click", "error": "error", "purchase": "purchase", "signup": "signup",
        "view": "view", "mean_night": "MEAN-Night", "n_rows": "5MinInD",
    }
    columns = ", ".join(f"coalesce(max(m) FILTER (token = '{t}'), 0) / 1000.0 AS {c}" for c, t in names.items())
    sql["flatten_wide"] = with_(*MEAN_DAY) + f"SELECT case_id, rel_d, {columns} FROM day GROUP BY 1, 2"
    every = ["UNK", "click", "error", "purchase", "signup", "view", "MEAN-Afternoon", "MEAN-Evening", "MEAN-Morning", "MEAN-Night", "5MinInD"]
    columns = ", ".join(
        f"coalesce(max(m) FILTER (token = '{t}'), 0) / 1000.0 AS {t.lower().replace('-', '_').replace('5minind', 'n_rows')}"
        for t in every
    )
    sql["flatten_wide_all"] = with_(*MEAN_DAY) + f"SELECT case_id, rel_d, {columns} FROM day GROUP BY 1, 2"
    sql["relist_tokens"] = with_(*MEAN_DAY, short_vocab("5MinInD")) + f"""SELECT case_id, rel_d,
  {listed('token')} AS keys, {listed('m')} AS weights FROM day JOIN vocab ON token = grn GROUP BY 1, 2"""

    def by_day(expr):
        return with_(*FULL_DAY) + f"SELECT case_id, rel_d, {expr} FROM ids GROUP BY 1, 2"

    sql["suffix_rfg"] = by_day(f"{listed('rfg_idx')} AS rfgidx")
    sql["suffix_key_in_rfg"] = by_day(f"{listed('in_rfg')} AS key_in_rfg")
    sql["suffix_d_in_cp"] = by_day(f"{listed('rel_d')} AS d_in_cp")
    sql["suffix_h_in_d"] = with_(
        CASES, EV, BF7D, FULL_DAYS, toks("kept", "full"), empties("kept"),
        """sizes AS (SELECT case_id, rel_d, rel_h, count(DISTINCT token) + 1 AS size FROM toks GROUP BY ALL
  UNION ALL SELECT case_id, 0, 0, 2 FROM empty)""",
        """ranked AS (SELECT *, dense_rank() OVER (PARTITION BY case_id, rel_d ORDER BY rel_h) - 1 AS i FROM sizes)""",
    ) + """SELECT case_id, rel_d, rel_h, rtrim(repeat(CAST(i AS VARCHAR) || ',', size), ',') AS h_in_d FROM ranked"""
    sql["encode_ids"] = with_(*FULL_DAY) + f"""SELECT case_id, any_value(pid) AS pid, any_value(pred_dt) AS pred_dt, rel_d,
  {listed('idx')} AS keyidx, {listed('m')} AS wgt, {listed('rfg_idx')} AS rfgidx
FROM ids JOIN cases USING (case_id) GROUP BY case_id, rel_d"""
    sql["nested_layers"] = with_(
        CASES, EV, BF7D, FULL_DAYS, toks("kept"),
        rolled("step", "kept", "toks", "rel_d, rel_h", "5MinInH", "mean"), empties("kept"),
        f"""hour_tokens AS (SELECT * FROM step WHERE m > 0
  UNION ALL {unk_tokens(['5MinInH'], ', 0 AS rel_d, 0 AS rel_h')})""",
        short_vocab("5MinInH"),
        f"""hours AS (SELECT case_id, rel_d, rel_h, {listed('idx')} AS k, {listed('m')} AS m
  FROM hour_tokens JOIN vocab ON token = grn GROUP BY 1, 2, 3)""",
        """days AS (SELECT case_id, rel_d, '[' || string_agg(k, ';' ORDER BY rel_h) || ']' AS k,
  '[' || string_agg(m, ';' ORDER BY rel_h) || ']' AS m FROM hours GROUP BY 1, 2)""",
    ) + """SELECT case_id, any_value(pid) AS pid, any_value(pred_dt) AS pred_dt,
  '[' || string_agg(k, ';' ORDER BY rel_d) || ']' AS keyidx, '[' || string_agg(m, ';' ORDER BY rel_d) || ']' AS wgt
FROM days JOIN cases USING (case_id) GROUP BY case_id"""

    sql["multi_feature"] = with_(
        *MEAN_DAY, short_vocab("5MinInD"),
        f"""day_lists AS (SELECT case_id, rel_d, {listed('idx')} AS k, {listed('m')} AS m
  FROM day JOIN vocab ON token = grn GROUP BY 1, 2)""",
        """days_before AS (SELECT case_id, string_agg(rel_d || ':' || k || ':' || m, ';' ORDER BY rel_d) AS t
  FROM day_lists GROUP BY 1)""",
        obs(1, DAY_US).replace("obs AS", "obs_after AS", 1),
        toks("obs_after").replace("toks AS", "after_toks AS", 1),
        rolled("after_step", "obs_after", "after_toks", "", "5MinInCP", "sum"),
        """after_empty AS (SELECT case_id FROM cases ANTI JOIN obs_after USING (case_id))""",
        short_vocab("5MinInCP").replace("vocab AS", "after_vocab AS", 1),
        f"""after_lists AS (SELECT case_id, {listed('idx')} || ':' || {listed('m')} AS t FROM (
    SELECT * FROM after_step WHERE m > 0
    UNION ALL {unk_tokens(['5MinInCP'], '').replace('FROM empty', 'FROM after_empty')})
  JOIN after_vocab ON token = grn GROUP BY 1)""",
        BF24H.replace("obs AS", "obs_24h AS", 1),
        """mornings AS (SELECT case_id, string_agg(CAST(rec_id AS VARCHAR), ';' ORDER BY dt) AS t FROM obs_24h
  WHERE hour(dt) BETWEEN 6 AND 11 GROUP BY 1)""",
    ) + """SELECT case_id, pid, pred_dt, d.t AS days_before, a.t AS after, coalesce(m.t, '') AS mornings
FROM cases JOIN days_before d USING (case_id) JOIN after_lists a USING (case_id) LEFT JOIN mornings m USING (case_id)"""

    sql["store_incremental"] = with_(*MEAN_DAY, short_vocab("5MinInD")) + f"""SELECT case_id, any_value(pid) AS pid,
  any_value(pred_dt) AS pred_dt, rel_d, {listed('idx')} AS keyidx, {listed('m')} AS wgt
FROM day JOIN vocab ON token = grn JOIN cases USING (case_id) GROUP BY case_id, rel_d"""
    sql["store_two_sources"] = with_(CASES, EV, BF24H) + f"{FILTER_COLUMNS} FROM obs WHERE event_type = 'error'"
    for name in ("grown_vocabulary", "other_groups", "raced", "compacted", "compacted_meanwhile", "stage_reuse", "from_observation", "from_records", "all_stages"):
        sql[f"store_{name}"] = sql["store_incremental"]
    last = "WHERE case_id IN (SELECT case_id FROM cases ORDER BY case_id DESC LIMIT 10) GROUP BY"
    sql["store_lookup"] = last.join(sql["store_incremental"].rsplit("GROUP BY", 1))
    sql["store_size"] = with_(CASES, EV) + f"""SELECT count(*) AS n_cases, CAST(sum(n) AS BIGINT) AS n_rows FROM (
  SELECT c.case_id, count(e.rec_id) AS n FROM cases c LEFT JOIN ev e ON c.pid = e.pid
    AND e.dt >= c.pred_dt - to_microseconds({DAY_US}) AND e.dt < c.pred_dt
  WHERE c.pred_dt < TIMESTAMP '2024-01-16' GROUP BY 1)"""
    sql["store_status"] = with_(CASES, EV) + f"""SELECT case_id, CASE WHEN early THEN n ELSE -1 END AS nrow,
  CASE WHEN NOT early THEN 'miss' WHEN n = 0 THEN 'empty' ELSE 'hit' END AS status FROM (
  SELECT c.case_id, c.pred_dt < TIMESTAMP '2024-01-16' AS early, count(e.rec_id) AS n FROM cases c LEFT JOIN ev e
    ON c.pid = e.pid AND e.dt >= c.pred_dt - to_microseconds({DAY_US}) AND e.dt < c.pred_dt GROUP BY 1, 2)"""
    sql["store_json"] = with_(*FULL_DAY) + f"""SELECT case_id, rel_d, any_value(pred_dt) AS pred_dt,
  any_value(strftime(pred_dt, '%Y-%m-%d %H:%M:%S.%f')) AS pred_dt_text,
  {listed('idx')} AS keyidx, '[' || {listed('rfg_idx')} || ']' AS rfgidx_json
FROM ids JOIN cases USING (case_id) GROUP BY case_id, rel_d"""

    sql["case_filter_dev"] = with_(CASES, EV, BEFORE_AFTER) + """SELECT case_id, pid, pred_dt FROM counts
WHERE n_before > 0 AND n_after > 0"""
    sql["case_filter_sftflt"] = with_(CASES, EV, BEFORE_AFTER) + """SELECT case_id, pid, pred_dt FROM counts
WHERE n_before >= 2 AND n_after >= 3"""
    sql["downsample"] = with_(CASES) + f"SELECT case_id, pid FROM cases WHERE {_below(CASE_DRAW, 'downsample', 0.1)}"
    sql["split_sets"] = with_(CASES, SPLIT) + "SELECT case_id, pid, split FROM split"
    tagged = "SELECT case_id, pid, split FROM split JOIN customer ON pid = CAST(c_custkey AS VARCHAR) WHERE "
    sql["set_selector"] = with_(CASES, SPLIT) + tagged + """split = 'in_train'
  AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0"""
    sql["set_selector_out_whole"] = with_(CASES, SPLIT) + tagged + "split LIKE 'out_%' AND c_acctbal >= 0"
    sql["batch_export"] = with_(
        CASES,
        f"""numbered AS (SELECT *, row_number() OVER (ORDER BY {_hash(CASE_DRAW, 'batch')} % 1024,
  case_id) - 1 AS row_no FROM cases)""",
    ) + "SELECT row_no // 500 AS batch, row_no % 500 AS pos, row_no, case_id, pred_dt FROM numbered"
    return sql
