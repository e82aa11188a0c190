"""Filter audit: streamed counters against a plain version."""

import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from compare import difference, duck
from helpers import SF_DIR, DOC_SCHEMA, sent, words  # noqa: F401

import __spark_entry__ as entry
from casefeat.llm import audit as A
from casefeat.session import scratch_folder

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def fails(text):
    w = split(text)
    out = {"A"} if len(w) < 200 else set()
    out |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
    out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else set()
    return out | ({"D"} if set(text) & set("#$%&*|") else set())


def expected(rows, labels):
    """Every order replayed document by document."""
    first = {}
    for doc_id, text, source in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for doc_id, text, source in rows:
        bad = fails(text or "")
        if doc_id is not None and first[text or ""] < doc_id:
            bad.add("E")
        parts[source or ""].append((doc_id, bad))
    out, shapley = {}, Counter()
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            alive = list(docs)
            for step, f in enumerate(order, 1):
                gone = [(i, b) for i, b in alive if f in b]
                alive = [(i, b) for i, b in alive if f not in b]
                redundant = sum(f in b for _, b in docs) - len(gone)
                unique = sum(b == {f} for _, b in docs)
                out[part, "".join(order), step] = (
                    len(alive), len(gone), redundant, unique, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                )
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def write(spark, rows, files):
    """A table of so many files, rows dealt in their order."""
    path = scratch_folder(spark, "audit-test")
    for k in range(files):
        part = [(i, t, "en", s, len(t or "")) for i, t, s in rows[k::files]]
        spark.createDataFrame(part, DOC_SCHEMA).selectExpr("*", "1 AS mask", "2 AS part", "3 AS key").coalesce(1).write.mode("append").parquet(path)
    return path


def result(spark, rows, labels, files=4, per_batch=1):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = A.filter_audit(spark, write(spark, rows, files), table, per_batch)
    return {tuple(r)[:3]: tuple(r)[3:] for r in out.collect()}


def corpus(seed):
    rng = random.Random(seed)
    texts = [words(rng, rng.choice([3, 150, 250])) for _ in range(25)] + ["AB " * 250, "word " * 300, "a|b " * 120, ""]
    rows = [(i, rng.choice(texts), rng.choice(["x", "y", None, ""])) for i in rng.sample(range(1_000), 120)]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i, _, _ in rows if rng.random() < 0.5]
    return rows, labels


def test_every_order_over_micro_batches(spark):
    """Ids in falling order: every micro-batch retracts earlier masks."""
    rows, labels = corpus(1)
    rows = sorted(rows, key=lambda r: -r[0])
    assert result(spark, rows, labels) == expected(rows, labels)


def test_order_of_files_and_batches_does_not_matter(spark):
    rows, labels = corpus(2)
    want = expected(rows, labels)
    assert result(spark, sorted(rows), labels, 3, 1) == want
    assert result(spark, rows, labels, 5, 2) == want


def test_odd_rows(spark):
    rows = [
        (1, None, "s"), (2, "", "s"), (3, None, None), (None, "", "s"), (None, "x", ""), (4, "x", "s"), (4, "x", "s"), (4, "x", "t"),
        (5, "x", "s"), (-1, "É ß A", "s"), (6, "w " * 120_000, "s"), (7, "A　B", "s"), (8, "tab\tand\x0bmore\x1c\x85", "s"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (None, 1, 1), (4, 1, None), (99, 1, 1), (2, None, 1)]
    assert result(spark, rows, labels, 3) == expected(rows, labels)


def test_empty_table(spark):
    assert result(spark, [], [], 1) == {}


def test_state_on_disk(spark, monkeypatch):
    """The other state store gives the same, and the session's settings stay."""
    before = {k: spark.conf.get(k, None) for k in A.STATE_STORE}
    monkeypatch.setattr(A, "MEMORY_STATE", 0)
    monkeypatch.setattr(A, "BUCKET_TEXTS", 5)
    rows, labels = corpus(4)
    assert result(spark, rows, labels, 3) == expected(rows, labels)
    assert {k: spark.conf.get(k, None) for k in A.STATE_STORE} == before


@pytest.mark.parametrize("seed", range(5))
def test_settling_in_any_order(seed):
    """Counters after any cut of a text's rows into groups are the same."""
    rng = random.Random(seed)
    rows = [(rng.choice("pq"), rng.random() < 0.5, False, rng.choice([None, 1, 2, 2, 3, 9])) for _ in range(30)]
    least = min(i for *_, i in rows if i is not None)
    want = Counter((p, 3 | (16 if i is not None and i > least else 0), g, t) for p, g, t, i in rows)
    for _ in range(20):
        rng.shuffle(rows)
        state, sums, left = None, Counter(), list(rows)
        while left:
            take, left = left[: (n := rng.randint(1, 8))], left[n:]
            (batch,) = list(A.group_up([A._batch(A.FLAGGED, [(i, p, 3, b"k", g, t) for p, g, t, i in take])]))
            groups = [r[2:] for r in A._rows_of(batch)]
            state, out = A.settle_text(groups, state)
            for *counter, n in out:
                sums[tuple(counter)] += n
        assert +sums == want and all(v >= 0 for v in sums.values())


def test_twin(spark):
    assert difference(entry.queries()["op11_filter_audit"](spark, SF_DIR), duck(SF_DIR), entry.oracle_sql()["op11_filter_audit"]) is None
