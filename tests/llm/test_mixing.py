"""Mixing against its SQL twin and by hand."""

import re
from collections import Counter

import pytest
from compare import difference, duck
from helpers import SF_DIR, docs_of, sent  # noqa: F401

from casefeat.llm import mixing as M
from casefeat.llm.common import n_words
from casefeat.llm.oracles import ORACLES
from casefeat.llm.queries import queries


def test_against_sql(spark):
    name = "op2_source_mixing"
    assert difference(queries()[name](spark, SF_DIR), duck(SF_DIR), ORACLES[name]) is None


@pytest.mark.parametrize("text", ["", None, " ", "a", " a  b\t\n c ", "é é  ", "a\x0bb\x0cc\rd", "x " * 30_000])
def test_word_count(spark, text):
    frame = spark.createDataFrame([(text,)], "text string")
    assert frame.select(n_words(frame["text"])).first()[0] == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def by_hand(sizes, cap=3):
    """Targets by refilling until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        if not free:
            return {s: float(cap * sizes[s]) for s in order}
        level = (total - sum(cap * sizes[s] for s in full)) / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not above:
            return {s: float(cap * sizes[s]) if s in full else level * weight[s] for s in order}
        full |= above


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1, "c": 100, None: 5}, {"z": 7}, {"a": 0, "b": 9}, {"a": 0}])
def test_targets(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    got = M.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()
    assert {r["source"]: r["target"] for r in got} == pytest.approx(by_hand(sizes))


def test_taken_words_come_near_the_targets(spark, docs_of):
    rows = [(k, "w " * (1 + k * 7919 % 97), f"s{k % 5 if k % 3 else 0}") for k in range(3000)]
    got = M.mix(docs_of(rows)).collect()
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        taken = sum(r["copies"] * r["size"] for r in own)
        assert abs(taken - own[0]["target"]) <= 100
    assert max(r["copies"] for r in got) <= 3


def test_same_whatever_the_partitions(spark, docs_of):
    docs = docs_of([(k, "w " * (k % 13), f"s{k % 4}") for k in range(400)])
    a = M.mix(docs.repartition(1)).collect()
    b = M.mix(docs.repartition(7)).collect()
    assert sorted(a, key=str) == sorted(b, key=str)


def test_places_follow_a_plain_sort(spark, docs_of):
    """Systematic sampling by hand: one line per source, one offset."""
    import hashlib
    from math import floor

    rows = [(k, "w " * (k % 5), "ab"[k % 2]) for k in range(200)]
    got = {r["doc_id"]: r for r in M.mix(docs_of(rows)).collect()}
    for source in "ab":
        shift = int(hashlib.md5(f"0:{source}".encode()).hexdigest()[:13], 16) / 2**52
        line = sorted(((k % 5, hashlib.md5(f"0:{k}".encode()).hexdigest(), k) for k, _, s in rows if s == source))
        for place, (_, _, k) in enumerate(line):
            rate = got[k]["target"] / got[k]["source_size"]
            assert got[k]["copies"] == floor(rate * (place + 1) + shift) - floor(rate * place + shift)


def test_rows_of_the_mix(spark, docs_of):
    rows = [(k, "w " * (1 + k % 9), f"s{k % 3}") for k in range(120)]
    rows += [(500, "same text", "s1")] * 4 + [(None, "no id", None), (None, None, None), (501, "", "s0")]
    docs = docs_of(rows).selectExpr("*", "1 AS copies", "2 AS __copies", "3 AS __k", "4 AS sid", "5 AS `x.y`")
    taken = Counter()
    for r in M.mix(docs).collect():
        taken[r["doc_id"], r["text_hash"]] += r["copies"]
    mixed = M.mixed_rows(docs)
    assert mixed.columns == docs.columns
    got = Counter((r[0], r[1]) for r in mixed.selectExpr("doc_id", "xxhash64(text)").collect())
    assert got == {k: v for k, v in taken.items() if v}


def test_empty_table(spark, docs_of):
    assert M.mix(docs_of([])).count() == 0
    assert M.mixed_rows(docs_of([])).count() == 0


def test_rows_that_differ_elsewhere_are_kept(spark):
    """Rows of one id, source and text in two languages are two rows; wholly equal ones add up."""
    rows = [(1, "x y z", lang, "a", n) for lang, n in (("en", 5), ("de", 5), ("de", None), (None, 5))] + [(2, "u v w", "en", "a", 5)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(tuple(r) for r in M.mixed_rows(docs).collect())
    # One source: its target is its own size, so each row is taken once.
    assert got == Counter(rows)
