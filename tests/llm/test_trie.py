"""Exact groups: tries, owners, spills and odd rows."""

import hashlib
import os
import random
from collections import Counter

import pytest
from compare import difference, duck
from helpers import SF_DIR, docs_of, sent, words  # noqa: F401

import __spark_entry__ as entry
from casefeat.llm import trie as T


def expected(rows):
    """Plain version: of equal rows the first one met is kept."""
    groups, out = {}, []
    for doc_id, text in rows:
        groups.setdefault((text or "").encode().lower(), []).append(doc_id)
    for raw, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = True
        for i in sorted(ids, key=lambda x: (x is not None, x or 0)):
            stays = i == keep and left
            left = left and not stays
            out.append((i, keep, len(ids), stays, hashlib.sha256(raw).hexdigest()))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.collect())


ODD = [
    (1, "Same Text"), (2, "same text"), (7, "SAME TEXT"), (3, "same text "), (4, None), (5, ""), (6, "É"), (8, "é"), (9, "x" * 300_000),
    (10, "X" * 300_000), (11, "x" * 299_999), (None, "same text"), (None, "lone"), (None, "lone"), (12, "twice"), (12, "twice"), (12, "Twice"),
    (-3, "minus"), (-5, "minus"), (13, "a"), (14, "ab"), (15, "abc"), (16, "abd"), (17, "ab"),
]


def test_odd_rows(docs_of):
    docs = docs_of(ODD).selectExpr("*", "1 AS uid", "2 AS n", "3 AS terminal", "4 AS raw").repartition(3)
    assert got(T.exact_groups(docs)) == expected(ODD)


def test_empty_table(docs_of):
    out = T.exact_groups(docs_of([]))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and out.count() == 0


@pytest.mark.parametrize("limit", [8_000, 2_000_000])
def test_spilled_subtrees(docs_of, monkeypatch, limit):
    """Tries that hold a few texts only give the same groups."""
    rng = random.Random(3)
    heads = ["", "the same long beginning " * 5, "the same long beginning " * 5 + "and on"]
    texts = [rng.choice(heads) + words(rng, rng.randint(0, 30)) for _ in range(150)]
    rows = [(k, rng.choice(texts)) for k in range(900)] + [(2_000 + k, texts[0]) for k in range(400)] + ODD[3:]
    rounds = []
    monkeypatch.setattr(T, "owners_of", lambda *a, f=T.owners_of: rounds.append(1) or f(*a))
    assert got(T.exact_groups(docs_of(rows).repartition(5), trie_bytes=limit)) == expected(rows)
    assert (len(rounds) > 1) == (limit < 10_000)


def test_trie_equals_a_dictionary():
    rng = random.Random(5)
    for _ in range(200):
        trie, plain = T.Trie(), {}
        for k in range(rng.randint(0, 60)):
            raw = bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 6))) * rng.choice([1, 1, 40])
            node = trie.insert(raw)
            node.entry = [*(node.entry or []), k]
            plain.setdefault(raw, []).append(k)
        assert dict(trie.strings()) == plain
        assert sorted(map(tuple, trie.entries())) == sorted(map(tuple, plain.values()))


def test_one_mark_per_string():
    """A string leaves under one mark, before and after its subtree went."""
    rng = random.Random(6)
    trie, marks, inside = T.Trie(), {}, set()
    for k in range(4_000):
        raw = b"%d" % rng.randint(0, 10 ** rng.randint(1, 5))
        node = trie.insert(raw)
        if node.spilled:
            assert marks.setdefault(raw, node.spilled) == node.spilled and raw not in inside
        else:
            node.entry = [*(node.entry or []), k]
            inside.add(raw)
        while trie.size > 20_000:
            size = trie.size
            for mark, found, _ in trie.spill(20_000, 0):
                assert marks.setdefault(found, mark) == mark
                inside.discard(found)
            assert trie.size < size
    assert marks and inside and inside.isdisjoint(marks)


def test_common_prefix():
    for _ in range(500):
        a, b = os.urandom(random.randint(0, 4)) * 3, os.urandom(random.randint(0, 4)) * 3
        n = random.randint(0, len(a))
        b = a[:n] + b
        assert T.common_prefix(a, b"zz" + b, 2) == len(os.path.commonprefix([a, b]))


def test_crowd_sends_one_text_per_task(docs_of):
    docs = docs_of([(k, "the crowd") for k in range(3_000)]).repartition(4)
    assert T.pieces_of(docs, T.TRIE_BYTES).where("n IS NOT NULL").count() <= 4


def test_twin(spark):
    assert difference(entry.queries()["op13_exact_dedup"](spark, SF_DIR), duck(SF_DIR), entry.oracle_sql()["op13_exact_dedup"]) is None
