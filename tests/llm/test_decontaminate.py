"""Decontamination against a search without index or bounds."""

import random

import numpy as np
import pytest
from helpers import SF_DIR, docs_of, sent, words  # noqa: F401

from casefeat.llm import decontaminate as D


def slow_matches(text, items):
    """Score every item for every passage; no vocabulary cut, no bounds."""
    index = D.Index.build(items)
    parts = D.words_of(text)
    found = set()
    for start in range(0, max(1, len(parts)), index.stride):
        passage = parts[start : start + 2 * index.stride]
        for k, own in enumerate(index.words):
            weight = {index.vocabulary[w]: w for w in set(own)}
            at = {t: index.impacts[index.first[t] : index.first[t + 1]][index.items[index.first[t] : index.first[t + 1]] == k][0] for t in weight}
            score = sum(float(at[t]) for t, w in weight.items() if w in set(passage))
            width = min(5, len(own))
            mine = {tuple(own[j : j + width]) for j in range(len(own) - width + 1)}
            there = {tuple(passage[j : j + width]) for j in range(len(passage) - width + 1)}
            cut = max(1, len(own) * 3 // 4)
            halves = [set(own[:cut]), set(own[cut:]) or set(own)]
            if score >= 0.5 and len(mine & there) / len(mine) >= 0.8 and all(len(h & set(passage)) / len(h) >= 0.6 for h in halves):
                found.add(index.ids[k])
    return found


def corpus():
    rng = random.Random(2)
    items = [(k, words(rng, rng.randint(6, 60))) for k in range(40)] + [(100, "tiny one"), (101, "!"), (102, ""), (103, None)]
    rows = [(k, words(rng, rng.randint(0, 300))) for k in range(30)]
    for k in range(30, 90):
        text = words(rng, rng.randint(0, 400)).split()
        own = items[rng.randrange(40)][1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            own[rng.randrange(len(own))] = "other"
        if rng.random() < 0.3:
            own = own[: len(own) * 3 // 4]
        at = rng.randint(0, len(text))
        rows.append((k, " ".join(text[:at] + own + text[at:]).upper()))
    rows += [(200, None), (201, ""), (202, "tiny one"), (202, "tiny one"), (None, items[0][1]), (203, "a " * 50_000 + items[3][1])]
    return rows, items


def test_pairs(spark, docs_of):
    rows, items = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    known = sorted([(i, t) for i, t in items if t is not None], key=lambda x: x[0])
    want = {(doc_id, item) for doc_id, text in rows for item in slow_matches(text, known)}
    pairs = [(r["doc_id"], r["item_id"]) for r in D.contaminated_pairs(docs_of(rows), benchmark).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 25
    clean = D.clean(docs_of(rows), benchmark)
    dirty = {d for d, _ in want}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, _ in rows if d not in dirty)


def test_bounds_never_hide_an_item():
    rng = random.Random(7)
    items = [(k, words(rng, 30)) for k in range(64)]
    index = D.Index.build(items)
    for _ in range(200):
        text = D.words_of(words(rng, 60) + " " + items[rng.randrange(64)][1])
        got = {(p, k) for p, k, _ in index.search(text)}
        for p in range(len(text) // index.stride + 1):
            terms = np.unique([index.vocabulary[w] for w in text[p * index.stride : (p + 2) * index.stride] if w in index.vocabulary])
            score = index.score(terms.astype(int))
            assert {(p, k) for k in np.flatnonzero(score >= D.THRESHOLD)} == {x for x in got if x[0] == p}


def test_items_in_several_indexes(spark, docs_of, monkeypatch):
    rows, items = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in D.contaminated_pairs(docs_of(rows), benchmark).collect()}
    monkeypatch.setattr(D, "PASS_ITEMS", 9)
    assert len(list(D.indexes(benchmark))) == 5
    cut = {(r["doc_id"], r["item_id"]) for r in D.contaminated_pairs(docs_of(rows), benchmark).collect()}
    exact = {(d, i) for d, i in whole}
    assert len(exact ^ cut) <= 2  # term weights belong to an index; only borderline scores may differ


def test_planted_passages_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in benchmark.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated_pairs(docs, benchmark).collect()}
    assert want and want <= got and len(got) <= len(want) + 2


@pytest.mark.parametrize("empty", ["docs", "benchmark", "both"])
def test_empty_tables(spark, docs_of, empty):
    docs = docs_of([] if empty != "benchmark" else [(1, "a b c")])
    items = [] if empty != "docs" else [(1, "a b c")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert D.contaminated_pairs(docs, benchmark).count() == 0
    assert D.clean(docs, benchmark).count() == docs.count()


def test_clashing_columns(spark, docs_of):
    benchmark = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = docs_of([(1, "zero one two three four five six"), (2, "else")]).selectExpr("*", "1 AS item_id", "2 AS score")
    assert [r["doc_id"] for r in D.contaminated_pairs(docs, benchmark).collect()] == [1]
    assert [tuple(r) for r in D.clean(docs, benchmark).selectExpr("doc_id", "item_id").collect()] == [(2, 1)]


def test_slices_change_neither_pairs_nor_scores(spark, docs_of, monkeypatch):
    """Neighbouring ids share a template of 39 words, so one slice holds only
    them; a copy with another own word is still found."""
    rng = random.Random(3)
    rows, items = corpus()
    template = words(rng, 39).split()
    for k in range(16):
        items.append((1000 + k, " ".join([*template[:20], f"own{k}", *template[20:]])))
    items += [(2000 + k, words(rng, rng.randint(20, 90))) for k in range(120)]
    rows.append((300, " ".join(["before", *template[:20], "changed", *template[20:], "after"])))
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    known = sorted([(i, t) for i, t in items if t is not None], key=lambda x: x[0])
    index = D.Index.build(known)
    want = {(d, i, *values) for d, text in rows for i, values in index.matches(text).items()}
    assert {i for d, i, *_ in want if d == 300} == {1000 + k for k in range(16)}
    for size in (1000, 16, 7):
        monkeypatch.setattr(D, "PASS_ITEMS", size)
        assert {tuple(r) for r in D.contaminated_pairs(docs_of(rows), benchmark).collect()} == want
    assert len(list(D.indexes(benchmark))) > 20


def test_one_index_at_a_time(spark, docs_of, monkeypatch):
    """Of several slices no two indexes are on the executors at once, and
    both results are those of a single slice."""
    rows, items = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(rows).selectExpr("*", "1 AS __text")
    jobs = [lambda: D.contaminated_pairs(docs, benchmark), lambda: D.clean(docs, benchmark)]
    want = [sorted(map(str, job().collect())) for job in jobs]
    monkeypatch.setattr(D, "PASS_ITEMS", 9)
    live, most = set(), []
    send, destroy = type(spark.sparkContext).broadcast, D.Broadcast.destroy

    def broadcast(sc, value):
        sent = send(sc, value)
        if isinstance(value, D.Index):
            live.add(id(sent))
            most.append(len(live))
        return sent

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    monkeypatch.setattr(D.Broadcast, "destroy", lambda sent, *a: (live.discard(id(sent)), destroy(sent, *a)))
    assert [sorted(map(str, job().collect())) for job in jobs] == want
    assert len(most) == 10 and max(most) == 1


def test_quoted_and_upper_cased_copies(spark, docs_of):
    rng = random.Random(11)
    short = "how many legs has a spider got altogether"
    accented = "où élève señor naïve straße ısı garçon déjà vu crème brûlée über ñandú çok güzel"
    items = [(1, short), (2, accented), (3, "+ = ! ?"), (4, words(rng, 30)), (5, "what is it, (then)?")]
    rows = [
        (1, f'He asked: "{short}" and left'), (2, f"{words(rng, 20)} ({short})."), (3, f"so {accented.upper()} so"),
        (4, "x + = ! ? y"), (5, f"«{items[3][1]}»\u00a0end"), (6, words(rng, 50)), (7, "\u201cWHAT IS IT then\u201d"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated_pairs(docs_of(rows), benchmark).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (7, 5)}
    assert {r["doc_id"] for r in D.clean(docs_of(rows), benchmark).collect()} == {6}
