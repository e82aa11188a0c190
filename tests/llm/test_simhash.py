"""SimHash classes against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from helpers import components, docs_of, sent, words  # noqa: F401

from casefeat.llm import simhash as S
from casefeat.llm.common import connected_components


def slow_fingerprint(text):
    raw = (text or "").encode()
    parts = bytes(c + 32 if 65 <= c <= 90 else c for c in raw).split()
    grams = [parts[k : k + 4] for k in range(max(1, len(parts) - 3))] if parts else []
    total = [0] * 64
    for gram in grams:
        h = xxhash.xxh64_intdigest(b" ".join(gram), 42)
        for bit in range(64):
            total[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if total[bit] * 2 > len(grams))


def slow_classes(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    return fps, components(range(len(rows)), links)


@pytest.mark.parametrize("text", ["", None, "one", "A b\tC\x0bd", "a b c d e", "É ß É ß É", "x " * 50, "  a  \n b "])
def test_fingerprint(text):
    assert S.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_of_a_long_text():
    text = words(random.Random(1), 70_000)
    assert S.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_equals_the_engine_hash(spark, docs_of):
    """One shingle only: the fingerprint is its hash."""
    docs = docs_of([(1, "one two three four")])
    row = S.with_fingerprint(docs).selectExpr("fp", "xxhash64(text) AS h").first()
    assert row["fp"] == row["h"]


def corpus():
    rng = random.Random(3)
    rows = [(k, words(rng, 60)) for k in range(60)]
    for k in range(60, 110):
        parts = rows[rng.randrange(60)][1].split()
        for _ in range(rng.randint(0, 2)):
            parts[rng.randrange(len(parts))] = "changed"
        rows.append((k, " ".join(parts)))
    rows += [(200 + k, rows[0][1].upper()) for k in range(5)]
    rows += [(300, ""), (301, None), (302, " \n"), (303, "a"), (304, "a"), (305, "x" * 100_000)]
    return rows


@pytest.mark.parametrize("crowded", [S.CROWDED, 4])
def test_classes(spark, docs_of, crowded):
    rows = corpus()
    random.Random(5).shuffle(rows)
    fps, root = slow_classes(rows)
    got = {r["doc_id"]: r for r in S.simhash_classes(docs_of(rows), crowded=crowded).collect()}
    smallest = {}
    for k, (doc_id, _) in enumerate(rows):
        smallest[root[k]] = min(smallest.get(root[k], doc_id), doc_id)
    assert len(got) == len(rows)
    for k, (doc_id, _) in enumerate(rows):
        assert got[doc_id]["fp"] % 2**64 == fps[k]
        assert got[doc_id]["component_id"] == smallest[root[k]]


@pytest.mark.parametrize("crowded", [S.CROWDED, 16])
@pytest.mark.parametrize("distance", [0, 2, 4])
def test_links_connect_all_near_fingerprints(spark, distance, crowded):
    rng = random.Random(distance)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for center in list(fps)[:40]:
        for _ in range(8):
            near = center
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                near ^= 1 << bit
            fps.add(near)
    crowd = rng.getrandbits(64)
    fps |= {crowd ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    value = dict(zip(signed, fps, strict=True))
    links = [(a, b) for k, a in enumerate(signed) for b in signed[:k] if (value[a] ^ value[b]).bit_count() <= distance]
    want = components(signed, links)
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {s: s for s in signed}
    got |= {r["id"]: r["component"] for r in connected_components(S.near_links(frame, distance, crowded)).collect()}
    assert got == want


def test_keep_first(spark, docs_of):
    text = words(random.Random(9), 40)
    rows = [(5, text), (3, text), (3, text), (9, words(random.Random(8), 40)), (None, text), (None, "alone here"), (None, "alone here")]
    kept = S.keep_first(docs_of(rows)).select("doc_id", "text").collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == sorted([(3, text), (9, rows[3][1]), (-1, "alone here")])


def test_empty_table_and_clashing_columns(spark, docs_of):
    assert S.simhash_classes(docs_of([])).count() == 0
    assert S.keep_first(docs_of([])).count() == 0
    docs = docs_of([(1, "a b c d"), (2, "a b c d")])
    odd = docs.selectExpr("*", "1 AS fp", "2 AS __id", "3 AS component_id", "4 AS cell", "5 AS `a.b`")
    kept = S.keep_first(odd)
    assert kept.columns == odd.columns
    assert [tuple(r)[0] for r in kept.collect()] == [1]


def test_chain_of_links(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 7), (50, 60), (60, 50), (70, 70)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 0, 50: 50, 60: 50}
