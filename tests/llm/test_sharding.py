"""The shuffle: exact sizes, nothing lost, uniform placements."""

from collections import Counter
from math import comb

import numpy as np
import pytest
from helpers import docs_of, sent  # noqa: F401

from casefeat.llm import sharding as S


def test_matrix_has_the_sums():
    rows, targets = [7, 0, 100, 13, 1], [40, 40, 41, 0]
    m = S.communication_matrix(rows, targets, 5)
    assert m.sum(1).tolist() == rows and m.sum(0).tolist() == targets and (m >= 0).all()
    with pytest.raises(ValueError):
        S.communication_matrix([1], [2], 0)


def test_matrix_is_hypergeometric():
    first = Counter(S.communication_matrix([3, 5], [4, 4], seed)[0, 0] for seed in range(4000))
    for k in range(4):
        assert abs(first[k] / 4000 - comb(4, k) * comb(4, 3 - k) / comb(8, 3)) < 0.03


def test_draw_beyond_the_library_limit():
    rng = np.random.default_rng(3)
    got = np.array([S.draw(rng, 6 * 10**11, 4 * 10**11, 10**6) for _ in range(400)])
    sd = np.sqrt(10**6 * 0.6 * 0.4)
    assert abs(got.mean() - 6 * 10**5) < 5 * sd / 20 and 0.85 < got.std() / sd < 1.15
    small = np.array([S.draw(rng, 2 * 10**9, 8 * 10**9, 3) for _ in range(2000)])
    assert abs(small.mean() - 0.6) < 0.06 and small.min() >= 0 and small.max() <= 3


@pytest.mark.parametrize("n", [0, 1, 5, 8, 1003])
def test_sizes_and_slots(spark, docs_of, n):
    docs = docs_of([(k, f"text {k % 7}") for k in range(n)]).repartition(5)
    got = S.shard_rows(docs, 8).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(n))
    count = Counter(r["shard"] for r in got)
    sizes = [count.get(s, 0) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))


def test_placements_are_uniform(spark):
    """Every row is as likely in every shard and in either half of it."""
    frame = spark.range(0, 64, 1, 4)
    seen = np.zeros((64, 8))
    rounds = 60
    for seed in range(rounds):
        for r in S.shard_rows(frame, 4, seed).collect():
            seen[r["id"], r["shard"] * 2 + (r["slot"] >= 8)] += 1
    expected = rounds / 8
    chi2 = ((seen - expected) ** 2 / expected).sum()
    assert chi2 < 64 * 7 + 5 * np.sqrt(2 * 64 * 7)


def test_same_seed_same_shuffle(spark, docs_of):
    docs = docs_of([(k, "t") for k in range(100)])
    a, b, c = (sorted((r["doc_id"], r["shard"], r["slot"]) for r in S.shard_rows(docs, 3, s).collect()) for s in (1, 1, 2))
    assert a == b != c


def test_odd_rows_and_clashing_columns(spark, docs_of):
    rows = [(None, None), (1, ""), (1, ""), (2, "x" * 200_000)]
    docs = docs_of(rows).selectExpr("*", "7 AS Shard", "8 AS slot", "9 AS __bin", "1 AS __from", "2 AS __key", "3 AS `a.b`")
    out = S.shard_rows(docs, 2)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "__bin", "__from", "__key", "a.b", "shard", "slot"}
    got = out.collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert Counter(r["__bin"] for r in got) == {9: 4} and sum(r["doc_id"] is None for r in got) == 1


def test_bins_stay_small():
    """As many rows to a bin whatever the number of rows and partitions."""
    for rows in (10**6, 10**9, 2 * 10**10, 10**12):
        assert rows / (8 * S.bins_per_shard(rows, 8, 1)) <= S.ROWS_PER_BIN
    assert S.bins_per_shard(1000, 8, 64) == 8 and S.bins_per_shard(0, 8, 1) == 1


def test_draws_fill_the_shards_evenly():
    share = np.array([100_000, 0, 50_000])
    bins, key = S.drawn(share, 1, 7, 10)
    sizes = np.bincount(bins, minlength=30)
    assert sizes.reshape(3, 10).sum(1).tolist() == share.tolist() and len(set(key.tolist())) == 150_000
    assert abs(sizes[:10] - 10_000).max() < 600 and abs(sizes[20:] - 5_000).max() < 450
    assert (S.drawn(share, 1, 7, 10)[0] == bins).all() and (S.drawn(share, 1, 8, 10)[0] != bins).any()


def test_many_bins(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_BIN", 7)
    got = S.shard_rows(spark.range(0, 500, 1, 6), 3, 4).collect()
    assert sorted(r["id"] for r in got) == list(range(500))
    for s, n in enumerate((167, 167, 166)):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
