"""Vector links against brute force in double precision."""

import numpy as np
import pytest
from compare import difference, duck
from helpers import SF_DIR, components, sent  # noqa: F401

from casefeat.llm import vectors as V
from casefeat.llm.oracles import ORACLES
from casefeat.llm.queries import queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.98):
    links = []
    ok = {}
    for k, (_, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            w = np.array(v, np.float32).astype(float)
            ok[k] = w / np.linalg.norm(w)
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine:
                links.append((a, b))
    root = components(range(len(rows)), links)
    n = np.zeros(len(rows), int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    least = {}
    for k, (i, *_) in enumerate(rows):
        least[root[k]] = min(least.get(root[k], i), i)
    return {i: (int(n[k]), least[root[k]]) for k, (i, *_) in enumerate(rows)}


def sample(dims=32, n=150, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        rows.append([k, rng.standard_normal(dims), k % 3])
    for k in range(n, 2 * n):
        base = rows[rng.integers(n)]
        rows.append([k, base[1] + rng.standard_normal(dims) * rng.choice([0, 0.05, 0.15, 0.2, 0.25]), base[2] if rng.random() < 0.9 else 1])
    center = rng.standard_normal(dims)
    for k in range(2 * n, 2 * n + 60):
        rows.append([k, (center + 0.06 * rng.standard_normal(dims)) * rng.uniform(0.1, 50), 2])
    rows = [(k, [float(np.float32(x)) for x in v], c) for k, v, c in rows]
    one = rows[0][1]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * dims, 1), (903, [float("nan")] + one[1:], 0), (904, [float("inf")] + one[1:], 0)]
    rows += [(905, [None, *one[1:]], 0), (906, one, None), (907, one, 0), (908, one, 0), (909, one[:5], 0), (910, one[:5], 0), (911, [-0.0] * 4 + [1.0], 0), (912, [0.0] * 4 + [1.0], 0)]
    order = np.random.default_rng(1).permutation(len(rows))
    return [rows[k] for k in order]


@pytest.mark.parametrize(("grid_dims", "crowded"), [(None, V.CROWDED), (1, 10), (3, 32)])
def test_links_and_classes(spark, grid_dims, crowded):
    rows = sample()
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "2 AS kept", "3 AS n")
    got = {r["vec_id"]: r for r in V.vector_classes(frame, grid_dims=grid_dims, crowded=crowded).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for i, (n, component) in want.items():
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, component, component == i), i


@pytest.mark.parametrize("dims", [1, 2, 7, 20])
def test_other_lengths(spark, dims):
    rows = sample(dims, 25, 4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in V.vector_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_doubles_and_another_threshold(spark):
    rows = sample(16, 40, 5)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "CAST(embedding AS array<double>) AS embedding", "label")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in V.vector_classes(frame, cosine=0.9).collect()}
    assert got == brute(rows, 0.9)


def test_against_sql(spark):
    name = "op3_embedding_near_dedup"
    assert difference(queries()[name](spark, SF_DIR), duck(SF_DIR), ORACLES[name]) is None


def test_repeated_rows_null_ids_and_no_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(4, v, 1), (4, v, 1), (2, [1.0, 2.0, 3.01], 1), (None, v, 1), (None, [9.0, -1.0, 0.0], 1)]
    got = V.vector_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    found = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in got)
    assert found == [(0, 0, 0, True), (0, 3, 2, False), (2, 3, 2, True), (4, 3, 2, False), (4, 3, 2, False)]
    assert V.vector_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_budgets_add_up():
    assert sum(V.budgets(61, 0.98)) == pytest.approx(0.04 + V.SLACK)
    q = V.rotation(12)
    assert np.allclose(q @ q.T, np.eye(12))
