"""The quality classifier: held-out accuracy and defined edges."""

import zlib

import numpy as np
import pytest
from helpers import SF_DIR, docs_of, sent  # noqa: F401

from casefeat.llm import quality as Q
from casefeat.llm.queries import op1_quality_classifier

SF01 = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in op1_quality_classifier(spark, SF01).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    fold = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    right = [got[i]["predicted"] == labels[i] for i in fold]
    assert np.mean(right) >= 0.97
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in got.values())


def test_model_equals_the_textbook_form(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = Q.fit(docs, labels)
    rows = docs.join(labels, "doc_id").where(~Q.held_out(docs["doc_id"])).collect()
    x, y = np.stack([Q.statistics(r["text"]) for r in rows]), np.array([r["quality"] for r in rows])
    pooled = sum((x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in (0, 1)) / len(y)
    density = []
    for c in (0, 1):
        own = x[y == c]
        cov = 0.8 * np.cov(own.T, bias=True) + 0.2 * pooled + 0.05 * np.diag(np.maximum(np.diag(pooled), 1e-6))
        gap = x - own.mean(0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) - 0.5 * np.linalg.slogdet(cov)[1] + np.log((len(own) + 1) / (len(y) + 2)))
    assert np.allclose(model.log_odds(x), density[1] - density[0], rtol=1e-4, atol=1e-4)


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = Q.fit(docs, labels), Q.fit(docs, turned)
    assert np.allclose(a.mean, b.mean) and np.allclose(a.inverse, b.inverse)


@pytest.mark.parametrize("text", [None, "", " \n\t", "x", "é" * 1000, "a " * 200_000, "!!! ### $$$", "\x00"])
def test_statistics_are_finite(text):
    assert np.isfinite(Q.statistics(text)).all()


def test_odd_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, "x " * 50_000)]
    docs = docs_of(rows).selectExpr("*", "9 AS score", "8 AS x", "7 AS c")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, None), (None, 1), (4, 7)], "doc_id long, quality int")
    scored = Q.with_score(docs, Q.fit(docs, labels)).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    nothing = Q.fit(docs, labels.limit(0))
    assert {r["score"] for r in Q.with_score(docs, nothing).collect()} == {0.5}
    assert Q.with_score(docs.limit(0), nothing).count() == 0
