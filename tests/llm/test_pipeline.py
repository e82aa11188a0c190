"""The pipeline's stages, each against a plain version on its own input."""

from collections import Counter

import pytest
from helpers import SF_DIR, components, docs_of, sent  # noqa: F401

import __spark_entry__ as entry
import corpus_pipeline
from casefeat.llm import mixing, quality, simhash


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF_DIR)
        rows = kept.collect()
        out[name] = (docs, docs.collect(), kept.columns, rows)
        docs = spark.createDataFrame(rows, kept.schema)
    return out


def test_columns(stages):
    for name, (docs, _, columns, _) in stages.items():
        assert columns == docs.columns + (["shard", "slot"] if name == "sharding" else [])


def test_quality(stages, spark):
    docs, rows, _, kept = stages["quality"]
    model = quality.fit(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    want = [r for r in rows if model.score(quality.statistics(r["text"])[None])[0] >= 0.3]
    assert sorted(kept) == sorted(want) and len(want) < len(rows)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    left = {r["doc_id"] for r in kept}
    assert sum(labels[i] == 1 and i not in left for i in labels) <= 1


def test_near_duplicates(stages):
    _, rows, _, kept = stages["near_duplicates"]
    fps = [simhash.fingerprint(r["text"]) for r in rows]
    ids = [r["doc_id"] for r in rows]
    links = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = components(ids, links)
    assert sorted(kept) == sorted(r for r in rows if root[r["doc_id"]] == r["doc_id"]) and len(kept) < len(rows)


def test_decontaminate(stages, spark):
    _, rows, _, kept = stages["decontaminate"]
    items = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = [r for r in rows if not any(i in r["text"] for i in items)]
    assert sorted(kept) == sorted(clean) and len(kept) < len(rows)


def test_mixing(stages):
    docs, _, _, kept = stages["mixing"]
    want = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]})
    assert Counter(r["doc_id"] for r in kept) == want


def test_sharding(stages):
    _, rows, _, kept = stages["sharding"]
    assert Counter(r["doc_id"] for r in kept) == Counter(r["doc_id"] for r in rows)
    sizes = Counter(r["shard"] for r in kept)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in kept if r["shard"] == s) == list(range(n)) for s, n in sizes.items())


def test_run_equals_the_stages(stages, spark):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in stages["sharding"][3])


def test_every_query_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("rows", [[], [(1, None), (None, ""), (2, "a b c"), (2, "a b c"), (3, "x " * 100_000)]])
def test_odd_documents(spark, docs_of, rows):
    docs = docs_of(rows).selectExpr("*", "1 AS shard", "2 AS __score", "3 AS fp")
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), stage(spark, docs, SF_DIR).schema)
        assert "fp" in docs.columns and (name == "sharding" or docs.columns[-3:] == ["shard", "__score", "fp"])
