"""Merkle manifest: roots, proofs and tampered copies."""

import hashlib
import zlib

import pytest
from compare import difference, duck
from helpers import SF_DIR, docs_of, sent  # noqa: F401

import __spark_entry__ as entry
from casefeat.llm import merkle as M


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests, fanout=3):
    """Root and, per leaf, its ``(before, after)`` level by level."""
    paths, owners, nodes = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(nodes) > 1:
        up, up_owners = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for j in range(len(run)):
                for i in owners[at + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h("".join(run)))
            up_owners.append(sum(owners[at : at + fanout], []))
        nodes, owners = up, up_owners
    return nodes[0], paths


def expected(rows, fanout=3):
    """``rows`` are whole documents; one tuple per document."""
    sources = {}
    for row in rows:
        sources.setdefault(row[3], []).append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        line = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf((r[0], r[3], r[2], r[4], r[1]))))
        built[s] = (line, *tree([leaf((r[0], r[3], r[2], r[4], r[1])) for r in line], fanout))
    if not names:
        return []
    root, tops = tree([built[s][1] for s in names], fanout)
    out = []
    for s, top in zip(names, tops, strict=True):
        line, subroot, paths = built[s]
        for row, path in zip(line, paths, strict=True):
            doc_id, text, lang, source, n_chars = row
            own, got = leaf((doc_id, source, lang, n_chars, text)), text
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
                got = text.replace("\n", "")
            node = leaf((doc_id, source, lang, n_chars, got))
            for before, after in path + top:
                node = h(before + node + after)
            proof = h("".join(b + a for b, a in path + top))
            out.append((doc_id, own, subroot, root, proof, node, node == root))
    return out


def result(docs, **how):
    out = M.merkle_manifest(docs, M.without_line_breaks(docs), **how).drop("path")
    return sorted((tuple(r) for r in out.collect()), key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "a\nb", "en", "s", 3), (2, None, "en", "s", None), (3, "", None, "s", 0), (4, "é\n日本\n", "de", None, 6), (5, "x", "en", "", 1),
    (None, "no id\n", "en", "s", 1), (None, "no id\n", "en", "t", 1), (6, "twice\n", "en", "t", 1), (6, "twice\n", "en", "t", 1),
    (6, "other\n", "en", "t", 1), (-7, "minus\n", "en", "ü", 1), (8, "z\n" * 100_000, "en", "Z", 1),
]


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_odd_rows(spark, fanout):
    docs = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS g", "2 AS pos", "3 AS n", "'x' AS digest").repartition(3)
    assert result(docs, fanout=fanout) == sorted(expected(ODD, fanout), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 100])
def test_sizes(spark, n):
    rows = [(k, f"t{k}\n", "en", "s" if k % 3 else f"s{k % 4}", k) for k in range(n)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == sorted(expected(rows), key=repr)


def test_empty_table(spark):
    out = M.merkle_manifest(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and "verified" in out.columns


def test_every_change_is_seen(spark):
    """An untouched copy verifies, a changed one does not."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, f"text {k}", "en", f"s{k % 5}", 6) for k in range(60)], SCHEMA)
    assert M.merkle_manifest(docs).where("NOT verified").count() == 0
    changed = M.merkle_manifest(docs, F.concat("text", F.lit(".")))
    assert changed.where("verified").count() == 0 and changed.select("root").distinct().count() == 1


def test_layout_does_not_matter(spark):
    rows = [(k, f"t{k}\n", "en", f"s{k % 2}", k) for k in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert result(docs.repartition(7)) == result(docs.coalesce(1))


def test_twin(spark):
    assert difference(entry.queries()["op12_merkle_manifest"](spark, SF_DIR), duck(SF_DIR), entry.oracle_sql()["op12_merkle_manifest"]) is None
