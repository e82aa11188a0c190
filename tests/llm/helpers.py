"""Fixtures, texts and reference answers for the tests of the operators."""

import random
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from casefeat.llm.ship import send_package  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True, scope="session")
def sent(spark):
    send_package(spark)


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    def make(rows, schema=DOC_SCHEMA):
        """Documents from ``(doc_id, text[, source])``."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


def words(rng: random.Random, n: int) -> str:
    parts = ["the", "of", "tion", "er", "in", "an", "re", "ed", "ou", "ble"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def components(ids, links):
    """Smallest id reachable from each id."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
