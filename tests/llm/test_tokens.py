"""Token files: ids, places, encodings and selective reads."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from helpers import SF_DIR, docs_of, sent, words  # noqa: F401
from tokenizers import Tokenizer

from casefeat.llm import tokens as T
from casefeat.session import scratch_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "   ", "a", " a", "a ", "a  b", "a   b", "\n", "a\n b", "a \nb", "a\n  b", "\n\n\n", "it's 's 'll", "a 's", "é ß ñ",
    "a\u00a0b", "a \u00a0b", "a\u00a0 b", "\u00a0 \u00a0", "\u3000 x", "日本語 テキスト", "🙂 🙂🙂", "x\x00y \x1c z", "tab\tand\x0bmore \x0c",
    "<|endoftext|>", "a <|endoftext|> b", "<|endof text|>", "123 456abc", "...!!! ???", "A" * 300, "word " * 50, "\r\n x\r\n", "a\u2028 b",
    "price \u00a0 \u00a0 total", "Tel \u00a0 \u00a0 Fax", "é \u00a0 \u00a0", "a\n \nb", "a\n b\n c \nd", "\ufeff x", "ﬁ ligature", "e\u0301 combining", "\u200b \u200d", "٣ ४ Ⅷ ½",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_pieces_equal_whole_texts(tokenizer):
    own = T.Encoder(PATH)
    rng = np.random.default_rng(1)
    alphabet = list("ab é'.,\n\t  1<|>") + ["\u00a0", "日", "🙂", "'s", "the", "  "]
    texts = ODD + ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


SPACES = [" ", "\u00a0", "\t", "\n", "\u3000", "\x1c", "\x85"]


def test_all_runs_of_white_space(tokenizer):
    """Every run of up to five, with and without words on either side."""
    own = T.Encoder(PATH)
    runs = ["".join(r) for n in range(1, 6) for r in itertools.product(SPACES[: 7 if n < 5 else 5], repeat=n)]
    texts = [f"{a}{run}{b}" for run in runs for a, b in (("", ""), ("price", ""), ("", "total"), ("é", "Fax"))]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for k in range(0, len(texts), 500):
        for text, ids, right in zip(texts[k : k + 500], own.many(texts[k : k + 500]), want[k : k + 500], strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == right, repr(text)


def test_the_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "CACHED", 10)
    own, plain = T.Encoder(PATH), T.Encoder(PATH)
    for k in range(40):
        text = f"w{k} w{k + 1} common w{k // 2}"
        assert own.ids(text) == plain.whole([text])[0]
    assert len(own.known) <= 20


def expected(rows, tokenizer):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, docs_of, tokenizer):
    rows = [(k * 3, t) for k, t in enumerate([*ODD, None, "x y " * 60_000])]
    docs = docs_of(rows[::-1]).selectExpr("*", "1 AS first", "2 AS ids", "3 AS part").repartition(3)
    got = [tuple(r) for r in T.tokenized(docs, PATH).orderBy("doc_id").collect()]
    assert got == expected(rows, tokenizer)


def test_the_given_table(spark, tokenizer):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = [tuple(r) for r in T.tokenized(docs, PATH).orderBy("doc_id").collect()]
    assert got == expected(rows, tokenizer)


def test_equal_ids_null_ids_and_no_rows(spark, docs_of):
    rows = [(2, "b"), (1, "same"), (1, "same"), (1, "other text"), (None, "n"), (None, None)]
    got = sorted(T.tokenized(docs_of(rows), PATH).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 1, 2]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got[:-1], got[1:], strict=True)) and got[0]["start"] == 0
    assert T.tokenized(docs_of([]), PATH).count() == 0


def test_files_and_selective_reads(spark, docs_of, tokenizer, monkeypatch):
    rows = [(k, f"text of number {k} " * 3) for k in range(2500)]
    listed = T.write_tokens(docs_of(rows), scratch_folder(spark, "tokens"), PATH)
    assert listed.agg({"documents": "sum"}).first()[0] == 2500
    for r in listed.collect():
        meta = pq.ParquetFile(r["path"].removeprefix("file://")).metadata
        assert max(meta.row_group(g).num_rows for g in range(meta.num_row_groups)) <= T.ROWS_PER_GROUP
        for name, kind in (("doc_id", "DELTA_BINARY_PACKED"), ("first", "DELTA_BINARY_PACKED"), ("ids.list.element", "RLE_DICTIONARY")):
            column = next(c for c in (meta.row_group(0).column(k) for k in range(3)) if c.path_in_schema == name)
            assert kind in column.encodings and column.has_column_index and column.has_offset_index
    some = {r["doc_id"]: r["ids"] for r in T.tokens_of(listed, 700, 705).collect()}
    assert some == {k: [*tokenizer.encode(rows[k][1], add_special_tokens=False).ids, 0] for k in range(700, 705)}
    plan = T.tokens_of(listed, 700, 705)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,700), LessThan(doc_id,705)]" in plan
    assert "ids" not in T.lengths(listed)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert T.lengths(listed).count() == 2500
