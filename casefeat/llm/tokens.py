"""Token ids in Parquet files that can be read in parts.

A file holds one row per document in ascending doc_id order: the id (delta
encoding), the place of its first token (delta encoding) and the list of ids
(dictionary encoding). Row groups have a fixed number of rows and pages an
index, so metadata is read without tokens and single documents without their
neighbours.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_folder
from .common import partitions, settle

ROWS_PER_GROUP = 1_000
PAGE_BYTES = 262_144
FILE_TOKENS = 50_000_000
CACHED = 800_000
# Parts encoded in one text, and documents whose parts are learned together.
PARTS, DOCUMENTS = 200, 250
# A blank inside a run of white space; Python's kind includes the tokenizer's.
INNER_BLANK = re.compile(r"\s \s")
# Seen first, as it is found fast: a blank before other white space.
EDGE = re.compile(r" [^\S ]")
# How the byte-level alphabet writes a blank.
BLANK = "\u0120"
# Fixed value: the byte-level pre-tokenizer's pattern, for ASCII text. What is
# found most is tried first; a word or a number never begins with an apostrophe.
PIECES = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
END = 0

FILE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("ids", pa.list_(pa.uint32()))])


class Words(dict):
    """Ids of what the pre-tokenizer keeps together, found when first asked for."""

    def __init__(self, tokenizer):
        self.model = tokenizer.model
        self.alphabet = {c: tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(128)}

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = array("I", [t.id for t in self.model.tokenize(piece.translate(self.alphabet))]).tobytes()
        return ids


class Encoder:
    """The tokenizer, with a memory for parts of text seen before.

    A byte-level pre-tokenizer keeps a run of white space together but for its
    last character before a word, which may go with the word if it is a blank.
    So a new piece starts at every single blank, unless there is white space
    on both sides of it. A text without such blanks, double blanks and special
    tokens is the sum of its parts between blanks, each with its blank; parts
    are encoded once. An ASCII text without special tokens is cut into pieces
    at once, which are encoded once. Other texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.words = Words(self.tokenizer)
        vocab = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for token, i in vocab.items() if token.startswith(BLANK)]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        plain = [t.isascii() and not self.is_special(t) for t in texts]
        cut = [None if p or self.is_odd(t) else t.split(" ") for t, p in zip(texts, plain, strict=True)]
        split = [p for p in cut if p is not None]
        self.learn(set().union(*[p[1:] for p in split]))
        firsts = iter(self.whole([p[0] for p in split]))
        known, out = self.known.__getitem__, []
        for text, parts, ascii_only in zip(texts, cut, plain, strict=True):
            if ascii_only:
                out.append(self.of_pieces(text))
            elif parts is None:
                out.append(self.whole([text])[0])
            else:
                out.append(next(firsts) + b"".join(map(known, parts[1:])))
        return out

    def of_pieces(self, text: str) -> bytes:
        if len(self.words) > CACHED:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, PIECES.findall(text)))

    def is_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def is_odd(self, text: str) -> bool:
        if "  " in text or self.is_special(text):
            return True
        return EDGE.search(text) is not None and INNER_BLANK.search(text) is not None

    def learn(self, parts: set[str]) -> None:
        """Encode the parts not known yet, many of them as one text: a part
        begins where a piece, or a token, begins with a blank. ASCII parts are
        cut into pieces here, since many pieces are known; parts with white
        space at an end would join their neighbours', so they are encoded
        alone."""
        new = parts.difference(self.known)
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
            self.words.clear()
            new = parts
        alone = [p for p in new if not p or p[0].isspace() or p[-1].isspace()]
        self.known.update(zip(alone, self.whole([f" {p}" for p in alone]), strict=True))
        rest = new.difference(alone)
        plain = [p for p in rest if p.isascii()]
        pieces = PIECES.findall("".join([f" {p}" for p in plain]))
        found = list(map(self.words.__getitem__, pieces))
        self._add(plain, found, [k for k, p in enumerate(pieces) if p[0] == " "], b"".join)
        others = list(rest.difference(plain))
        lines = ["".join([f" {p}" for p in others[k : k + PARTS]]) for k in range(0, len(others), PARTS)]
        raw = b"".join(self.whole(lines))
        self._add(others, raw, (np.flatnonzero(self.begins[np.frombuffer(raw, "<u4")]) * 4).tolist(), bytes)

    def _add(self, parts: list[str], ids, at: list[int], join) -> None:
        if len(at) != len(parts):
            raise RuntimeError("parts do not begin with their blanks: not a byte-level tokenizer")
        ends = [*at, len(ids)][1:]
        self.known.update(zip(parts, [join(ids[s:e]) for s, e in zip(at, ends, strict=True)], strict=True))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(own: Encoder, batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """``(doc_id, ids)`` of the batch's rows, a few documents at a time."""
    for k in range(0, batch.num_rows, DOCUMENTS):
        some = batch.slice(k, DOCUMENTS)
        texts = [t or "" for t in some.column("text").to_pylist()]
        yield from zip(some.column("doc_id").to_pylist(), own.many(texts), strict=True)


def _writer(store, path: str) -> pq.ParquetWriter:
    return pq.ParquetWriter(
        path, FILE_SCHEMA, filesystem=store, compression="zstd", compression_level=1,
        use_dictionary=["ids.list.element"], data_page_size=PAGE_BYTES, write_page_index=True, version="2.6",
        column_encoding={"doc_id": "DELTA_BINARY_PACKED", "first": "DELTA_BINARY_PACKED"},
    )


def write_tokens(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Encode every text, append the end id, and write the files in doc_id
    order; returns ``(path, part, number, tokens, documents)`` per file, in
    the order of ``(part, number)``. Only files of tasks that ended are
    listed. ``tokenizer`` is a path that every executor can read."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64("text")]
    dealt = thin.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, end = TaskContext.get().partitionId(), np.array([END], "<u4").tobytes()
        done, out, path, tokens, documents, held = [], None, "", 0, 0, []

        def flush():
            raw = [ids for _, ids in held]
            sizes = np.array([len(r) // 4 for r in raw], np.int64)
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<u4")))
            first = pa.array(tokens + offsets[:-1])
            table = pa.Table.from_arrays([pa.array([d for d, _ in held], pa.int64()), first, lists], schema=FILE_SCHEMA)
            out.write_table(table, row_group_size=ROWS_PER_GROUP)
            held.clear()
            return int(offsets[-1])

        waiting = 0
        for batch in batches:
            for doc_id, ids in encoded(own, batch):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.parquet"
                    out, tokens, documents = _writer(store, path), 0, 0
                held.append((doc_id, ids + end))
                documents += 1
                waiting += len(held[-1][1]) // 4
                if len(held) == ROWS_PER_GROUP or waiting >= FILE_TOKENS // 10:
                    tokens += flush()
                    waiting = 0
                    if tokens >= FILE_TOKENS:
                        out.close()
                        done.append((path, part, len(done), tokens, documents))
                        out = None
        if out is not None:
            if held:
                tokens += flush()
            out.close()
            done.append((path, part, len(done), tokens, documents))
        columns = list(zip(*done, strict=True)) or [[]] * 5
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        names = ["path", "part", "number", "tokens", "documents"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    listed, _ = settle(
        dealt.mapInArrow(write, "path string, part int, number int, tokens long, documents long"), "token-files"
    )
    return listed


def with_places(listed: DataFrame) -> DataFrame:
    """Add ``before``: the tokens of all earlier files (one row per file)."""
    earlier = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("before", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))


def read_tokens(listed: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read from
    the files one row group at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with pq.ParquetFile(path, filesystem=store) as file:
                    for group in range(file.num_row_groups):
                        table = file.read_row_group(group).combine_chunks()
                        lists = table.column("ids").chunk(0)
                        ids = lists.values.to_numpy().astype("<u4", copy=False)
                        at = lists.offsets.to_numpy()
                        sums = [zlib.crc32(ids[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
                        start = table.column("first").to_numpy() + before
                        yield pa.RecordBatch.from_arrays(
                            [table.column("doc_id").chunk(0), pa.array(start), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    placed, _ = settle(with_places(listed), "token-files")
    dealt = placed.repartition(max(1, min(placed.count(), 10_000)))
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lengths(listed: DataFrame) -> DataFrame:
    """``(doc_id, first)`` of every document without reading a token."""
    return _files(listed).select("doc_id", "first")


def tokens_of(listed: DataFrame, low: int, high: int) -> DataFrame:
    """``(doc_id, ids)`` of the documents ``low <= doc_id < high``: row groups
    and pages outside are passed over by their statistics."""
    return _files(listed).where((F.col("doc_id") >= low) & (F.col("doc_id") < high)).select("doc_id", "ids")


def _files(listed: DataFrame) -> DataFrame:
    paths = [r["path"] for r in listed.select("path").collect()]
    return listed.sparkSession.read.schema("doc_id long, first long, ids array<long>").parquet(*paths)


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files of all documents and read them back.

    A null or empty text has the end id only. Documents without doc_id come
    first; rows with one doc_id stand in the order of a hash of their text,
    and rows that are wholly equal are interchangeable. Other columns are not
    read; an empty table gives no file and an empty result.
    """
    folder = scratch_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer), folder)
