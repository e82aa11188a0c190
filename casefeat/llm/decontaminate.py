"""Benchmark decontamination: BM25 with block-max bounds, then exact overlap.

The test items form an inverted index whose impacts are BM25 weights divided
by the item's score for itself, in blocks of a few items with each term's
largest impact per block. Term frequencies, mean length and longest item are
those of all items, however many slices the index is cut into. Every passage of every training text queries the
index. A block whose summed maxima stay below the threshold holds no answer
and is passed over; in the others every item is scored in full. All items
above the threshold are then compared word by word.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder
from .common import fresh, settle

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.8
PART_OVERLAP = 0.6
SHINGLE = 5
BLOCK_ITEMS = 4
MIN_STRIDE = 64
PASS_ITEMS, PASS_BYTES = 512, 4_000_000
MARKS = frozenset("`´<>") | {c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "P"}


def _bare(word: str) -> str:
    first, end = 0, len(word)
    while first < end and word[first] in MARKS:
        first += 1
    while end > first and word[end - 1] in MARKS:
        end -= 1
    return word[first:end] or word


def words_of(text: str | None) -> list[bytes]:
    """Words between white space in one case (capitals first, so that a copy
    in capitals keeps ``ß`` and ``ı``), without the marks at their ends; a
    word of marks only stays as it is."""
    text = text or ""
    folded = text.lower() if text.isascii() else text.upper().casefold()
    words = [w if w.isalnum() else _bare(w) for w in folded.split()]
    return " ".join(words).encode("utf-8", "surrogatepass").split(b" ") if words else []


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    width = min(SHINGLE, len(words))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if words else set()


@dataclass(frozen=True)
class Totals:
    """What the weights need of a whole benchmark: its items that have words,
    their mean length in words and that of the longest."""

    items: int
    mean: float
    longest: int


@dataclass
class Index:
    """Inverted index of at most ``PASS_ITEMS`` items: postings by term, each
    with the item's number and impact, and per term and block the largest."""

    ids: list[int]
    words: list[list[bytes]]
    vocabulary: dict[bytes, int]
    first: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    block_max: np.ndarray
    stride: int

    @staticmethod
    def build(items: list[tuple[int, str]], totals: Totals | None = None, frequency: dict[bytes, int] | None = None) -> Index:
        """Index of ``items``, a slice of a benchmark with ``totals`` and, for
        the words of the slice, the number of items that have them; without
        these the items are the whole benchmark."""
        known = [(i, words_of(t)) for i, t in items]
        known = [(i, w) for i, w in known if w]
        counts = [Counter(w) for _, w in known]
        if totals is None:
            size = [len(w) for _, w in known] or [1]
            totals = Totals(len(known), sum(size) / len(size), max(size))
            frequency = Counter(t for c in counts for t in c)
        vocabulary = {t: k for k, t in enumerate(sorted({t for c in counts for t in c}))}
        idf = {t: np.log1p((totals.items - frequency[t] + 0.5) / (frequency[t] + 0.5)) for t in vocabulary}
        postings = []
        for k, c in enumerate(counts):
            norm = K1 * (1 - B + B * len(known[k][1]) / totals.mean)
            weight = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in c.items()}
            own = sum(weight.values())
            postings += [(vocabulary[t], k, w / own) for t, w in weight.items()]
        postings.sort()
        term = np.array([p[0] for p in postings], np.int64)
        item = np.array([p[1] for p in postings], np.int64)
        impact = np.array([p[2] for p in postings], np.float32)
        blocks = -(-len(known) // BLOCK_ITEMS)
        block_max = np.zeros((len(vocabulary), blocks), np.float32)
        if len(term):
            np.maximum.at(block_max, (term, item // BLOCK_ITEMS), impact)
        first = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        stride = max(MIN_STRIDE, totals.longest)
        return Index([i for i, _ in known], [w for _, w in known], vocabulary, first, item, impact, block_max, stride)

    def score(self, terms: np.ndarray) -> np.ndarray:
        """Full scores of all items for distinct terms."""
        out = np.zeros(len(self.ids))
        for t in terms:
            at = slice(self.first[t], self.first[t + 1])
            out[self.items[at]] += self.impacts[at]
        return out

    def search(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """``(passage, item, score)`` of all items at or above the threshold.

        Passages are two strides long and start at every stride, so whatever
        is no longer than the longest item lies whole in one of them.
        """
        if not self.ids:
            return []
        term = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
        place = np.flatnonzero(term >= 0)
        if not len(place):
            return []
        size = len(self.vocabulary)
        keys = np.unique(place // self.stride * size + term[place])
        cell, kind = keys // size, keys % size
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        cells = cell[starts]
        ends = np.append(starts[1:], len(cell))
        bound = np.zeros((int(cells[-1]) + 2, self.block_max.shape[1]), np.float32)
        for at in range(0, len(starts), 4096):
            part = starts[at : at + 4096]
            rows = self.block_max[kind[part[0] : ends[min(at + 4096, len(starts)) - 1]]]
            bound[cells[at : at + 4096]] = np.add.reduceat(rows, part - part[0], axis=0)
        passages = np.flatnonzero((bound[:-1] + bound[1:]).max(1) >= THRESHOLD - 1e-4)
        out = []
        for p in passages.tolist():
            lo, hi = np.searchsorted(cell, (p, p + 2))
            terms = np.unique(kind[lo:hi])
            blocks = np.flatnonzero(self.block_max[terms].sum(0) >= THRESHOLD - 1e-4)
            if len(blocks):
                score = self.score(terms)
                out += [(p, k, float(score[k])) for k in np.flatnonzero(score >= THRESHOLD).tolist()]
        return out

    def matches(self, text: str | None) -> dict[int, tuple[float, float, float, float]]:
        """``item_id -> (score, overlap, question, answer)`` of every item a
        passage holds: at least ``OVERLAP`` of its shingles, and
        ``PART_OVERLAP`` of the distinct words of its first three quarters
        (the question) and of its rest (the answer); the best passage counts."""
        words = words_of(text)
        found: dict[int, tuple[float, float, float, float]] = {}
        for p, k, score in self.search(words):
            passage = words[p * self.stride : (p + 2) * self.stride]
            own = self.words[k]
            mine = shingles(own)
            width = min(SHINGLE, len(own))
            there = {tuple(passage[j : j + width]) for j in range(len(passage) - width + 1)}
            overlap = len(mine & there) / len(mine)
            cut = max(1, len(own) * 3 // 4)
            has = set(passage)
            question, answer = set(own[:cut]), set(own[cut:]) or set(own)
            parts = [len(x & has) / len(x) for x in (question, answer)]
            if overlap >= OVERLAP and min(parts) >= PART_OVERLAP:
                best = (score, overlap, *parts)
                found[self.ids[k]] = max(found.get(self.ids[k], best), best)
        return found


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per item its number of words and the distinct ones."""
    for batch in batches:
        words = [words_of(t.as_py()) for t in batch.column("text")]
        columns = [batch.column("item_id"), batch.column("digest"), pa.array([len(w) for w in words], pa.int64())]
        terms = pa.array([sorted(set(w)) for w in words], pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([*columns, terms], ["item_id", "digest", "size", "terms"])


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes over all items, each of at most ``PASS_ITEMS`` items or
    ``PASS_BYTES`` of text (a longer item is one of its own), so what is
    sent to the executors at once is bounded. Items come one partition at a
    time, each with the frequencies of its words in the whole benchmark, so
    scores do not depend on the slices. Null texts and texts without words
    are in no index; rows with equal ids and texts count once."""
    rows = benchmark.where("item_id is not null and text is not null")
    rows = rows.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    rows, _ = settle(rows.withColumn("digest", F.unhex(F.sha2("text", 256))), "items")
    words = rows.mapInArrow(_item_words, "item_id long, digest binary, size long, terms array<binary>")
    words, _ = settle(words.where("size > 0"), "item-words")
    n, total, longest = words.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    if not n:
        return
    totals = Totals(n, total / n, longest)
    posted = words.select("item_id", "digest", F.explode("terms").alias("term"))
    frequency, _ = settle(posted.groupBy("term").agg(F.count("*").alias("n")), "frequencies")
    met = posted.join(frequency, "term").groupBy("item_id", "digest")
    known = rows.join(met.agg(F.collect_list(F.struct("term", "n")).alias("found")), ["item_id", "digest"])
    held: list[tuple[int, str]] = []
    counts: dict[bytes, int] = {}
    size = 0
    for row in known.select("item_id", "text", "found").orderBy("item_id", "text").toLocalIterator():
        if held and (len(held) >= PASS_ITEMS or size + len(row["text"]) > PASS_BYTES):
            yield Index.build(held, totals, counts)
            held, counts, size = [], {}, 0
        held.append((row["item_id"], row["text"]))
        counts.update((bytes(term), n) for term, n in row["found"])
        size += len(row["text"])
    if held:
        yield Index.build(held, totals, counts)


SCHEMA = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it, best passage.

    Every passage of every whole text queries every item. Null and empty
    texts hold nothing; a null doc_id is reported as null; repeated rows with
    one doc_id give one row per item; other columns are not read. An empty
    table on either side gives an empty result.
    """
    spark = docs.sparkSession
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    slices = indexes(benchmark)
    first, second = next(slices, None), next(slices, None)
    if first is None:
        return spark.createDataFrame([], SCHEMA)
    if second is None:
        out = thin.mapInArrow(_finder(spark.sparkContext.broadcast(first)), SCHEMA)
    else:
        out = _by_slice(spark, chain((first, second), slices), lambda sent: thin.mapInArrow(_finder(sent), SCHEMA))
    best = F.max(F.struct("score", "overlap", "question_overlap", "answer_overlap")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _by_slice(spark: SparkSession, slices: Iterator[Index], job: Callable[[Broadcast[Index]], DataFrame]) -> DataFrame:
    """The rows a job gives for each slice. They are written, and the slice's
    index is taken from the executors, before the next one is sent."""
    folder = scratch_folder(spark, "slices")
    for index in slices:
        sent = spark.sparkContext.broadcast(index)
        rows = job(sent)
        rows.write.mode("append").parquet(folder)
        sent.destroy()
    return spark.read.schema(rows.schema).parquet(folder)


def _finder(sent: Broadcast[Index]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [
                (ids[k], item, *values)
                for k, text in enumerate(batch.column("text"))
                for item, values in sent.value.matches(text.as_py()).items()
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 2 + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"],
            )

    return find


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns. No shuffle
    where the benchmark is one slice; else texts that hold an item are met
    again by their SHA-256."""
    slices = indexes(benchmark)
    first, second = next(slices, None), next(slices, None)
    if second is None:
        return docs.where(~_holds(docs.sparkSession.sparkContext.broadcast(first))("text")) if first else docs
    digest, name = F.sha2("text", 256), fresh(docs, "__text")
    held = _by_slice(docs.sparkSession, chain((first, second), slices), lambda sent: docs.where(_holds(sent)("text")).select(digest.alias(name)))
    return docs.withColumn(name, digest).join(held, name, "left_anti").drop(name)


def _holds(sent: Broadcast[Index]):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(sent.value.matches(t)) for t in texts], dtype=bool)

    return holds
