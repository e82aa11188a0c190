"""Exact duplicates: compressed radix tries over whole texts.

Texts are dealt by length and content hash; every task inserts the full
bytes into one Patricia trie, whose terminal nodes hold the owner of a text.
A trie that outgrows its memory spills whole subtrees, which other tasks go
on with in a next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, settle

TRIE_BYTES = 96_000_000
NODE_BYTES = 400
BATCH_BYTES = 8_000_000

PIECES = "uid long, doc_id long, terminal long, sha string, length long, hash long, raw binary, owner long, owner_uid long, n long"
OWNERS = "terminal long, keep_id long, owner_uid long, group_size long, subtree long, raw binary, n long"


class Node:
    __slots__ = ("label", "children", "entry", "spilled")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.entry = None
        self.spilled = 0


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """How many bytes ``a`` and ``b[at:]`` share, found by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A radix trie over byte strings with an entry per string.

    ``size`` estimates its memory. :meth:`spill` gives up the largest
    subtree of at most half the limit: its strings leave with the subtree's
    mark, and strings inserted below it later are told that mark.
    """

    def __init__(self):
        self.root = Node(b"")
        self.size = 0

    def insert(self, text: bytes) -> Node:
        """The terminal node of ``text``, or the spilled node on its way."""
        node, at, end = self.root, 0, len(text)
        while at < end and not node.spilled:
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.size += end - at + NODE_BYTES
                return child
            label = child.label
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = common_prefix(label, text, at)
            fork = node.children[text[at]] = Node(label[:k])
            fork.children[label[k]] = child
            child.label = label[k:]
            self.size += NODE_BYTES
            node, at = fork, at + k
        return node

    def strings(self, top: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, object]]:
        """``(text, entry)`` of all strings at and below a node."""
        stack = [(top or self.root, prefix)]
        while stack:
            node, text = stack.pop()
            if node.entry is not None:
                yield text, node.entry
            stack += [(c, text + c.label) for c in node.children.values()]

    def entries(self) -> Iterator[object]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.entry is not None:
                yield node.entry
            stack += node.children.values()

    def spill(self, limit: int, salt: int) -> Iterator[tuple[int, bytes, object]]:
        """Give up one subtree; yields ``(mark, text, entry)`` of its strings.
        A subtree with a spilled part inside stays, so no two marks ever
        compete for one string; the last string stays as well, so every
        round settles some."""
        order = [(self.root, b"")]
        for node, text in order:
            order += [(c, text + c.label) for c in node.children.values()]
        if sum(n.entry is not None for n, _ in order) < 2:
            return
        weight: dict[int, int] = {}
        broken: set[int] = set()
        for node, _ in reversed(order):
            weight[id(node)] = len(node.label) + NODE_BYTES + sum(weight[id(c)] for c in node.children.values())
            if node.spilled or any(id(c) in broken for c in node.children.values()):
                broken.add(id(node))
        whole = [(n, t) for n, t in order if id(n) not in broken and (weight[id(n)] <= limit // 2 or not n.children)]
        if not whole:
            return
        node, text = max(whole, key=lambda x: weight[id(x[0])])
        mark = int.from_bytes(hashlib.sha256(b"%d:" % salt + text).digest()[:8], "little") >> 1 | 1
        for found, entry in self.strings(node, text):
            yield mark, found, entry
        self.size -= weight[id(node)] - NODE_BYTES - len(node.label)
        node.children, node.entry, node.spilled = {}, None, mark


def better(a: tuple, b: tuple) -> tuple:
    """The owner of two ``(id, row)``: the larger id, a missing one least;
    of equal ids the earlier row."""
    return max(a, b, key=lambda o: (o[0] is not None, o[0] or 0, -o[1]))


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _in_batches(rows: Iterable[tuple], raw: int, names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded bytes; ``raw`` is the place of the long column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[raw] or b"") + 64
        if size >= BATCH_BYTES:
            yield _batch(names, kinds, held)
            held, size = [], 0
    if held:
        yield _batch(names, kinds, held)


def _columns(schema: str) -> tuple[list[str], list[pa.DataType]]:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    pairs = [c.split() for c in schema.split(", ")]
    return [n for n, _ in pairs], [kinds[k] for _, k in pairs]


def pieces_of(docs: DataFrame, limit: int) -> DataFrame:
    """Every row with the terminal of its text, and one row per terminal with
    the bytes: copies that lie in one task meet in a trie there, so a large
    group of copies sends one text per task."""
    names, kinds = _columns(PIECES)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        trie = Trie()

        def terminals():
            for raw, (owner, n, terminal, digest) in trie.strings():
                key = int.from_bytes(digest[:8], "little", signed=True)
                yield None, None, terminal, None, len(raw), key, raw, owner[0], owner[1], n

        for batch in batches:
            members = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                raw = raw.lower()
                node = trie.insert(raw)
                if node.entry is None:
                    node.entry = [(doc_id, uid), 1, uid, hashlib.sha256(raw).digest()]
                else:
                    node.entry[0] = better(node.entry[0], (doc_id, uid))
                    node.entry[1] += 1
                members.append((uid, doc_id, node.entry[2], node.entry[3].hex(), *[None] * 6))
                uid += 1
            yield _batch(names, kinds, members)
            if trie.size > limit:
                yield from _in_batches(terminals(), 6, names, kinds)
                trie = Trie()
        yield from _in_batches(terminals(), 6, names, kinds)

    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw")).mapInArrow(collect, PIECES)


def owners_of(pieces: DataFrame, limit: int, salt: int) -> DataFrame:
    """One round: the owner and size of each terminal's text, or, of spilled
    subtrees, the texts themselves with the subtree's mark."""
    names, kinds = _columns(OWNERS)
    fields = ["terminal", "raw", "owner", "owner_uid", "n"]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()

        def spilled(mark, raw, entry):
            for terminal, owner, n in entry:
                yield terminal, owner[0], owner[1], None, mark, raw, n

        def give_up():
            while trie.size > limit:
                size = trie.size
                for mark, raw, entry in trie.spill(limit, salt):
                    yield from spilled(mark, raw, entry)
                if trie.size == size:
                    return

        def rows():
            for batch in batches:
                for terminal, raw, owner, uid, n in zip(*[batch.column(c).to_pylist() for c in fields], strict=True):
                    node = trie.insert(raw)
                    piece = (terminal, (owner, uid), n)
                    if node.spilled:
                        yield from spilled(node.spilled, raw, [piece])
                    elif node.entry is None:
                        node.entry = [piece]
                    else:
                        node.entry.append(piece)
                if trie.size > limit:
                    yield from give_up()
            for entry in trie.entries():
                best, n = entry[0][1], sum(p[2] for p in entry)
                for _, owner, _ in entry:
                    best = better(best, owner)
                for terminal, _, _ in entry:
                    yield terminal, best[0], best[1], n, None, None, None

        yield from _in_batches(rows(), 5, names, kinds)

    return pieces.select(*fields).mapInArrow(own, OWNERS)


def exact_groups(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every row.

    Texts are equal when their bytes are, after A-Z are lower-cased; null
    counts as empty. Of equal texts the row with the largest doc_id stays; a
    row without doc_id stays only where none has one (its ``keep_id`` is then
    null), and of rows equal in doc_id and text exactly one is kept. Other
    columns are not read; an empty table gives an empty result.

    The text moves once, one copy per input task. ``trie_bytes`` bounds a
    task's trie, not the result: what does not fit is spilled by subtree and
    dealt to other tasks in a next round, until nothing is left. Every round
    is a written table.
    """
    spark = docs.sparkSession
    pieces, _ = settle(pieces_of(docs, trie_bytes), "trie-pieces")
    n, rounds = partitions(spark), []
    todo = pieces.where("n IS NOT NULL").repartition(n, "length", "hash")
    while True:
        owned, _ = settle(owners_of(todo, trie_bytes, len(rounds)), "trie-owners")
        rounds.append(owned.where("subtree IS NULL"))
        spilled = owned.where("subtree IS NOT NULL")
        if spilled.isEmpty():
            break
        todo = spilled.withColumnsRenamed({"keep_id": "owner"}).repartition(n, "subtree")
    owners = rounds[0]
    for other in rounds[1:]:
        owners = owners.unionByName(other)
    owners = owners.select("terminal", "keep_id", "owner_uid", "group_size")
    met = pieces.where("uid IS NOT NULL").select("uid", "doc_id", "terminal", "sha").join(owners, "terminal")
    return met.select(
        "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("owner_uid")).alias("kept"), F.col("sha").alias("text_sha256")
    )
