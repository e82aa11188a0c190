"""Removal of repeated byte strings by column-wise collection transforms.

A byte goes if a string of ``WINDOW`` bytes over it also starts earlier. Two
equal strings hold the same anchor, the stretch of ``ANCHOR`` bytes whose hash
is smallest; so every text is cut into segments, each all strings of one
anchor, of less than twice ``WINDOW`` bytes. Segments of equal anchors meet in
one task. There a collection's Burrows-Wheeler transform and its common
prefixes are built column by column: every round inserts one more symbol of
each segment, from the last one backwards, and updates both. Where the common
prefix reaches ``WINDOW`` bytes, strings are equal, and all but the first go.

As segments are short, the rounds do not grow with the longest text, and the
collections that would lie in sequential external files are streams of
Spark's sorted shuffle, a bounded batch of segments at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_starts, grouped_batches, partitions, settle

WINDOW = 100
ANCHOR = 32
BUFFER = 1 << 21
POSITION_BITS = 23
CORE = ANCHOR + (WINDOW - ANCHOR) // 2
CORE_BITS = 28
PLACE_MAP_BITS = 26
BUCKET_BITS = 12
HOT = 2_000
HOT_ANCHORS = 1_000_000
SPLIT = 4
PACKED = 10
SALTS = 16
HELD_PARTS = 100_000
MOST = 20_000
BATCH_SEGMENTS = 2_000
END = 255
PLACE_BITS = 24
FIRST_ID = -(2**63)
BASE = 0x9E3779B97F4A7C15


def column_transform(strings: list[bytes], cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(string, offset, prefix)`` of all suffixes of a collection in
    lexical order; ``prefix`` is the common prefix with the suffix before, at
    most ``cap`` (below 255). Bytes must be below 255, which holds for UTF-8.

    Round ``t`` inserts the suffixes of length ``t + 1``: the transform holds
    the symbol before each suffix, so the place of the longer suffix follows
    from the order of equal symbols, and its common prefixes are one more than
    the least ones between the neighbouring occurrences of its symbol.
    """
    m = len(strings)
    size = np.fromiter(map(len, strings), np.int64, m)
    if size.sum() + m > 1 << PLACE_BITS:
        raise ValueError("the collection is too large for one batch")
    rounds = int(size.max(initial=0))
    symbols = np.full((rounds + 1, m), END, np.uint8)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    owner = np.repeat(np.arange(m), size)
    ends = np.cumsum(size)
    symbols[ends[owner] - 1 - np.arange(len(flat)), owner] = flat
    before, prefix, place = symbols[0].copy(), np.zeros(m, np.uint8), np.arange(m)
    active = np.arange(m)
    for t in range(rounds):
        active = active[size[active] > t]
        order = _by_symbol(before)
        q = _occurrence(order, before, place[active])
        low = _least_before(order, prefix, q, cap)
        after = q[q + 1 < len(order)] + 1
        high = _least_before(order, prefix, after, cap)
        new = m + q
        old = np.ones(len(before) + len(active), bool)
        old[new] = False
        grown, longer = np.empty(len(old), np.uint8), np.empty(len(old), np.uint8)
        grown[old], longer[old] = before, prefix
        grown[new] = symbols[t + 1][active]
        inside = order[after] >> PLACE_BITS != END
        longer[m + after[inside]] = high[inside]
        longer[new] = low
        before, prefix = grown, longer
        place[active] = new
    order = _by_symbol(before)
    string, offset = np.empty(len(before), np.int64), np.empty(len(before), np.int64)
    at, active = np.arange(m), np.arange(m)
    for t in range(rounds + 1):
        string[at], offset[at] = active, size[active] - t
        going = size[active] > t
        active, at = active[going], m + _occurrence(order, before, at[going])
    return string, offset, prefix


def _by_symbol(before: np.ndarray) -> np.ndarray:
    """All places by symbol, then place: the order of the suffixes that are
    one symbol longer. Symbol and place share a 32-bit number."""
    order = before.astype(np.uint32) << np.uint32(PLACE_BITS)
    order |= np.arange(len(before), dtype=np.uint32)
    order.sort()
    return order


def _occurrence(order: np.ndarray, before: np.ndarray, place: np.ndarray) -> np.ndarray:
    key = before[place].astype(np.uint32) << np.uint32(PLACE_BITS) | place.astype(np.uint32)
    return np.searchsorted(order, key)


def _least_before(order: np.ndarray, prefix: np.ndarray, q: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the ``q``-th occurrence's longer suffix and the one
    before it: 0 where the symbol before is another one."""
    out = np.zeros(len(q), np.uint8)
    here, earlier = order[q], order[np.maximum(q - 1, 0)]
    same = np.flatnonzero((q > 0) & (here >> PLACE_BITS == earlier >> PLACE_BITS))
    if len(same):
        mask = np.uint32((1 << PLACE_BITS) - 1)
        low = (earlier[same] & mask).astype(np.int64) + 1
        line = np.argsort(low)  # reduceat also runs over the gaps between the stretches: keep them short
        same = same[line]
        bounds = np.stack([low[line], (here[same] & mask).astype(np.int64) + 1], 1).ravel()
        least = np.minimum.reduceat(np.append(prefix, 0), bounds)[::2]
        out[same] = np.minimum(least.astype(np.int64) + 1, cap)
    return out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _POWERS:
        with np.errstate(over="ignore"):
            up = np.full(n, BASE, np.uint64)
            down = np.full(n, pow(BASE, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            _POWERS[n] = np.cumprod(up), np.cumprod(down)
    return _POWERS[n]


def prefix_sums(buffer: np.ndarray) -> np.ndarray:
    """Sums that give a hash of any stretch of the buffer."""
    up, _ = _powers(BUFFER + 2 * WINDOW)
    with np.errstate(over="ignore"):
        return np.concatenate(([np.uint64(0)], np.cumsum(buffer.astype(np.uint64) * up[: len(buffer)])))


def stretch_hashes(sums: np.ndarray, start: np.ndarray | slice, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each start."""
    _, down = _powers(BUFFER + 2 * WINDOW)
    with np.errstate(over="ignore"):
        if isinstance(start, slice):
            x = (sums[size:] - sums[:-size]) * down[: len(sums) - size]
        else:
            x = (sums[start + size] - sums[start]) * down[start]
        return _mixed(x)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def least_of_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """``(piece, first, last, anchor, hash)`` of every segment of the pieces
    ``buffer[starts:ends]``: the strings that start from ``first`` to ``last``
    share the anchor at ``anchor``."""
    if len(buffer) < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    hashes = stretch_hashes(prefix_sums(buffer) if sums is None else sums, slice(None), ANCHOR)
    keep = np.uint64(2**64 - 2**POSITION_BITS)
    marked = (hashes & keep) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (least_of_windows(marked, WINDOW - ANCHOR + 1) & ~keep).astype(np.int64)
    piece = np.repeat(np.arange(len(starts)), ends - starts)[: len(anchor)]
    inside = np.arange(len(anchor)) + WINDOW <= ends[piece]
    change = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    new, last = inside.copy(), inside.copy()
    new[1:] &= change | ~inside[:-1]
    last[:-1] &= change | ~inside[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(last)
    return piece[first], first, last, anchor[first], hashes[anchor[first]]


def core_hashes(sums, first, last, anchor) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every segment: a hash of the anchor with as many bytes before it as
    make ``CORE``, whether one of its strings holds them, and the same for the
    bytes after it. Each string of a segment holds one or the other, so of
    two equal strings the cores are equal as well."""
    before, after = anchor - (CORE - ANCHOR), anchor
    has_before, has_after = first <= before, last >= before
    room = len(sums) - 1 - CORE
    left = stretch_hashes(sums, np.clip(before, 0, room), CORE) ^ np.uint64(1)
    return left, has_before, stretch_hashes(sums, np.clip(after, 0, room), CORE), has_after


def buffers(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(bytes, starts, ends, row, base)``: a batch's texts laid side by side
    in bounded buffers. A text longer than a buffer comes in pieces that
    overlap by one string less a byte, so each string is whole in one piece."""
    held, rows, bases, size = [], [], [], 0
    for k, text in enumerate(batch.column("text")):
        raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(raw) - WINDOW + 1), BUFFER):
            piece = raw[at : at + BUFFER + WINDOW - 1]
            if len(piece) < WINDOW:
                continue
            if size + len(piece) > BUFFER + WINDOW and held:
                yield _laid(held, rows, bases)
                held, rows, bases, size = [], [], [], 0
            held.append(piece)
            rows.append(k)
            bases.append(at)
            size += len(piece)
    if held:
        yield _laid(held, rows, bases)


def _laid(held, rows, bases):
    ends = np.cumsum([len(p) for p in held])
    return b"".join(held), np.append(0, ends[:-1]), ends, np.array(rows), np.array(bases)


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans per owner, those that touch or overlap joined."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    if not len(owner):
        return owner, start, end
    shift = owner * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.append(True, start[1:] + shift[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return owner[at], start[at], (reach - shift)[np.append(at[1:], len(owner)) - 1]


ROWS = pa.schema(
    [("key", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("content", pa.binary()), ("salt", pa.int64())]
)
ROWS_DDL = "key long, doc long, tie long, start long, end long, content binary, salt long"
MARKS = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
MARKS_DDL = "doc long, tie long, start long, end long"
KEPT = ["key", *MARKS.names, "content"]
KEPT_DDL = "key long, doc long, tie long, start long, end long, content binary"
THIN_DDL = "key long, same long, doc long, tie long, start long, end long, sealed boolean"
FOUND_DDL = "key long, place long, doc long, tie long, start long, end long"


def _cores(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Hashes of all cores of a batch, sorted, one row per bucket (their
    leading bits) with the next 32 bits of each; a core met again in the batch
    comes twice."""
    for batch in batches:
        found = [np.zeros(0, np.uint64)]
        for raw, starts, ends, _, _ in buffers(batch):
            buffer = np.frombuffer(raw, np.uint8)
            sums = prefix_sums(buffer)
            _, first, last, anchor, _ = segments(buffer, starts, ends, sums)
            left, has_left, right, has_right = core_hashes(sums, first, last, anchor)
            found += [left[has_left], right[has_right]]
        own, n = np.unique(np.concatenate(found), return_counts=True)
        own = np.repeat(own, np.minimum(n, 2))
        bucket = (own >> np.uint64(64 - bits)).astype(np.int64)
        low = (own >> np.uint64(32 - bits)).astype("<u4")
        at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(own) else np.zeros(0, np.int64)
        blobs = [low[s:e].tobytes() for s, e in zip(at.tolist(), [*at[1:].tolist(), len(own)], strict=True)] if len(own) else []
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "low"])


def _repeated_cores(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Per bucket the part of the bitmap with all cores that occur twice."""
    width = CORE_BITS - bits
    for table in grouped_batches(batches, ["bucket"], 1_000):
        bucket, low = table.column("bucket").to_numpy(), table.column("low").to_pylist()
        at = np.append(group_starts(table, ["bucket"]), len(bucket)).tolist()
        parts = []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            all_of = np.sort(np.frombuffer(b"".join(low[lo:hi]), "<u4"))
            twice = all_of[1:][all_of[1:] == all_of[:-1]]
            here = np.zeros(1 << width, bool)
            here[twice >> np.uint32(32 - width)] = True
            parts.append(np.packbits(here, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]], pa.int32()), pa.array(parts, pa.binary())], ["bucket", "part"])


def core_bitmap(texts: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the hashes of cores that occur more than
    once. Hashes move sorted and packed, four bytes each; a bucket of them is
    one task's, and there are more buckets than tasks. That another core
    shares a bit costs a comparison later, never a result."""
    n = partitions(texts.sparkSession)
    bits = min(max(BUCKET_BITS, n.bit_length() + 4), CORE_BITS - 3)
    sent = texts.mapInArrow(lambda batches: _cores(batches, bits), "bucket int, low binary")
    dealt = sent.repartition(n, "bucket").sortWithinPartitions("bucket")
    parts = dealt.mapInArrow(lambda batches: _repeated_cores(batches, bits), "bucket int, part binary").toArrow()
    size = 1 << (CORE_BITS - bits - 3)
    bitmap = np.zeros((1 << bits, size), np.uint8)
    for bucket, part in zip(parts.column("bucket").to_pylist(), parts.column("part").to_pylist(), strict=True):
        bitmap[bucket] = np.frombuffer(part, np.uint8)
    return bitmap.ravel()


def _set(hashes: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _place(doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of where a segment lies."""
    x = _mixed(doc.astype(np.int64).view(np.uint64) + np.uint64(BASE))
    x = _mixed(x ^ tie.astype(np.int64).view(np.uint64))
    return _mixed(x ^ start.astype(np.int64).view(np.uint64))


def _candidates(batch, cores) -> Iterator[tuple]:
    """Segments of which a core repeats, cut to the strings that hold one:
    ``(bytes, owner, first, last, anchor, hash, shift)`` per buffer."""
    for raw, starts, ends, row, base in buffers(batch):
        buffer = np.frombuffer(raw, np.uint8)
        sums = prefix_sums(buffer)
        piece, first, last, anchor, hashes = segments(buffer, starts, ends, sums)
        left, has_left, right, has_right = core_hashes(sums, first, last, anchor)
        left, right = has_left & _set(left, cores, CORE_BITS), has_right & _set(right, cores, CORE_BITS)
        middle = anchor - (CORE - ANCHOR)
        last = np.where(right, last, np.minimum(last, middle))
        first = np.where(left, first, np.maximum(first, middle))
        pick = np.flatnonzero(left | right)
        yield raw, row[piece[pick]], first[pick], last[pick], anchor[pick], hashes[pick], (base - starts)[piece[pick]]


def _thin(batch, cores) -> Iterator[pa.RecordBatch]:
    """Candidates as hashes and places. Of equal ones in a buffer only the
    first goes on; the others are spans to remove already (``sealed``)."""
    doc, tie = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
    for raw, owner, first, last, _, hashes, shift in _candidates(batch, cores):
        digest = xxhash.xxh3_64_intdigest
        same = np.fromiter((digest(raw[a : b + WINDOW]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))
        order = np.lexsort((first + shift, tie[owner], doc[owner], same, hashes))
        again = np.zeros(len(order), bool)
        a, b = order[1:], order[:-1]
        again[1:] = (hashes[a] == hashes[b]) & (same[a] == same[b])
        gone, kept = order[again], order[~again]
        who, start, end = merged(owner[gone], first[gone] + shift[gone], last[gone] + shift[gone] + WINDOW)
        spread = _place(doc[who], tie[who], start).view(np.int64)
        columns = [
            np.concatenate([spread, hashes[kept].view(np.int64)]),
            np.concatenate([spread, same[kept].view(np.int64)]),
            np.concatenate([doc[who], doc[owner[kept]]]),
            np.concatenate([tie[who], tie[owner[kept]]]),
            np.concatenate([start, first[kept] + shift[kept]]),
            np.concatenate([end, last[kept] + shift[kept] + WINDOW]),
            np.repeat([True, False], [len(who), len(kept)]),
        ]
        names = ["key", "same", *MARKS.names, "sealed"]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by ``(key, same, doc, tie, start)``: the first of equal
    segments as ``(key, place)``, the others as spans to remove."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, same, doc, tie, start, end = (batch.column(c).to_numpy() for c in ("key", "same", *MARKS.names))
        sealed = batch.column("sealed").to_numpy(zero_copy_only=False)
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (same[1:] == same[:-1]) & ~sealed[1:] & ~sealed[:-1]
        if before is not None:
            again[0] = before == (key[0], same[0], False) and not sealed[0]
        before = (key[-1], same[-1], bool(sealed[-1]))
        gone, first = np.flatnonzero(again | sealed), np.flatnonzero(~again & ~sealed)
        n, m = len(gone), len(first)
        place = _place(doc[first], tie[first], start[first]).view(np.int64)
        arrays = [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x)]) for x in (key[first], place)]
        arrays += [pa.concat_arrays([pa.array(x[gone]), pa.nulls(m, pa.int64())]) for x in (doc, tie, start, end)]
        yield pa.RecordBatch.from_arrays(arrays, ["key", "place", *MARKS.names])


def _contents(batch, cores, places, crowded, packed=()) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments that the bitmap of places names. Those of a
    crowded anchor come in parts (``salt`` from 0 on), of equal parts in a
    batch the first one; the others are spans to remove already (no content)."""
    doc, tie = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
    best: dict[tuple[int, bytes], tuple[int, ...]] = {}
    gone: list[tuple[int, ...]] = []
    for raw, owner, first, last, anchor, hashes, shift in _candidates(batch, cores):
        named = _set(_place(doc[owner], tie[owner], first + shift), places, PLACE_MAP_BITS)
        busy, single = np.isin(hashes.view(np.int64), crowded), np.isin(hashes.view(np.int64), packed)
        plain = np.flatnonzero(named & ~busy)
        who, start, end, move = owner[plain], first[plain], last[plain] + WINDOW, shift[plain]
        content = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        yield _rows(hashes[plain].view(np.int64), doc[who], tie[who], start + move, end + move, content, np.full(len(plain), -1))
        for k in np.flatnonzero(named & busy):
            who, move, width = int(owner[k]), int(shift[k]), 1 if single[k] else SPLIT
            for key, a, b in _split(raw, *(int(x[k]) for x in (first, last, anchor, hashes)), width):
                here = (int(doc[who]), int(tie[who]), a + move, b + move, who)
                met = best.setdefault((key, raw[a:b]), here)
                if met is not here:
                    best[key, raw[a:b]] = min(met, here)
                    gone.append(max(met, here)[2:])
            if len(best) >= HELD_PARTS:
                yield _parts(best)
                best = {}
    if best:
        yield _parts(best)
    start, end, who = np.array(gone, np.int64).reshape(-1, 3).T
    who, start, end = merged(who, start, end)
    spread = _place(doc[who], tie[who], start).view(np.int64)
    yield _rows(spread, doc[who], tie[who], start, end, [None] * len(who), np.full(len(who), -1))


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, ROWS.types, strict=True)], schema=ROWS)


def _parts(best: dict[tuple[int, bytes], tuple[int, ...]]) -> pa.RecordBatch:
    doc, tie, start, end, _ = np.array(list(best.values()), np.int64).T
    salt = (_place(doc, tie, start) % np.uint64(SALTS)).astype(np.int64)
    return _rows([k for k, _ in best], doc, tie, start, end, [c for _, c in best], salt)


def _split(raw: bytes, first: int, last: int, anchor: int, name: int, width: int) -> Iterator[tuple[int, int, int]]:
    """``(key, start, end)``: a segment of a crowded anchor in parts of at
    most ``width`` strings, by their distance from the anchor. All strings of
    a part hold its core, so equal ones still meet under the core's hash, but
    no longer all segments of the anchor: those with one core differ in a few
    bytes only, and in none where the part is a single string."""
    for r in range((anchor - last) // width, (anchor - first) // width + 1):
        high = anchor - r * width
        core = raw[high : high - width + 1 + WINDOW]
        key = xxhash.xxh3_64_intdigest(core, seed=(name + r) % 2**64)
        yield key - 2**64 if key >= 2**63 else key, max(first, high - width + 1), min(last, high) + WINDOW


def _compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Whole groups of one key and salt: spans to remove, and of equal parts
    the first one, which goes on with its key and content."""
    known = table.column("content").is_valid().to_numpy()
    part = table.column("salt").to_numpy() >= 0
    parts = table.filter(pa.array(part))
    best, gone = _firsts_of(parts)
    spans = [table.filter(pa.array(~known)), parts.take(pa.array(gone, pa.int64()))]
    spans += [pa.Table.from_batches([b]) for b in _repeats(table.filter(pa.array(known & ~part)))]
    for marks in spans:
        n = marks.num_rows
        columns = [pa.nulls(n, pa.int64()), *(marks.column(c) for c in MARKS.names), pa.nulls(n, pa.binary())]
        yield from pa.table(columns, names=KEPT).to_batches()
    yield from parts.take(pa.array(best, pa.int64())).select(KEPT).to_batches()


def _firsts_of(table: pa.Table) -> tuple[list[int], list[int]]:
    """Rows whose key and content no smaller row has, and the others."""
    where = list(zip(*(table.column(c).to_pylist() for c in ("doc", "tie", "start")), strict=True))
    best: dict[tuple[int, bytes], int] = {}
    gone: list[int] = []
    for k, name in enumerate(zip(table.column("key").to_pylist(), table.column("content").to_pylist(), strict=True)):
        other = best.setdefault(name, k)
        if other != k:
            best[name], lost = (k, other) if where[k] < where[other] else (other, k)
            gone.append(lost)
    return list(best.values()), gone


def _repeats(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Spans to remove among the segments of whole key groups."""
    doc, tie, start, end = (table.column(c).to_numpy() for c in MARKS.names)
    content = table.column("content").to_pylist()
    at = np.append(group_starts(table, ["key"]), len(doc)).tolist()
    gone: list[int] = []
    collection: list[int] = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo < 2:
            continue
        best: dict[bytes, int] = {}
        for k in range(lo, hi):
            other = best.setdefault(content[k], k)
            if other != k:
                here = (doc[k], tie[k], start[k]) < (doc[other], tie[other], start[other])
                best[content[k]], lost = (k, other) if here else (other, k)
                gone.append(lost)
        if len(best) > MOST:
            yield _equal_in_many(doc, tie, start, content, list(best.values()))
        elif len(best) > 1:
            collection += best.values()
            if len(collection) >= BATCH_SEGMENTS:
                yield _equal_strings(doc, tie, start, content, collection)
                collection = []
    if collection:
        yield _equal_strings(doc, tie, start, content, collection)
    pick = np.array(gone, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(x[pick]) for x in (doc, tie, start, end)], schema=MARKS)


def _equal_strings(doc, tie, start, content, collection: list[int]) -> pa.RecordBatch:
    pick = np.array(collection)
    string, offset, prefix = column_transform([content[k] for k in collection], WINDOW)
    size = np.fromiter((len(content[k]) for k in collection), np.int64, len(collection))
    group = np.cumsum(prefix < WINDOW)
    whole = np.flatnonzero(size[string] - offset >= WINDOW)
    group, string, offset = group[whole], string[whole], offset[whole]
    d, t, s = doc[pick][string], tie[pick][string], start[pick][string] + offset
    order = np.lexsort((s, t, d, group))
    later = order[1:][group[order[1:]] == group[order[:-1]]]
    who, a, b = merged(string[later], s[later], s[later] + WINDOW)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[pick][who], tie[pick][who], a, b)], schema=MARKS)


def _equal_in_many(doc, tie, start, content, group: list[int]) -> pa.RecordBatch:
    """The same spans for a group too large for one transform, string by string."""
    best: dict[bytes, tuple[int, ...]] = {}
    gone: list[tuple[int, ...]] = []
    for k in group:
        d, t, s, raw = int(doc[k]), int(tie[k]), int(start[k]), content[k]
        for at in range(len(raw) - WINDOW + 1):
            here, string = (d, t, s + at, k), raw[at : at + WINDOW]
            met = best.setdefault(string, here)
            if met is not here:
                best[string] = min(met, here)
                gone.append(max(met, here))
    _, _, s, k = np.array(gone, np.int64).reshape(-1, 4).T
    who, a, b = merged(k, s, s + WINDOW)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[who], tie[who], a, b)], schema=MARKS)


def repeated_spans(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """``(doc, tie, start, end)`` byte spans of ``texts (doc, tie, text)``
    whose strings all start earlier elsewhere; spans may overlap.

    Texts are cut three times rather than moved: first the hashes of all
    cores go to their buckets, then the candidates' hashes and places, last
    the bytes of those segments that share an anchor but differ, which is
    what the transform compares.

    Anchors of more than ``hot`` differing segments are cut into parts around
    a core, those of more than ``PACKED`` times as many into single strings.
    Of equal parts one a batch is sent, and of these one a salted group goes
    on; so a group has at most as many rows as an anchor that is not packed
    has segments, or ``SALTS``.
    """
    spark = texts.sparkSession
    n, sc = partitions(spark), spark.sparkContext
    cores = sc.broadcast(core_bitmap(texts.select("text")))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _thin(batch, cores.value)

    met = texts.mapInArrow(thin, THIN_DDL).repartition(n, "key", "same")
    met = met.sortWithinPartitions("key", "same", "doc", "tie", "start")
    found, _ = settle(met.mapInArrow(_firsts, FOUND_DDL), "firsts")
    equal = found.where("key is null").select(*MARKS.names)

    several, _ = settle(found.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    total = several.agg(F.sum("n")).first()[0] or 0
    limit = max(hot, total // HOT_ANCHORS)
    crowded = several.where(F.col("n") > limit).toArrow()
    names, counts = crowded.column("key").to_numpy(), crowded.column("n").to_numpy()
    busy = (np.sort(names), np.sort(names[counts > PACKED * limit]))
    differing = found.where("key is not null").join(several.select("key"), "key", "left_semi")
    sent = sc.broadcast((_bitmap(differing, "place", PLACE_MAP_BITS), *busy))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _contents(batch, cores.value, *sent.value)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches, ["key", "salt"], 20_000):
            yield from _compared(table)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches, ["key"], 20_000):
            yield from _repeats(table)

    dealt = texts.mapInArrow(contents, ROWS_DDL).repartition(n, "key", "salt").sortWithinPartitions("key", "salt")
    met, _ = settle(dealt.mapInArrow(compare, KEPT_DDL), "spans")
    partly = met.where("key is null").select(*MARKS.names)
    if len(names):
        kept = met.where("key is not null").repartition(n, "key").sortWithinPartitions("key")
        parted, _ = settle(kept.mapInArrow(last, MARKS_DDL), "parted")
        partly = partly.unionByName(parted)
    return equal.unionByName(partly)


def _bitmap(rows: DataFrame, name: str, bits: int) -> np.ndarray:
    """A bitmap of ``2 ** bits`` over the leading bits of a hash column."""
    at = F.shiftrightunsigned(name, 64 - bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({name}, {64 - bits}) & 63 as int))")
    words = rows.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.astype("<i8").view(np.uint8)


def numbered(docs: DataFrame) -> DataFrame:
    """``(doc, tie, copies, text)``: a null doc_id is the smallest id; ``tie``
    is 0, or a hash of the text where several rows have one id; rows equal in
    id and text are one with ``copies``."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("doc"), "text", F.col("doc_id").isNull().alias("unnamed"))
    shared, _ = settle(rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc").alias("__d")), "shared-ids")
    if shared.isEmpty():
        return rows.select("doc", F.lit(0).cast("long").alias("tie"), F.lit(1).cast("long").alias("copies"), "unnamed", "text")
    met = rows.join(shared, F.col("doc") == F.col("__d"), "left").withColumn("tie", F.when(F.col("__d").isNotNull(), F.xxhash64("text")).otherwise(0))
    whole = met.groupBy("doc", "tie", "unnamed", "text").agg(F.count("*").alias("copies"))
    return settle(whole.select("doc", "tie", "copies", "unnamed", "text"), "texts")[0]


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans)`` of every
    row of ``docs``: what goes, in maximal spans of bytes, and the hash of
    what stays.

    A null text is empty. A null doc_id is smaller than any other; rows with
    one doc_id stand in the order of a hash of their text, and of rows equal
    in both one is first and the others go whole (if long enough). Other
    columns are not read; an empty table gives an empty one.
    """
    texts = numbered(docs)
    spans = repeated_spans(texts.select("doc", "tie", "text"), hot).groupBy("doc", "tie")
    listed = spans.agg(F.collect_list(F.struct("start", "end")).alias("found"))
    listed = listed.select(F.col("doc").alias("__d"), F.col("tie").alias("__t"), "found")
    met = texts.join(listed, (F.col("doc") == F.col("__d")) & (F.col("tie") == F.col("__t")), "left")

    @F.pandas_udf(RESULT_TYPE)
    def judge(text: pd.Series, found: pd.Series, first: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_judged(*row) for row in zip(text, found, first, strict=True)], columns=NAMES)

    each = met.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    out = each.select(
        F.when(~F.col("unnamed"), F.col("doc")).alias("doc_id"), judge("text", "found", F.col("k") == 1).alias("r")
    )
    return out.select("doc_id", "r.*")


NAMES = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
RESULT_TYPE = RESULT


def _judged(text: str | None, found, first: bool) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not first:
        found = [{"start": 0, "end": len(raw)}] if len(raw) >= WINDOW else []
    spans = [] if found is None else [(s["start"], s["end"]) for s in found]
    a = np.array(spans, np.int64).reshape(-1, 2)
    _, start, end = merged(np.zeros(len(a), np.int64), a[:, 0], a[:, 1])
    kept, at = hashlib.sha256(), 0
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        kept.update(raw[at:s])
        at = e
    kept.update(raw[at:])
    listed = [{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    return len(raw), int((end - start).sum()), len(start), kept.hexdigest(), listed
