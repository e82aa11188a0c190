"""Dictionary-compressed WARC archives.

A Zstandard dictionary is built from a bounded sample of the records to be
archived. Every archive opens with a skippable frame that holds the
dictionary; then each record is a frame of its own, so a reader needs nothing
but the file and may start at any record.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_folder
from .common import settle

MAGIC = (0x184D2A5D).to_bytes(4, "little")
SAMPLE_RECORDS = 400
SAMPLE_BYTES = 32_768
DICTIONARY_BYTES = 65_536
ARCHIVE_BYTES = 64_000_000
MIN_SHARED = 100
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _header_safe(url: str) -> str:
    """Control characters, blanks and all but ASCII percent-encoded: a field
    cannot be ended by its value."""
    return "".join(chr(b) if 0x21 <= b <= 0x7E else f"%{b:02X}" for b in url.encode("utf-8", "surrogatepass"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with the payload, or a revisit without."""
    block = HTTP + payload if refers_to is None else HTTP
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    fields.append(f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>")
    fields.append(f"WARC-Date: {DATE}")
    if url is not None:
        fields.append(f"WARC-Target-URI: {_header_safe(url)}")
    if page_id is not None:
        fields.append(f"X-Page-ID: {page_id}")
    fields.append(f"WARC-Payload-Digest: sha256:{digest}")
    fields.append(f"X-Payload-Length: {len(payload)}")
    if refers_to is not None:
        fields.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{refers_to}:{digest}')}>")
        fields.append(f"X-Refers-To-Page-ID: {refers_to}")
        fields.append(f"WARC-Profile: {PROFILE}")
    fields.append("Content-Type: application/http; msgtype=response")
    fields.append(f"Content-Length: {len(block)}")
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(header fields, block)`` of each record of an archive, in order."""
    if stream.read(4) != MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(stream.read(int.from_bytes(stream.read(4), "little")))
    plain = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(stream, read_across_frames=True)
    lines = io.BufferedReader(plain, 1 << 20)
    while version := lines.readline():
        if version != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {version!r}")
        fields = {}
        while (line := lines.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        block = lines.read(int(fields["Content-Length"]))
        if lines.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, block


def dictionary_of(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; where they are too few or too alike to train
    on, their own bytes serve as dictionary."""
    whole = b"".join(samples)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, len(whole) // 8)), samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(whole[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _store(path: str):
    return pyarrow.fs.FileSystem.from_uri(path)


def payload_of(html: Column) -> Column:
    return F.coalesce(html.cast("binary"), F.lit(b""))


def with_references(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``digest`` and ``refers_to``: the
    smallest page_id with an equal payload of at least ``MIN_SHARED`` bytes,
    where that is another one. A payload shared by many pages is found by a
    partial aggregation; a page meets its reference by its own id, so no task
    gets all copies."""
    payload = payload_of(F.col("html"))
    known = pages.select("page_id", "url", "html").withColumn("digest", F.sha2(payload, 256))
    thin, _ = settle(known.where(F.length(payload) >= MIN_SHARED).select("page_id", "digest"), "digests")
    groups = thin.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    firsts, _ = settle(groups.where("n > 1").select(F.col("digest").alias("__d"), "refers_to"), "firsts")
    met = thin.join(firsts, F.col("digest") == F.col("__d"))
    later = met.where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    later = later.select(F.col("page_id").alias("__p"), F.col("__d"), "refers_to").distinct()
    same = F.col("page_id").eqNullSafe(F.col("__p")) & (F.col("digest") == F.col("__d"))
    return known.join(later, same, "left").drop("__p", "__d")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archive every page in files under ``folder`` and return a table of
    ``(path, records, bytes)``.

    Each task writes files of about ``ARCHIVE_BYTES`` under names of its own;
    only files of tasks that ended are listed, so a lost executor or a
    second attempt leaves at most files that no list names.
    """
    rows = with_references(pages)
    # A hash picks about twice the sample, and no more of it is collected.
    share = min(1.0, 2 * SAMPLE_RECORDS / max(pages.count(), 1))
    drawn = F.shiftrightunsigned(F.xxhash64("page_id", "url"), 1) < F.lit(int(share * 2**62) * 2 - 1)
    sampled = pages.where(drawn | F.lit(share >= 1)).limit(SAMPLE_RECORDS)
    cut = sampled.select("page_id", "url", F.substring(payload_of(F.col("html")), 1, SAMPLE_BYTES).alias("p"))
    samples = [
        record(r["page_id"], r["url"], bytes(r["p"]), hashlib.sha256(r["p"]).hexdigest(), None) for r in cut.collect()
    ]
    sent = pages.sparkSession.sparkContext.broadcast(dictionary_of(samples).as_bytes() if samples else b"")
    raw = rows.select("page_id", "url", payload_of(F.col("html")).alias("payload"), "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        dictionary = zstandard.ZstdCompressionDict(sent.value)
        out, path, records, size = None, "", 0, 0
        done = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(path, compression=None)
                    out.write(MAGIC + len(sent.value).to_bytes(4, "little") + sent.value)
                    records, size = 0, 0
                    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
                text = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])
                size += out.write(packed := packer.compress(text)) or len(packed)
                records += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        paths, counts, sizes = zip(*done, strict=True) if done else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
            ["path", "records", "bytes"],
        )

    listed, _ = settle(raw.mapInArrow(write, "path string, records long, bytes long"), "archives")
    return listed


def read_archives(listed: DataFrame, folder: str) -> DataFrame:
    """``(page_id, url, record_type, refers_to, payload_bytes,
    payload_digest)`` of every record of the listed archives. Size and digest
    of a response are taken from its payload, and must equal its header."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    rows = []
                    for fields, block in read_records(stream):
                        rows.append(_row(fields, block))
                        if len(rows) == 5_000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    files = listed.count()
    dealt = listed.select("path").repartition(max(1, min(files, 10_000)))
    return dealt.mapInArrow(read, READ)


READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _row(fields: dict[str, str], block: bytes) -> tuple:
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        payload = block[len(HTTP) :]
        if (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
            raise ValueError("a payload differs from its digest")
    whole = {k: int(fields[k]) if k in fields else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")}
    return whole["X-Page-ID"], fields.get("WARC-Target-URI"), fields["WARC-Type"], whole["X-Refers-To-Page-ID"], size, digest


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back.

    A null html is an empty payload; payloads below ``MIN_SHARED`` bytes are
    always responses. Of pages with equal payloads the one with the smallest
    page_id is the response; rows that repeat this page_id are responses too,
    and where all page_ids are null all are. A null url gives a record without
    target. Other columns are not archived; an empty table gives no archive
    and an empty result.
    """
    folder = scratch_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
