"""Archives: round trips, the file format and every odd page."""

import hashlib
import io

import pytest
import zstandard
from compare import canonical, duck
from helpers import SF_DIR, sent  # noqa: F401

from casefeat.llm import warc as W
from casefeat.session import scratch_folder
from casefeat.llm.oracles import ORACLES
from casefeat.llm.queries import queries

SCHEMA = "page_id long, url string, html string"


def archive_bytes(listed):
    return [open(r["path"].removeprefix("file://"), "rb").read() for r in listed.collect()]


def pages_of(n=300):
    page = "<html><body>" + "paragraph of page %d " * 12 + "</body></html>"
    rows = [(k, f"http://h{k % 7}.example.com/{k}", page % tuple([k % 40] * 12)) for k in range(n)]
    rows += [(1000, None, None), (1001, "", ""), (1002, "http://x\r\nWARC-Type: evil: 1/ é", "short"), (1003, "http://y", "short")]
    rows += [(1004, "u", "é" * 50), (1005, "u", "é" * 50), (1006, "u", "é" * 49 + "e"), (1007, "u", "z" * 3_000_000)]
    rows += [(2, "http://again", rows[2][2]), (None, "n", rows[5][2]), (None, "n", "only without id " * 20), (None, "m", "only without id " * 20)]
    return rows


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        lead = first.get(html)
        later = len(raw) >= 100 and lead is not None and i != lead
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if later else "response", lead if later else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = pages_of()
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS digest", "2 AS refers_to", "3 AS n").repartition(3)
    got = W.archived(frame).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(rows)
    assert {r["url"] for r in got if r["page_id"] == 1002} == {"http://x%0D%0AWARC-Type:%20evil:%201/%20%C3%A9"}


def test_format_and_payloads(spark):
    rows = pages_of(120)
    listed = W.write_archives(spark.createDataFrame(rows, SCHEMA), scratch_folder(spark, "warc"))
    payloads = {}
    frames = 0
    for raw in archive_bytes(listed):
        assert raw[:4] == b"\x5d\x2a\x4d\x18"
        size = int.from_bytes(raw[4:8], "little")
        dictionary = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
        rest = raw[8 + size :]
        while rest:  # every record is a frame of its own
            one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            text = one.decompress(rest)
            rest = one.unused_data
            frames += 1
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        for fields, block in W.read_records(io.BytesIO(raw)):
            if fields["WARC-Type"] == "response" and "X-Page-ID" in fields:
                payloads[int(fields["X-Page-ID"])] = block[len(W.HTTP) :]
    assert frames == len(rows) == sum(r["records"] for r in listed.collect())
    kept = {i: (h or "").encode() for i, _, h in rows if i is not None}
    assert all(kept[i] == p for i, p in payloads.items())


def test_a_dictionary_helps():
    samples = [W.record(k, f"http://a/{k}", b"<html><p>common words of pages %d</p></html>" % k, "0" * 64, None) for k in range(400)]
    dictionary = W.dictionary_of(samples)
    with_it = zstandard.ZstdCompressor(dict_data=dictionary)
    assert sum(len(with_it.compress(s)) for s in samples) * 2 < sum(len(zstandard.ZstdCompressor().compress(s)) for s in samples)


@pytest.mark.parametrize("samples", [[b"x"], [b"same" * 50] * 3, [b""]])
def test_too_few_samples(samples):
    dictionary = W.dictionary_of(samples)
    packed = zstandard.ZstdCompressor(dict_data=dictionary).compress(b"payload")
    again = zstandard.ZstdCompressionDict(dictionary.as_bytes())
    assert zstandard.ZstdDecompressor(dict_data=again).decompress(packed) == b"payload"


def test_broken_archives_are_reported():
    with pytest.raises(ValueError):
        list(W.read_records(io.BytesIO(b"not an archive")))
    fields = {"WARC-Payload-Digest": "sha256:" + "0" * 64, "X-Payload-Length": "1", "WARC-Type": "response"}
    with pytest.raises(ValueError):
        W._row(fields, W.HTTP + b"x")


def test_no_pages(spark):
    assert W.archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_against_sql(spark):
    name = "op5_warc_archive"
    ours = canonical(queries()[name](spark, SF_DIR).toPandas().astype("object"))
    theirs = canonical(duck(SF_DIR).execute(ORACLES[name]).df().astype("object"))
    assert len(ours) == len(theirs)
    for column in ours.columns:
        plain = [[None if v in ("None", "nan", "<NA>") else str(v).removesuffix(".0") for v in f[column]] for f in (ours, theirs)]
        assert sorted(map(str, plain[0])) == sorted(map(str, plain[1])), column
