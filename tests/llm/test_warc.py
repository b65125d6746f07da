import base64
import hashlib
import struct

import zstandard

from tidemark.llm import warc
from tidemark.session import scratch_path

PAGES = [(1, "http://a/1", "<p>same</p>"), (5, "http://a/5", "<p>same</p>"), (3, None, "<p>same</p>"), (2, "http://a/2 x\r\ny", "<p>é</p>"), (7, "u", None), (8, "u", ""), (None, "n", "<p>é</p>"), (None, "n", "alone"), (None, "n", "alone"), (9, "big", "<b>" * 200000), (10, "t", "twice"), (10, "t", "twice"), (11, "crlf", "a\r\n\r\nWARC/1.1\r\n\r\nb")]


def by_hand(rows):
    top = {}
    for p, _, h in rows:
        if p is not None:
            top[h or ""] = max(p, top.get(h or "", p))
    out = []
    for p, _, h in rows:
        raw, t = (h or "").encode(), top.get(h or "")
        revisit = t is not None and p != t
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", t if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS refers", "2 AS key").repartition(3)
    files = warc.write(pages, scratch_path(spark, "warc"), file_bytes=300)
    assert sorted((tuple(r) for r in warc.read(files).collect()), key=str) == by_hand(PAGES)
    spread = [r.path for r in files.collect()]
    assert len(spread) > 3
    small = warc.write(pages, scratch_path(spark, "warc"), least=100)
    assert {r.record_type for r in warc.read(small).collect()} == {"response"}


def test_frames_are_single_records_after_a_dictionary(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    files = warc.write(pages, scratch_path(spark, "warc"))
    with open(files.first().path.removeprefix("file:"), "rb") as f:
        data = f.read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and data[8:12] == struct.pack("<I", 0xEC30A437)
    rest, n = data[8 + size :], 0
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    while rest:
        frame = unpacker.decompressobj()
        assert frame.decompress(rest).startswith(b"WARC/1.1\r\nWARC-Type: ")
        rest, n = frame.unused_data, n + 1
    assert n == pages.count() + 1
    alone = sum(len(zstandard.compress(warc.page_record(r.page_id, r.url, r.html.encode()))) for r in pages.collect())
    assert len(data) < 0.8 * alone


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    files = warc.write(pages, scratch_path(spark, "warc"))
    assert files.count() == 0 and warc.read(files).count() == 0
