"""Operator 1, WARC archives with a Zstandard dictionary.

A dictionary is trained from archived records and stands in a leading skippable frame of every file;
each record is then a frame of its own, so that any can be read with nothing but the dictionary.
Payloads found before are written as revisits.  Texts are not shuffled: which payloads repeat is found
on digests, and that small table joins the scan.

Files go to the shared folder under names that depend on the task's number alone; a task that is run
again writes beside and renames, so that a retry replaces the same file.

Defined results: null html is an empty payload; a null url leaves out the target URI; among equal
payloads of at least `least` bytes that of the largest page_id is the response and the others revisit
it, rows that repeat that id are responses too; if all their ids are null, all are responses; an
empty table gives no files and no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import few, scratch_path, stored

#: The dictionary frame's magic number in zstd-compressed WARC files.
DICTIONARY_MAGIC = 0x184D2A5D
#: Records that the dictionary is trained on, their greatest size each, and its own.
SAMPLED, SAMPLE_BYTES, DICTIONARY_BYTES = 300, 1 << 16, 1 << 16
FILE_BYTES = 64 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(uri: str):
    number = uri.removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response with its payload, or a revisit with the response's HTTP headers alone."""
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(headers, http if revisit else http + payload)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return headers, rest[:size]


def train_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; from too few records to train on, their own last bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ArchiveWriter:
    """Records to a .warc.zst file: the dictionary in a skippable frame, then a frame for each record."""

    def __init__(self, folder: str, name: str, dictionary: bytes, level: int = 3):
        import zstandard

        self.fs, root = _filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.at, self.final = f"{root}/.{name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}", f"{root}/{name}"
        self.path, self.size, self.records = f"{folder}/{name}", 0, 0
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.file = self.fs.open_output_stream(self.at, compression=None)
        if dictionary:
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
        self.add(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{name}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.packer.compress(record))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.file.close()
        self.fs.move(self.at, self.final)
        return self.path, self.records, self.size


def read_archive(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a file in order, one held at a time."""
    import zstandard

    fs, name = _filesystem(path)
    with fs.open_input_stream(name, compression=None) as file:
        data, dictionary = file.read(8), None
        if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
            dictionary, data = zstandard.ZstdCompressionDict(file.read(struct.unpack("<I", data[4:])[0])), b""
        unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
        while data or (data := file.read(1 << 20)):
            frame, out = unpacker.decompressobj(), []
            while not frame.eof:
                if not data and not (data := file.read(1 << 20)):
                    raise ValueError(f"{path} ends within a record")
                out.append(frame.decompress(data))
                data = frame.unused_data
            yield parse_record(b"".join(out))


def _written(folder: str, shared, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, out, files = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers")), strict=True):
                if out is None:
                    out = ArchiveWriter(folder, f"part-{task:05d}-{nth:03d}.warc.zst", shared.value)
                page, refers = page.as_py(), refers.as_py()
                out.add(page_record(page, url.as_py(), (html.as_py() or "").encode(), refers, revisit=refers is not None and page != refers))
                if out.size >= file_bytes:
                    files.append(out.close())
                    out, nth = None, nth + 1
        if out is not None:
            files.append(out.close())
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*files, strict=True)], names=["path", "records", "bytes"])

    return run


def write(pages: DataFrame, folder: str, least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archive all pages; the files written: path, records, bytes."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", F.sha2(html, 256).alias("key"), F.octet_length(html).alias("size"))
    again = keyed.where(F.col("size") >= least).groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("refers")).where((F.col("n") > 1) & F.col("refers").isNotNull())
    again = stored(again.select(F.col("key").alias("_key"), "refers"), "warc-again")
    # A bounded sample in a fixed order, chosen on ids and sizes: first by a threshold of their hash, so that tasks do not
    # each send as many as are wanted of all; only those rows are then fetched.
    fit = keyed.where(F.col("size").between(1, SAMPLE_BYTES)).withColumn("place", F.pmod(F.xxhash64("page_id", "key"), F.lit(1 << 40)))
    rate = min(1.0, 2 * SAMPLED / max(fit.count(), 1))
    drawn = fit.where(F.col("place") < int(rate * (1 << 40))).select("page_id", "place").distinct()
    sample = drawn.orderBy("place", "page_id").limit(SAMPLED).select("page_id").collect()
    rows = pages.where(F.col("page_id").isin([r.page_id for r in sample])).where(F.octet_length("html") <= SAMPLE_BYTES).select("page_id", "url", "html").limit(2 * SAMPLED).collect() if sample else []
    rows.sort(key=lambda r: (r.page_id is None, r.page_id, r.html or ""))
    dictionary = train_dictionary([page_record(r.page_id, r.url, (r.html or "").encode()) for r in rows]) if rows else b""
    shared = spark.sparkContext.broadcast(dictionary)
    found = pages.select("page_id", "url", "html").join(few(again, 100_000), F.sha2(html, 256) == F.col("_key"), "left").select("page_id", "url", "html", "refers")
    return stored(found.mapInArrow(_written(folder, shared, file_bytes), "path string, records long, bytes long"), "warc-files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = []
    for batch in batches:
        for path in batch.column("path").to_pylist():
            for headers, block in read_archive(path):
                if headers["WARC-Type"] == "warcinfo":
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                told = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if headers["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != told):
                    raise ValueError(f"{path}: {headers['WARC-Record-ID']} differs from its digest")
                refers = headers.get("WARC-Refers-To")
                rows.append((page_of(headers["WARC-Record-ID"]), size, told, headers["WARC-Type"], page_of(refers) if refers else None))
                if len(rows) >= 5000:
                    yield made(rows)
                    rows = []
    if rows:
        yield made(rows)


def read(files: DataFrame) -> DataFrame:
    """Every page record of the files: page_id, payload_bytes, payload_digest (checked against the payload), record_type, refers_to."""
    at = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path")) - 1).alias("at")  # a row per file
    return files.select("path", at).repartitionById(max(1, files.count()), F.col("at")).select("path").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all pages archived, then read back."""
    return read(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_path(spark, "warc")))


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT html, max(page_id) AS top FROM p GROUP BY html)
SELECT page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(8), lambda i:
         list_aggregate(list_transform([15, 10, 5, 0], lambda s:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (1 + 5 * i)::INT, 5))::INT >> s) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p JOIN g ON p.html = g.html
"""
