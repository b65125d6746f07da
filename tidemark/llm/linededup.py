"""Operator 6, line dedup: two Bloom filters, then an exact look at the suspected repeats alone.

A first scan deals every line key's hash to a range of hashes.  A range has a once-seen filter, which
stays in its task: a hash that it holds already, or that a task has found in two documents, is suspected.
The suspected hashes, and no others, make the twice-seen filter, which tasks are sent: BITS_PER_LINE bits
for each of them up to max_bits.  So it grows with the repeated lines and not with all; beyond the bound
more lines are suspected and the exact step does more, with the same result.  No key of two documents or
more is missed.  A second scan sends on only the keys that the twice-seen filter holds, as (128-bit
digest, doc_id); these are counted exactly and the largest doc_id chosen.  A last scan drops the lines.
Whole texts move once, for that last step.

Defined results: a null or empty text is one empty line; a document is a doc_id, so rows that repeat
one count once and are treated alike; a null doc_id is a document of its own, smaller than any other;
an empty table gives no rows; columns named like the results are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import aside, few, scratch, stored
from .text import forget

BITS_PER_LINE, MAX_BITS, PROBES = 8, 1 << 30, 4
#: Lines of a range of hashes, ranges at most (16 MB of filter each at 10^12 lines), and hashes that a task gathers for each range, and at least, before it deals them.
RANGE_LINES, MOST_RANGES, GATHERED, LEAST_GATHERED = 1 << 18, 1 << 16, 64, 1 << 18


def line_keys(text: str | None, least: int = 20) -> list[bytes]:
    """The keys of a text's lines in order; those under `least` code points are given as b""."""
    out = []
    for line in (text or "").encode().lower().split(b"\n"):
        key = line.strip()
        short = len(key) < least or (len(key) < 4 * least and len(key.decode()) < least)
        out.append(b"" if short else key)
    return out


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions for each hash, by double hashing of its lower bits; bits is a power of two."""
    step = (hashes >> np.uint64(20)) | np.uint64(1)
    return ((hashes[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def ranges_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The range of each hash by its upper bits; n is a power of two."""
    return (hashes >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64) if n > 1 else np.zeros(len(hashes), np.int64)


def power_of_two(least: int) -> int:
    return 1 << max(least - 1, 0).bit_length()


def _dealt(n_ranges: int, least: int):
    """A task's hashes by range: those found once in it, and those of two of its documents or more."""

    def given(hashes: list[bytes]) -> pa.RecordBatch:
        h, n = np.unique(np.frombuffer(b"".join(hashes), dtype=">u8").astype(np.uint64), return_counts=True)
        at = ranges_of(h, n_ranges)
        found, starts = np.unique(at, return_index=True)
        once, twice = [], []
        for a, b in zip(starts, [*starts[1:], len(h)], strict=True):
            once.append(h[a:b].tobytes())
            twice.append(h[a:b][n[a:b] > 1].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["range", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashes: list[bytes] = []
        digest = xxhash.xxh64_digest
        for batch in batches:
            for text in batch.column(0):
                keys = set(line_keys(text.as_py(), least))
                keys.discard(b"")
                hashes.extend(map(digest, keys))
                if len(hashes) > max(LEAST_GATHERED, GATHERED * n_ranges):
                    yield given(hashes)
                    hashes = []
        if hashes:
            yield given(hashes)

    return run


def held(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all bits of each row of positions are set."""
    return ((packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def put(packed: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(packed, at.ravel() >> 3, np.left_shift(1, at.ravel() & 7).astype(np.uint8))


def _suspected(bits: int):
    """Rows sorted by range to a row per range: the hashes that its once-seen filter met again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, again = None, None, []

        def row():
            h = np.unique(np.concatenate(again))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(h)], pa.int64()), pa.array([h.tobytes()], pa.binary())], names=["range", "n", "hashes"])

        for batch in batches:
            for r, once, twice in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if r != now:
                    if again:
                        yield row()
                    now, seen, again = r, np.zeros(bits // 8, np.uint8), []
                h = np.frombuffer(once.as_buffer(), np.uint64)
                at = positions(h, bits)
                met = h[held(seen, at)]
                put(seen, at)
                own = np.frombuffer(twice.as_buffer(), np.uint64)
                if len(met) or len(own):
                    again.append(np.union1d(met, own))
                    if len(again) > 64:
                        again = [np.unique(np.concatenate(again))]
        if again:
            yield row()

    return run


def _packed(bits: int):
    """A range's suspected hashes to its part of the twice-seen filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for hashes in batch.column("hashes"):
                part = np.zeros(bits // 8, np.uint8)
                put(part, positions(np.frombuffer(hashes.as_buffer(), np.uint64), bits))
                out.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("range"), pa.array(out, pa.binary())], names=["range", "bits"])

    return run


@dataclass
class Filter:
    """The twice-seen filter: a row of packed bits for each range of hashes."""

    packed: np.ndarray

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        n, size = self.packed.shape
        at, row = positions(hashes, size * 8), ranges_of(hashes, n)[:, None]
        return ((self.packed[row, at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def twice_filter(docs: DataFrame, least: int = 20, max_bits: int = MAX_BITS, range_lines: int = RANGE_LINES) -> Filter:
    """The twice-seen filter over all lines of docs; at most max_bits / 8 bytes, or one byte for each range."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n_lines = docs.agg(F.sum(F.length(text) - F.length(F.translate(text, "\n", "")) + 1)).first()[0] or 0
    n_ranges = min(MOST_RANGES, power_of_two(-(-n_lines // range_lines)))
    # A range's lines are about n_lines / n_ranges; its filter stays in the task that reads the range.
    own_bits = power_of_two(max(1024, BITS_PER_LINE * n_lines // n_ranges))
    with scratch():
        dealt = docs.select("text").mapInArrow(_dealt(n_ranges, least), "range int, once binary, twice binary")
        ordered = dealt.repartitionById(n_ranges, F.col("range")).sortWithinPartitions("range")
        suspected = stored(ordered.mapInArrow(_suspected(own_bits), "range int, n long, hashes binary"), "line-hashes")
        most = suspected.agg(F.max("n")).first()[0] or 0
        bits = max(8, min(max_bits // n_ranges, power_of_two(BITS_PER_LINE * most)))
        packed = np.zeros((n_ranges, bits // 8), np.uint8)
        for r in suspected.mapInArrow(_packed(bits), "range int, bits binary").toLocalIterator():
            packed[r.range] = np.frombuffer(r.bits, np.uint8)
    return Filter(packed)


def _suspects(shared, least: int):
    """(doc_id, h, digest) of each key that the twice-seen filter holds, once per row; h is the hash of the row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for batch in batches:
            keys: list[bytes] = []
            row: list[int] = []
            for i, text in enumerate(batch.column("text")):
                own = set(line_keys(text.as_py(), least))
                own.discard(b"")
                keys.extend(own)
                row.extend([i] * len(own))
            if not keys:
                continue
            found = np.flatnonzero(twice.holds(np.frombuffer(b"".join(map(xxhash.xxh64_digest, keys)), dtype=">u8").astype(np.uint64)))
            digests = pa.array([xxhash.xxh3_128_digest(keys[i]) for i in found], pa.binary())
            of = pa.array(np.asarray(row, dtype=np.int64)[found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("h").take(of), digests], names=["doc_id", "h", "digest"])

    return run


def _drop(least: int):
    """Texts without the lines whose digests are given, and the counts of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("_gone"), strict=True):
                text = text or ""
                own = text.split("\n")
                kept = own
                if gone.is_valid:
                    out = set(gone.as_py())
                    kept = [x for x, k in zip(own, line_keys(text, least), strict=True) if not k or xxhash.xxh3_128_digest(k) not in out]
                texts.append(text if len(kept) == len(own) else "\n".join(kept))
                lines.append(len(own))
                dropped.append(len(own) - len(kept))
            names = [n for n in batch.schema.names if n != "_gone"]
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, least: int = 20, in_docs: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with repeated lines dropped from text, and n_lines (before), n_dropped.

    A key of at least `least` code points held by `in_docs` or more documents keeps its lines in the
    largest doc_id alone.
    """
    docs, back = aside(docs.drop("n_lines", "n_dropped"), ("_id", "_oh", "_h", "_gone"))
    with scratch() as s:
        gone = s.keep(stored(lost_lines(docs, least, in_docs, max_bits), "line-gone"))
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_oh"))
    joined = docs.withColumn("_h", F.xxhash64("text")).join(gone, own, "left").select(*docs.columns, "_gone")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_dropped long"
    return joined.mapInArrow(_drop(least), schema).withColumnsRenamed(back)


def lost_lines(docs: DataFrame, least: int, in_docs: int, max_bits: int) -> DataFrame:
    """(_id, _oh, _gone): the digests of the keys that a text of a document loses.

    They are gathered by doc_id and text, so that many rows under one doc_id, or under none, are not one group: a set is no larger than its text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, least, max_bits))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(_suspects(shared, least), f"doc_id {kind}, h long, digest binary").distinct()
    suspects = stored(found, "line-suspects")
    held_by = suspects.select("doc_id", "digest").distinct()
    confirmed = held_by.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= in_docs).select("digest", "keeper")
    losers = suspects.join(few(stored(confirmed, "line-confirmed"), 200_000), "digest").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return losers.groupBy("doc_id", "h").agg(F.collect_set("digest").alias("_gone")).withColumnsRenamed({"doc_id": "_id", "h": "_oh"})


def query(spark, sf_dir: str) -> DataFrame:
    """op6: lines of 20 code points or more held by 3 documents or more."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(s) AS line, unnest(range(1, len(s) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
k AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*)::BIGINT AS n_lines,
       (count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN k USING (key)
GROUP BY doc_id
"""
