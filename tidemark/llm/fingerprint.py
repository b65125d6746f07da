"""Operator 7, document fingerprints: threshold-scaled sketches of 5-word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so a long document keeps
many and a short one few, and containment between very unequal documents stays estimable.  A floor
is added for short texts: the FLOOR smallest hashes are kept in any case, so that texts of up to FLOOR
shingles are compared exactly.  Two sketches are compared below the lower of their thresholds; the
union of two sketches, cut there, is the sketch of the two texts together (`merged`).

As a string: number of distinct shingles, a colon, then the hashes in order, 48 bits each in base64.

Neighbours: documents in order of doc_id and a hash of their text are cut into ranges of about
PARTITION_BYTES of text, each of which is one partition.  The cuts come of a bounded sample of keys
(as those of any range partitioning do; they only balance the work), the last key of each range of all.
A range also gets the row that comes before its first, so texts move once and are never in one order in
one place.  Copies of one row that exceed a range are answered apart: all but one are their own next.

Defined results: null and empty texts have no shingles, the fingerprint "0:", likeness 1 to another
empty one and 0 to any other; fewer words than a shingle has are one shingle; in descending order null
ids come last, and under one id the greater hash of the text (XXH64, seed 42, signed; of a null text 42)
comes first; ids may be of any type that has an order; a single document is its own next; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import few, scratch, stored
from .simhash import shingle_digests
from .text import py_lower_words

SHINGLE, FRACTION, FLOOR = 5, 16, 32
BITS = 48
THRESHOLD = (1 << BITS) // FRACTION
#: Bytes of text in a range, ranges at most (beyond, they grow), keys sampled for each and in all.
PARTITION_BYTES, MOST_RANGES, SAMPLED_EACH, MOST_SAMPLED = 16 << 20, 1 << 20, 64, 1_000_000
#: Copies written by a task at once.
PIECE = 10_000

Sketch = tuple[int, np.ndarray]  # distinct shingles, kept hashes in order


def sketch(text: str | None) -> Sketch:
    digests = shingle_digests(py_lower_words(text), SHINGLE)
    h = np.unique(np.frombuffer(digests, ">u8").astype(np.uint64) >> np.uint64(64 - BITS))
    return len(h), h[: max(FLOOR, int(np.searchsorted(h, THRESHOLD)))]


def to_string(s: Sketch) -> str:
    raw = s[1].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    return f"{s[0]}:{base64.b64encode(raw).decode()}"


def from_string(text: str) -> Sketch:
    n, _, kept = text.partition(":")
    raw = np.frombuffer(base64.b64decode(kept), np.uint8).reshape(-1, 6)
    return int(n), np.pad(raw, ((0, 0), (2, 0))).reshape(-1).view(">u8").astype(np.uint64)


def reach(s: Sketch) -> int:
    """The hash below which the sketch is complete."""
    n, kept = s
    return (1 << BITS) if len(kept) == n else max(THRESHOLD, int(kept[-1]) + 1)


def shared(a: Sketch, b: Sketch) -> tuple[int, int, int]:
    """Kept by both, by a, and by b, below the threshold that both have."""
    upto = min(reach(a), reach(b))
    x, y = a[1][: np.searchsorted(a[1], upto)], b[1][: np.searchsorted(b[1], upto)]
    return len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)


def containment(a: Sketch, b: Sketch) -> float:
    """The estimated part of a's shingles that b holds."""
    if not a[0]:
        return float(not b[0])
    both, own, _ = shared(a, b)
    return both / own if own else 0.0


def likeness(a: Sketch, b: Sketch) -> float:
    """The greater of the two containments: how far the smaller text lies within the other."""
    if not a[0] or not b[0]:
        return float(a[0] == b[0])
    both, own, other = shared(a, b)
    least = min(own, other)
    return both / least if least else 0.0


def merged(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both texts together; the number of distinct shingles is exact if both sketches are complete, else an estimate."""
    upto = min(reach(a), reach(b))
    h = np.union1d(a[1], b[1])
    h = h[: np.searchsorted(h, upto)]
    return (len(h) if upto == 1 << BITS else max(len(h) + 1, round(len(h) * (1 << BITS) / upto))), h


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [to_string(sketch(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def order_key(doc_id, h: int) -> tuple:
    """The place of a document in ascending order; null ids come first."""
    return (doc_id is not None, doc_id, h)


def _ranges_of(batch: pa.RecordBatch, cuts: list[tuple]) -> tuple[list[tuple], list[int]]:
    keys = list(map(order_key, batch.column("doc_id").to_pylist(), batch.column("h").to_pylist()))
    return keys, [bisect_left(cuts, k) for k in keys]


def _last_keys(cuts: list[tuple]):
    """A task's greatest key of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for key, at in zip(*_ranges_of(batch, cuts), strict=True):
                if at not in last or key > last[at]:
                    last[at] = key
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(list(last), pa.int32()), pa.array([k[1] for k in last.values()], kind), pa.array([k[2] for k in last.values()], pa.int64())], names=["bucket", "doc_id", "h"])

    return run


def _in_ranges(cuts: list[tuple], follower: dict[tuple, int]):
    """Rows with their range; the last of a range once more, as the head of the one that follows (after the last: the first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = _ranges_of(batch, cuts)
            heads = [i for i, k in enumerate(keys) if k in follower]
            parts = [(batch, at, False)]
            if heads:
                parts.append((batch.take(pa.array(heads)), [follower[keys[i]] for i in heads], True))
            for rows, bucket, head in parts:
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([head] * len(bucket), pa.bool_()), *(rows.column(n) for n in ("doc_id", "h", "text"))], names=["bucket", "head", "doc_id", "h", "text"])

    return run


def edited_text(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(text: str, own: Sketch, following: str, other: Sketch) -> tuple:
    """The values of NAMES for a document and the one that follows."""
    changed = edited_text(text, following)
    edited = sketch(changed)
    return len(text), hashlib.sha256(changed.encode()).hexdigest(), to_string(own), to_string(edited), likeness(own, edited), likeness(own, other)


def _result(ids: list, kind: pa.DataType, out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", *NAMES])


def _beside_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in ascending order, the head of each range first: what comes next in descending order is the row before."""
    bucket, before, ids, out, kind = None, None, [], [], None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for b, head, doc, text in zip(*(batch.column(n).to_pylist() for n in ("bucket", "head", "doc_id", "text")), strict=True):
            text = text or ""
            if b != bucket:
                bucket, before = b, None
            own = before[1] if before is not None and before[0] == text else sketch(text)
            if not head:
                if before is None:
                    raise ValueError(f"range {b} has no head")
                ids.append(doc)
                out.append(compared(text, own, *before))
            before = (text, own)
            if len(out) >= 500:
                yield _result(ids, kind, out)
                ids, out = [], []
    if out:
        yield _result(ids, kind, out)


def _beside_itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        if texts:
            found = _result(batch.column("doc_id").to_pylist(), batch.schema.field("doc_id").type, [compared(t, s := sketch(t), t, s) for t in texts])
            yield pa.RecordBatch.from_arrays([*found.columns, batch.column("n")], names=[*found.schema.names, "n"])


def _cuts(keys: DataFrame, ranges: int, n: int) -> list[tuple]:
    """Keys that cut all into about so many ranges of equal size: of a seeded sample of MOST_SAMPLED at most."""
    if ranges <= 1:
        return []
    rate = min(1.0, min(SAMPLED_EACH * ranges, MOST_SAMPLED) / n)
    drawn = keys.where(F.pmod(F.xxhash64(F.lit(7), "doc_id", "h"), F.lit(1 << 40)) < int(rate * (1 << 40)))
    sample = sorted((order_key(r.doc_id, r.h), r.size) for r in drawn.groupBy("doc_id", "h").agg(F.sum("size").alias("size")).collect())
    each, sofar, cuts = sum(size for _, size in sample) / ranges, 0, []
    for key, size in sample:
        sofar += size
        if sofar >= each * (len(cuts) + 1) and len(cuts) < ranges - 1:
            cuts.append(key)
    return cuts


def beside_next(docs: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Each document beside the next in descending order, and beside its own text with the second half taken from that."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    with scratch() as s:
        keys = stored(docs.select("doc_id", "h", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")), "fingerprint-keys")
        n, n_bytes = keys.agg(F.count("*"), F.sum("size")).first()
        if not n:
            return spark.createDataFrame([], f"doc_id {kind}, {RESULT}")
        each = max(partition_bytes, math.ceil(n_bytes / MOST_RANGES))
        copies = keys.groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.sum("size").alias("size")).where((F.col("n") > 1) & (F.col("size") > each))
        copies = stored(copies.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "n"), "fingerprint-copied")
        rows, apart = docs, None
        if copies.limit(1).count():
            of_copies = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
            once = s.keep(stored(docs.join(few(copies), of_copies).groupBy("doc_id", "h").agg(F.min("text").alias("text"), F.min("n").alias("n")), "fingerprint-once"))
            rows = docs.join(few(s.keep(copies)), of_copies, "left_anti").unionByName(once.drop("n"))
            apart = s.keep(stored(once.select("doc_id", "text", "n").mapInArrow(_beside_itself, f"doc_id {kind}, {RESULT}, n long"), "fingerprint-alike"))
            keys = keys.join(few(copies), of_copies, "left_anti").unionByName(once.select("doc_id", "h", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")))
            n, n_bytes = keys.agg(F.count("*"), F.sum("size")).first()
        ranges = min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / each)))
        cuts = _cuts(keys, ranges, n)
        greatest = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("k")
        found = keys.mapInArrow(_last_keys(cuts), f"bucket int, doc_id {kind}, h long").groupBy("bucket").agg(greatest).collect()  # a row per range
    last = sorted((r.bucket, order_key(r.k.doc_id, r.k.h)) for r in found)
    # The last of each range that has rows is the head of the next of these.
    follower = {key: last[(i + 1) % len(last)][0] for i, (_, key) in enumerate(last)}
    placed = rows.mapInArrow(_in_ranges(cuts, follower), f"bucket int, head boolean, doc_id {kind}, h long, text string")
    ordered = placed.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", F.col("head").desc(), F.col("doc_id").asc_nulls_first(), "h")
    out = ordered.mapInArrow(_beside_next, f"doc_id {kind}, {RESULT}")
    if apart is None:
        return out
    # All copies but one: dealt out in pieces before they are written singly.
    pieces = apart.withColumn("piece", F.explode(F.expr(f"sequence(0L, (n - 2) div {PIECE})"))).repartition("doc_id", "piece")
    return out.unionByName(pieces.withColumn("one", F.explode(F.expr(f"sequence(1L, least({PIECE}, n - 1 - piece * {PIECE}))"))).select(*out.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: all documents, each beside its edited text and the next document."""
    return beside_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
