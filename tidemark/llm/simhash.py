"""Operator 4, SimHash near-dedup by deletion-variant signatures.

Within 2 of 64 bits, one of two 32-bit segments differs by one bit at most.  So every fingerprint is
indexed under 64 keys, each a segment with one bit deleted; two that link share a key, and an
equality join on keys followed by a count of the differing bits finds every link.

Equal fingerprints are one node, so copies never meet in pairs.  A key held by two nodes gives its one
pair directly; one held by up to CROWD gives its few; nodes under a more crowded key are instead
indexed with two deleted bits over the whole word.  There at most four distinct values can share a
key, and all of those are within 2 bits, so the work stays linear in the nodes however many are near copies.

Components come from alternating star contraction on the links, every round written to the shared folder.

`keep_similar` is for texts that share most of their shingles (0.8 of those of two) and whose fingerprints may so differ in ten bits, more
than any segments that are long enough tell apart.  It is exact and uses no fingerprints: with all shingles in one order, two such texts have one of their
first n - ceil(0.8 n) + 1 in common.  These are the keys; under each, all are compared with the least and the greatest
node, and then whatever is still not connected with one another, so that many near copies do not meet in pairs.  Shingles that
many texts begin with come last in the order, and every pair is verified by the shingles of both texts.

Defined results: null or empty texts have fingerprint 0 and link like others; repeated rows are
copies; a component of null ids alone has a null id; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import aside, discard, few, scratch, stored
from .linededup import BITS_PER_LINE, MAX_BITS, MOST_RANGES, RANGE_LINES, positions, power_of_two, put, ranges_of
from .text import forget, py_lower_words

#: Comparing a node with up to so many under each of its 64 keys costs less than 2,016 rows for it.
CROWD = 256
#: Key rows are 16 bytes, so that this many may be broadcast.
FEW_KEYS = 300_000
#: Key rows that a task makes of its nodes.
KEYS_PER_TASK = 1 << 21


def shingle_digests(words: list[bytes], k: int, seed: int = 42) -> bytes:
    """XXH64 of each k-word shingle, 8 bytes big-endian each; fewer words are one shingle, none give nothing."""
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_digest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)])


def simhash(text: str | None, k: int = 3) -> int:
    """The signed 64-bit fingerprint: a bit is 1 if set in over half of the shingles' hashes."""
    return _majority(shingle_digests(py_lower_words(text), k))


def _majority(raw: bytes) -> int:
    digests = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(digests), 1 << 15):
        ones += np.unpackbits(digests[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big", signed=True)


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([simhash(t.as_py(), k) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), found], names=["doc_id", "h", "fp"])

    return run


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, h (a hash of the text, by which rows of one doc_id are told apart) and fp (signed) of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(_fingerprints(k), f"doc_id {kind}, h long, fp long")


def spread(nodes: DataFrame, keys_each: int) -> DataFrame:
    """Nodes dealt to as many tasks as their keys need: these are many times the nodes, which lie in few files."""
    least = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.repartition(max(least, math.ceil(nodes.count() * keys_each / KEYS_PER_TASK)), "fp")


def one_wildcard_keys(nodes: DataFrame) -> DataFrame:
    """(fp, key): both 32-bit segments with each of their bits deleted in turn."""
    bits = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b"))
    return bits.select("fp", F.expr("shiftleft(cast(b as bigint), 32) | (shiftrightunsigned(fp, if(b < 32, 0, 32)) & 4294967295L & ~shiftleft(1L, b % 32))").alias("key"))


def two_wildcard_keys(nodes: DataFrame) -> DataFrame:
    """(fp, mask, key): the whole word with each two of its bits deleted."""
    i = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i"))
    ij = i.select("fp", "i", F.explode(F.expr("sequence(i + 1, 63)")).alias("j"))
    return ij.select("fp", F.expr("i * 64 + j").alias("mask"), F.expr("fp & ~(shiftleft(1L, i) | shiftleft(1L, j))").alias("key"))


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(u, v), u < v: every two of the distinct fp in nodes that differ in 2 bits or fewer (near ones perhaps by way of a third, within a key of four)."""
    # Two that link share up to 33 keys; only the first of these gives the pair.
    first = "(case bit_count(({x} ^ {y}) & 4294967295L) when 0 then 0 when 1 then if(shiftright(key, 32) < 32 and (({x} ^ {y}) & 4294967295L) = shiftleft(1L, cast(shiftright(key, 32) as int)), shiftright(key, 32), -1) else 32 end) = shiftright(key, 32)"
    near = "bit_count({x} ^ {y}) <= 2 and " + first
    keys = one_wildcard_keys(spread(nodes.select("fp"), 64))
    shared = stored(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n >= 2"), "simhash-keys")
    direct = shared.where("n = 2").where(near.format(x="u", y="v")).select("u", "v")
    members = stored(keys.join(few(shared.where("n > 2").select("key", "n"), FEW_KEYS), "key"), "simhash-members")
    small = members.where(F.col("n") <= crowd).groupBy("key").agg(F.collect_list("fp").alias("l"))
    pairs = F.expr(f"flatten(transform(l, x -> transform(filter(l, y -> y > x and {near.format(x='x', y='y')}), y -> struct(x as u, y as v))))")
    few_each = small.select(F.explode(pairs).alias("p")).select("p.u", "p.v")
    crowded = members.where(F.col("n") > crowd).select("fp").distinct()
    crowded = stored(crowded, "simhash-crowded")
    cliques = two_wildcard_keys(spread(crowded, 2016)).groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("w"), F.bit_xor("fp").alias("x")).where("n >= 2")
    cliques = stored(cliques, "simhash-cliques")
    # Up to four share a key.  The least and the greatest are the ends of n = 2; for 3 and 4 the star needs them all.
    pair = cliques.where("n = 2").select("u", F.col("w").alias("v"))
    third = cliques.where("n = 3").select("u", F.explode(F.array("w", F.expr("x ^ u ^ w"))).alias("v"))
    # The four values are the key with every setting of its two bits.
    four = cliques.where("n = 4").select("u", F.explode(F.expr("array(key, key | shiftleft(1L, cast(mask div 64 as int)), key | shiftleft(1L, mask % 64), key | shiftleft(1L, cast(mask div 64 as int)) | shiftleft(1L, mask % 64))")).alias("v")).where("u <> v")
    return stored(direct.unionByName(few_each).unionByName(pair).unionByName(third).unionByName(four).distinct(), "simhash-links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v): root is the least node reachable.

    Alternating large-star and small-star contraction: rounds grow with the logarithm of the size.
    """

    def star(pairs: DataFrame) -> DataFrame:
        """pairs (a, b): every b greater than the least of a's neighbourhood is hung on that."""
        least = stored(pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "cc-least")
        out = stored(pairs.join(few(least.withColumnRenamed("a", "_a"), FEW_KEYS), F.col("a") == F.col("_a")).select("a", "b", "m"), "cc-pairs")
        discard(least)
        return out

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, before = edges, None
    while (at := state(now)) != before and at[0]:
        before = at
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(now.select(F.col("v").alias("a"), F.col("u").alias("b")))
        large = star(both).where("b > a").select(F.col("m").alias("u"), F.col("b").alias("v")).where("u <> v").distinct()
        large = stored(large, "cc-large")
        down = star(large.select(F.col("v").alias("a"), F.col("u").alias("b")))
        small = down.select(F.col("m").alias("u"), F.explode(F.array("a", "b")).alias("v")).where("u <> v").distinct()
        if now is not edges:
            discard(now)
        now = stored(small, "cc-small")
        discard(large)
        discard(down)
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _labelled(fps: DataFrame, linked=links) -> DataFrame:
    """(fp, lo, root) of every distinct fp: its least doc_id and the least fp that links reach."""
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("lo")), "simhash-nodes")
    roots = components(linked(nodes))
    return stored(nodes.join(few(roots.withColumnRenamed("node", "fp"), FEW_KEYS), "fp", "left").select("fp", "lo", F.coalesce("root", "fp").alias("root")), "simhash-roots")


def near_duplicates(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id of those that links reach."""
    with scratch() as s:
        fps = s.keep(stored(fingerprints(docs, k), "simhash-fp"))
        labelled = _labelled(fps)
        least = labelled.groupBy("root").agg(F.min("lo").alias("component_id"))
        chosen = s.keep(stored(labelled.join(least, "root").select("fp", "component_id"), "simhash-chosen"))
    return fps.join(chosen, "fp").select("doc_id", "fp", "component_id")


def unkept(fps: DataFrame, linked=links) -> DataFrame:
    """fps: doc_id, h, fp.  (doc_id, h, lost, n) of the rows that do not simply stay: those that go, and those that stay once though found n times.

    A component keeps its first row by doc_id (null after all others), fp and h.
    """
    labelled = _labelled(fps, linked)
    by_root = labelled.groupBy("root").agg(F.min(F.struct(F.col("lo").isNull().alias("nil"), "lo", "fp")).alias("v"))
    first = by_root.select("root", F.col("v.lo").alias("keep_id"), F.col("v.fp").alias("keep_fp"))
    keepers = stored(labelled.join(first, "root").select("fp", "keep_id", "keep_fp"), "simhash-keepers")
    # Rows that share the keeper's doc_id and fp but not its text: the least h of them stays.
    at = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("fp") == F.col("keep_fp"))
    rows = fps.join(keepers, "fp").groupBy("doc_id", "fp", "h", at.alias("at")).agg(F.count("*").alias("n"))
    rows = stored(rows, "simhash-rows")
    least = rows.where("at").groupBy("doc_id", "fp").agg(F.min("h").alias("least"), F.count("*").alias("texts"))
    tied = stored(least.where("texts > 1"), "simhash-tied")
    lost = ~F.col("at")
    if tied.limit(1).count():
        tied = few(tied.select(F.col("doc_id").alias("_id"), F.col("fp").alias("_f"), "least"), FEW_KEYS)
        rows = rows.join(tied, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_f")), "left")
        lost = lost | (F.col("h") != F.coalesce("least", "h"))
    return rows.select("doc_id", "h", lost.alias("lost"), "n").where("lost or n > 1")


def keep_one(docs: DataFrame, k: int = 3) -> DataFrame:
    """docs with one row of each component: the first by doc_id (null after all others), fp and a hash of the text; of rows alike in all, one.

    Rows that go are looked up by doc_id and text: they are few beside those that stay, which are not moved unless
    more than FEW_KEYS go.
    """
    moved, back = aside(docs, ("_id", "_h", "_oh"))
    with scratch() as s:
        fps = stored(fingerprints(docs, k), "simhash-fp")
        odd = s.keep(stored(unkept(fps), "simhash-unkept"))
    return _without(moved, odd).withColumnsRenamed(back)


def _without(moved: DataFrame, odd: DataFrame) -> DataFrame:
    """The rows without those that unkept() names as lost, and with one row of each that stays once."""
    named = lambda d: few(d.select(F.col("doc_id").alias("_id"), F.col("h").alias("_oh")), FEW_KEYS)
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_oh"))
    hashed = moved.withColumn("_h", F.xxhash64("text"))
    out = hashed.join(named(odd), own, "left_anti")
    again = odd.where("not lost")
    if again.limit(1).count():
        out = out.unionByName(hashed.join(named(again), own, "left_semi").dropDuplicates(["doc_id", "_h"]))
    return out.drop("_h")


#: A shingle that more nodes hold among their first is common: it comes last in the order of shingles.
COMMON = 64
#: Common shingles that are put in order at most (16 bytes each, in every task), and rows of copies that tasks are sent at most.
MOST_COMMON, MOST_COPIES = 1 << 20, 2_000_000


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    return np.unique(np.frombuffer(shingle_digests(py_lower_words(text), k), ">u8").astype(np.uint64))


def first_of(n: int, similarity: float) -> int:
    """Of how many first shingles, in any one order, two texts of that similarity have one in common, if n are the text's."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        words = [py_lower_words(t.as_py()) for t in batch.column("text")]
        nodes = np.array([xxhash.xxh64_intdigest(b" ".join(w), 7) for w in words], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(nodes), pa.array(map(len, words), pa.int64())], names=["doc_id", "h", "fp", "words"])


@dataclass
class Order:
    """The one order of all shingles: those not named by their hash, then the common ones by how many nodes hold them."""

    common: np.ndarray
    counts: np.ndarray
    similarity: float

    def first(self, text: str | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A text's shingles, and those of them that come first; both are empty without words."""
        h = shingle_hashes(text, k)
        ranked = h
        if len(h) and len(self.common):
            at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
            ranked = h[np.argsort(np.where(self.common[at] == h, self.counts[at], 0), kind="stable")]
        return h, ranked[: first_of(len(h), self.similarity)] if len(h) else h


def _hints(order: Order, k: int):
    """(key) of an eighth of the first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = [order.first(t.as_py(), k)[1] for t in batch.column("text")]
            keys = np.concatenate([f[f % np.uint64(8) == 0] for f in firsts] + [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    return run


def _beside(order: Order, some: np.ndarray, k: int):
    """(key) of all shingles of the texts that have one of some among their first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("text"):
                h, firsts = order.first(t.as_py(), k)
                if np.isin(firsts, some).any():
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["key"])

    return run


def _dealt(shared, k: int, n_ranges: int):
    """A task's first shingles by range: 4 bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, held, n = shared.value, [], 0

        def given():
            h = np.sort(np.concatenate(held))
            found, starts = np.unique(ranges_of(h, n_ranges), return_index=True)
            parts = [x.tobytes() for x in np.split(_low(h, n_ranges), starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(parts, pa.binary())], names=["range", "keys"])

        for batch in batches:
            pa.default_memory_pool().release_unused()
            for t in batch.column("text"):
                held.append(order.first(t.as_py(), k)[1])
                n += len(held[-1])
                if n > max(1 << 18, 64 * n_ranges):
                    yield given()
                    held, n = [], 0
        if n:
            yield given()

    return run


def _low(h: np.ndarray, n_ranges: int) -> np.ndarray:
    """The 32 bits of each hash below those of its range."""
    return (h >> np.uint64(32 - n_ranges.bit_length() + 1)).astype(np.uint32)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range to a row per range: the keys found twice or more."""
    now, held = None, []

    def row():
        keys, n = np.unique(np.frombuffer(b"".join(held), np.uint32), return_counts=True)
        keys = keys[n > 1]
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([keys.tobytes()], pa.binary())], names=["range", "n", "keys"])

    for batch in batches:
        for r, keys in zip(batch.column("range").to_pylist(), batch.column("keys").to_pylist(), strict=True):
            if r != now:
                if held:
                    yield row()
                now, held = r, []
            held.append(keys)
    if held:
        yield row()


def _places(low: np.ndarray, bits: int) -> np.ndarray:
    return positions(low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), bits)


def _bits(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for keys in batch.column("keys"):
                part = np.zeros(size // 8, np.uint8)
                put(part, _places(np.frombuffer(keys.as_buffer(), np.uint32), size))
                out.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("range"), pa.array(out, pa.binary())], names=["range", "bits"])

    return run


def _met(shared, k: int):
    """(fp, n, key) of the first shingles that the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, packed = shared.value
        n_ranges, size = packed.shape
        for batch in batches:
            pa.default_memory_pool().release_unused()
            sizes, found = [], []
            for t in batch.column("text"):
                h, firsts = order.first(t.as_py(), k)
                at, row = _places(_low(firsts, n_ranges), size * 8), ranges_of(firsts, n_ranges)[:, None]
                held = ((packed[row, at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=1)
                sizes.append(len(h))
                found.append(firsts[held])
            each = [len(f) for f in found]
            nodes = np.array([xxhash.xxh64_intdigest(b" ".join(py_lower_words(t.as_py())), 7) for t in batch.column("text")], np.uint64).view(np.int64)
            columns = [np.repeat(nodes, each), np.repeat(np.array(sizes, np.int64), each), np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["fp", "n", "key"])

    return run


def _shingled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array([shingle_hashes(t.as_py(), k).tobytes() for t in batch.column("text")], pa.binary())], names=["fp", "shingles"])

    return run


def _similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    pa.default_memory_pool().release_unused()
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / (len(x) + len(y) - both) if both else 0.0)
    return pa.array(out, pa.float64())


def _sets(docs: DataFrame, nodes: DataFrame, fps: DataFrame, k: int) -> DataFrame:
    """(fp, shingles) of the nodes fps, one row or more each."""
    wanted = stored(nodes.select("fp", "h").join(few(fps, FEW_KEYS), "fp", "left_semi"), "similar-wanted")
    return docs.select("h", "text").join(few(wanted, FEW_KEYS), "h").mapInArrow(_shingled(k), "fp long, shingles binary")


def first_keys(texts: DataFrame, n_first: int, k: int, similarity: float, common: int = COMMON) -> DataFrame:
    """(fp, n, key): the first shingles of every text that others begin with too, and a few more.

    The order is chosen first, after shingles that are common; whatever it is, no pair is lost.  Then tasks are sent a filter of the
    keys that are held twice, of 8 bits for each up to MAX_BITS.
    """
    spark = texts.sparkSession
    often = lambda rows: rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > common).orderBy(F.desc("c"), "key").limit(MOST_COMMON).collect()
    order = Order(np.zeros(0, np.uint64), np.zeros(0, np.int64), similarity)
    some = np.array([r.key for r in often(texts.mapInArrow(_hints(order, k), "key long"))], np.int64).view(np.uint64)
    if len(some):
        # Texts with common shingles hold others that are as common, which would be first in their place.
        rows = often(texts.mapInArrow(_beside(order, some, k), "key long"))
        keys, counts = np.array([r.key for r in rows], np.int64).view(np.uint64), np.array([r.c for r in rows], np.int64)
        by = np.argsort(keys)
        order = Order(keys[by], counts[by], similarity)
    n_ranges = min(MOST_RANGES, power_of_two(-(-n_first // RANGE_LINES)))
    sent = spark.sparkContext.broadcast(order)
    dealt = texts.mapInArrow(_dealt(sent, k, n_ranges), "range int, keys binary")
    twice = stored(dealt.repartitionById(n_ranges, F.col("range")).sortWithinPartitions("range").mapInArrow(_repeated, "range int, n long, keys binary"), "similar-repeated")
    most = twice.agg(F.max("n")).first()[0] or 0
    bits = max(8, min(MAX_BITS // n_ranges, power_of_two(BITS_PER_LINE * most)))
    packed = np.zeros((n_ranges, bits // 8), np.uint8)
    for r in twice.mapInArrow(_bits(bits), "range int, bits binary").toLocalIterator():
        packed[r.range] = np.frombuffer(r.bits, np.uint8)
    discard(twice)
    sent = spark.sparkContext.broadcast((order, packed))
    return stored(texts.mapInArrow(_met(sent, k), "fp long, n long, key long"), "similar-keys")


def _rest(n: str, similarity: float) -> str:
    """The shingles that are not among the first_of() n, in SQL."""
    return f"(ceil({similarity!r}D * {n} - 1e-9D) - 1)"


def _verified(docs: DataFrame, nodes: DataFrame, met: DataFrame, k: int, similarity: float) -> DataFrame:
    """(u, v) of met (u, nu, v, nv; a row for each key that both have) whose texts are similar.

    Of the two, the one whose first shingles end earlier in the order has all that it shares of them among these keys; the others are
    its rest.  So what shares too few keys for its sizes is no pair, and is not compared.
    """
    counted = met.groupBy("u", "nu", "v", "nv").agg(F.count("*").alias("c"))
    could = F.expr(f"c + greatest({_rest('nu', similarity)}, {_rest('nv', similarity)}) >= {similarity / (1 + similarity)!r}D * (nu + nv) - 1e-6D")
    pairs = stored(counted.where(could).select("u", "v"), "similar-pairs")
    sets = stored(_sets(docs, nodes, pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct(), k).dropDuplicates(["fp"]), "similar-sets")
    side = lambda a, c: sets.select(F.col("fp").alias(a), F.col("shingles").alias(c))
    found = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v")
    found = stored(found.where(F.arrow_udf(_similarity, "double")("a", "b") >= similarity).select("u", "v"), "similar-links")
    discard(sets)
    return found


def similar_links(docs: DataFrame, described: DataFrame, k: int, similarity: float, common: int = COMMON) -> DataFrame:
    """(u, v), u < v: links between nodes whose texts have `similarity` of their k-word shingles in common; they connect all that such pairs connect.

    docs have h, the hash of the text.
    """
    nodes = stored(described.where("words > 0").groupBy("fp").agg(F.min("h").alias("h"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("at"), F.max("words").alias("words")), "similar-nodes")
    # One row of each node is looked at.  Copies that are too many to be sent only add keys that no second node holds.
    copies = described.join(nodes.select("fp", "at"), "fp").where("not (doc_id <=> at.doc_id and h = at.h)").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    copies = stored(copies, "similar-copies")
    single = copies.limit(MOST_COPIES + 1).count() <= MOST_COPIES
    texts = docs.join(F.broadcast(copies), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_anti") if single else docs
    n_first = nodes.agg(F.sum(F.expr(f"words - {_rest('words', similarity)}"))).first()[0] or 0
    keys = first_keys(texts.select("text"), n_first, k, similarity, common)
    ends = keys.groupBy("key").agg(F.min(F.struct("fp", "n")).alias("lo"), F.max(F.struct("fp", "n")).alias("hi")).where("lo.fp < hi.fp")
    shared = stored(keys.join(few(stored(ends, "similar-ends"), FEW_KEYS), "key").selectExpr("key", "fp", "n", "lo", "hi").distinct(), "similar-shared")
    discard(keys)
    sizes = F.expr(f"least(nu, nv) >= {similarity!r}D * greatest(nu, nv) - 1e-6D")
    # First each with the least and the greatest node under a key: what is many times alike is so connected in few comparisons.
    star = shared.select(F.col("fp").alias("x"), F.col("n").alias("nx"), F.explode(F.array("lo", "hi")).alias("y")).where("x <> y.fp")
    ordered = star.selectExpr("least(x, y.fp) AS u", "if(x < y.fp, nx, y.n) AS nu", "greatest(x, y.fp) AS v", "if(x < y.fp, y.n, nx) AS nv")
    first = _verified(docs, nodes, ordered.where(sizes), k, similarity)
    # Then all with all that are not yet connected: a pair left out here is a pair without a key in common, or in one component.
    roots = stored(components(first), "similar-roots")
    placed = shared.select("key", "fp", "n").join(few(roots.withColumnRenamed("node", "fp"), FEW_KEYS), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    apart = stored(placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("key"), "similar-apart")
    left = stored(placed.join(few(apart, FEW_KEYS), "key", "left_semi"), "similar-left")
    side = lambda i: left.select("key", F.col("fp").alias(i), F.col("n").alias(f"n{i}"), F.col("root").alias(f"r{i}"))
    met = side("u").join(side("v"), "key").where("u < v and ru <> rv").where(sizes).select("u", "nu", "v", "nv")
    return first.unionByName(_verified(docs, nodes, met, k, similarity))


def keep_similar(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of texts that verified links connect: the first by doc_id (null after all others), words and a hash of the text.

    Words are lower-cased; texts of the same words are alike whatever lies between; those without words are one group.
    """
    moved, back = aside(docs, ("_id", "_h", "_oh"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    with scratch() as s:
        hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
        described = stored(hashed.mapInArrow(_described, f"doc_id {kind}, h long, fp long, words long"), "similar-described")
        found = similar_links(hashed, described, k, similarity)
        odd = s.keep(stored(unkept(described.select("doc_id", "h", "fp"), lambda nodes: found), "simhash-unkept"))
    return _without(moved, odd).withColumnsRenamed(back)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all documents; 3-word shingles, 2 bits."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
