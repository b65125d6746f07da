"""Operator 12, near-duplicate vectors by sorted projection passes.

Every pass has 64 random hyperplanes of its own.  The side of each on which a vector lies gives a bit, and
vectors are ordered by these bits together, so that those of one direction come to lie near each other.  Each is then
compared with the WINDOW that follow it.  A pair is linked at a cosine of 0.95 or more, by its dot product in double precision; it
counts in the first pass whose window holds it, which the places of both in all passes tell, so
pairs are counted in matrix products and never written out.  The components of a block's links go out as one row for each
vector.  Passes grow with the number of vectors (`passes_for`), so that a pair at the very threshold, which is the
hardest to find, is still in some window with the probability FOUND; nearer pairs are found almost surely.

Windows are bounded, groups are not.  Equal vectors are one node with a count.  Dense groups are first
covered by balls: rounds of sorting and greedy covering, after each of which the centres alone go on, so that a group comes
down to about one centre whatever its size.  Vectors within half the threshold's angle of a centre
are all linked to each other by the triangle inequality; so a ball of any size gives its links exactly, by its count,
and windows only look for pairs that no ball holds.  What can be missed are pairs outside balls that no window holds.

Defined results: null, empty and zero vectors and those with null or non-finite components link
with nothing, and so do vectors of different lengths; rows with equal vectors link with each other, whatever their ids;
component_id is null where all ids are; kept holds for every row that has its component's id; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import few, scratch, stored
from .simhash import components

COSINE = 0.95
#: Vectors that each is compared with in a pass; rows of a block, which also gets the window that follows it.
WINDOW, BLOCK = 1024, 4096
#: The probability that a window holds a pair at the threshold, and passes at least.
FOUND, LEAST_PASSES = 0.98, 4
#: Rounds of covering, and rows that are covered together.
ROUNDS, COVERED = 4, 1024
BITS = 64


def passes_for(n: int, window: int = WINDOW, cosine: float = COSINE) -> int:
    """A pair lies in a window if it shares the bits that cut n down to a window's size; each bit with the probability 1 - angle / pi."""
    once = (1 - math.acos(cosine) / math.pi) ** max(0.0, math.log2(max(n, 1) / window))
    return max(LEAST_PASSES, math.ceil(math.log(1 - FOUND) / math.log(1 - min(once, 0.999))))


def planes(width: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, width)).standard_normal((width, n * BITS))


def codes(u: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n signed 64-bit codes of each row, whose order is that of the bits."""
    out = np.empty((len(u), n), np.int64)
    for at in range(0, len(u), 4096):
        raw = np.packbits(u[at : at + 4096] @ planes(u.shape[1], n, seed) > 0, axis=1).reshape(-1, n, 8)
        out[at : at + 4096] = (np.ascontiguousarray(raw).view(">u8")[:, :, 0].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one width."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), kind))


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # the greatest numbers cannot overflow
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _by_width(widths: np.ndarray) -> Iterator[np.ndarray]:
    for w in np.unique(widths):
        yield np.flatnonzero(widths == w)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, width, n, u) of (node, width, n, v)."""
    for batch in batches:
        widths = batch.column("width").to_numpy()
        for at in _by_width(widths):
            part = batch.take(pa.array(at))
            u = lists(unit(matrix(part.column("v"))), pa.float64())
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("width"), part.column("n"), u], names=["node", "width", "n", "u"])


def with_codes(points: DataFrame, n: int, seed: int) -> DataFrame:
    """points (node, width, n, u) with `codes`, an array of n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in _by_width(batch.column("width").to_numpy()):
                part = batch.take(pa.array(at))
                found = lists(codes(matrix(part.column("u")), n, seed), pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "width", "n", "u")), found], names=["node", "width", "n", "u", "codes"])

    return points.select("node", "width", "n", "u").mapInArrow(run, "node bigint, width int, n bigint, u array<double>, codes array<bigint>")


def cover(u: np.ndarray, weight: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """(parent, centre): the row that covers each, itself if none does, and the centres, in place of rows that cover others."""
    parent, centre = np.arange(len(u)), u.copy()
    near = u @ u.T >= cosine
    degree = near @ weight - weight
    free = np.ones(len(u), bool)
    radius = math.sqrt((1 + cosine) / 2)
    for i in np.lexsort((np.arange(len(u)), -degree)):
        if degree[i] <= 0:
            break
        if not free[i]:
            continue
        members = np.flatnonzero(near[i] & free)
        c = weight[members] @ u[members]
        c /= np.linalg.norm(c)
        inside = members[u[members] @ c >= radius]
        if len(inside) > 1:
            head = i if i in inside else inside[0]
            parent[inside], centre[head], free[inside] = head, c, False
    return parent, centre


def _covering(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of neighbours in the partition's order: survivors with their centre and weight, others with their parent."""

        def done(held: pa.Table) -> pa.RecordBatch:
            u, n, node = matrix(held.column("u").combine_chunks()), held.column("n").to_numpy(), held.column("node").to_numpy()
            parent, centre = cover(u, n.astype(np.float64), cosine)
            total = np.bincount(parent, weights=n, minlength=len(n)).astype(np.int64)
            left = parent == np.arange(len(parent))
            vectors = pa.array([x if k else None for x, k in zip(centre, left.tolist(), strict=True)], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([held.column("node").combine_chunks(), held.column("width").combine_chunks(), pa.array(np.where(left, total, n)), vectors, pa.array(node[parent], mask=left)], names=["node", "width", "n", "u", "parent"])

        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch.select(["node", "width", "n", "u"])])
            held = part if held is None else pa.concat_tables([held, part])
            while held.num_rows:
                widths = held.column("width").to_numpy()
                same = int(np.argmax(widths != widths[0])) or held.num_rows
                if same < COVERED and same == held.num_rows:
                    break
                yield done(held.slice(0, min(same, COVERED)))
                held = held.slice(min(same, COVERED))
        if held is not None and held.num_rows:
            yield done(held)

    return run


def balls(nodes: DataFrame, cosine: float = COSINE, rounds: int = ROUNDS) -> DataFrame:
    """(node, ball) of the nodes that lie within half the threshold's angle of a centre with others: all of a ball are linked."""
    points, gone = nodes, []
    for r in range(rounds):
        coded = with_codes(points, 1, 1000 + r).withColumn("code", F.col("codes")[0]).drop("codes")
        ordered = coded.repartitionByRange("width", "code", "node").sortWithinPartitions("width", "code", "node")
        found = stored(ordered.mapInArrow(_covering(cosine), "node bigint, width int, n bigint, u array<double>, parent bigint"), "projection-cover")
        points = found.where("parent is null").select("node", "width", "n", "u")
        gone.append(found.where("parent is not null").select("node", "parent"))
    resolved = None
    for one in reversed(gone):
        if resolved is None:
            resolved = one.select("node", F.col("parent").alias("ball"))
        else:
            later = resolved.select(F.col("node").alias("parent"), "ball")
            resolved = one.join(few(later), "parent", "left").select("node", F.coalesce("ball", "parent").alias("ball")).unionByName(resolved)
        resolved = stored(resolved, "projection-resolved")
    heads = few(resolved.select("ball").distinct(), 300_000)
    centres = few(points.join(heads, points.node == F.col("ball"), "left_semi").select(F.col("node").alias("ball"), F.col("u").alias("centre")), 20_000)
    own = resolved.unionByName(resolved.select(F.col("ball").alias("node"), "ball").distinct())
    placed = nodes.select("node", "n", "u").join(few(own, 300_000), "node").join(centres, "ball")
    dot = F.aggregate(F.zip_with("u", "centre", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    # The margin is far above what rounding can change.
    inside = stored(placed.where(dot >= math.sqrt((1 + cosine) / 2) + 1e-9).select("node", "ball", "n"), "projection-inside")
    sizes = inside.groupBy("ball").agg(F.sum("n").alias("size"), F.min("node").alias("root"), F.count("*").alias("members")).where("members > 1").drop("members")
    return stored(inside.join(few(sizes, 300_000), "ball").select("node", "ball", "size", "root"), "projection-balls")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = len(batch)
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("pass"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=["node", "pass", "part", "at"])
        at += n


def places(coded: DataFrame) -> DataFrame:
    """(node, places): for each pass its place in one numbering of all passes' orders."""
    long = coded.select("node", "width", F.posexplode("codes").alias("pass", "code"))
    ordered = long.repartitionByRange("pass", "width", "code", "node").sortWithinPartitions("pass", "width", "code", "node")
    found = stored(ordered.mapInArrow(_numbered, "node bigint, pass int, part int, at bigint"), "projection-places")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    begin = found.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("begin"))
    numbered = found.join(few(begin), "part").select("node", F.struct("pass", (F.col("begin") + F.col("at")).alias("place")).alias("p"))
    return numbered.groupBy("node").agg(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["place"]).alias("places"))  # a row for each pass


def _compared(window: int, block: int, cosine: float, step: int = 1024):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("place")
        node, place, turn, n, ball = (table.column(c).to_numpy() for c in ("node", "place", "pass", "n", "ball"))
        all_places, widths = matrix(table.column("places").combine_chunks()), table.column("width").to_numpy()
        owner = place // block == table.column("block").to_numpy()
        links, label = np.zeros(len(node), np.int64), np.arange(len(node))
        for at in _by_width(widths):
            u = matrix(table.column("u").take(pa.array(at)).combine_chunks())
            for a in range(0, len(at), step):
                left, right = at[a : a + step], at[a : a + step + window]
                i, j = np.nonzero(u[a : a + step] @ u[a : a + step + window].T >= cosine)
                i, j = left[i], right[j]
                apart = place[j] - place[i]
                keep = (apart > 0) & (apart <= window) & (turn[i] == turn[j]) & owner[i]
                i, j = i[keep], j[keep]
                _union(label, i, j)
                fresh = (ball[i] != ball[j]) | (ball[i] < 0)
                i, j = i[fresh], j[fresh]
                for s in range(all_places.shape[1]):
                    seen = (s < turn[i]) & (np.abs(all_places[i, s] - all_places[j, s]) <= window)
                    i, j = i[~seen], j[~seen]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
        rows = np.flatnonzero((links > 0) | (label != np.arange(len(node))))
        return pa.table({"node": node[rows], "links": links[rows], "root": node[label[rows]]})

    return run


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Rows that pairs (i, j) connect get one label."""
    while len(i):
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label[:] = jumped
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        if np.array_equal(before, label):
            break


def near_vectors(vectors: DataFrame, cosine: float = COSINE, window: int = WINDOW, block: int = BLOCK, passes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding)."""
    with scratch() as scope:
        v = F.col("embedding").cast("array<double>")
        whole = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
        rows = vectors.select("vec_id", F.when(whole, v).alias("v"))
        equal = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("lo"), F.count("*").alias("n"))
        named = stored(equal.select(F.monotonically_increasing_id().alias("node"), F.size("v").alias("width"), "n", "lo", "v"), "projection-nodes")
        nodes = stored(named.select("node", "width", "n", "v").mapInArrow(_units, "node bigint, width int, n bigint, u array<double>"), "projection-units")
        within = balls(nodes, cosine)
        coded = with_codes(nodes, passes or passes_for(nodes.count(), window, cosine), 1)
        full = coded.drop("codes").join(places(coded), "node").join(few(within.select("node", "ball"), 300_000), "node", "left")
        full = full.select("node", "width", "n", "u", F.coalesce("ball", F.lit(-1)).alias("ball"), "places")
        each = full.select("*", F.posexplode("places").alias("pass", "place"))
        own = F.floor(F.col("place") / block)
        blocks = F.when(F.col("place") % block < window, F.array(own, own - 1)).otherwise(F.array(own))  # a block also reads the window after it
        dealt = each.select("*", F.explode(blocks).alias("block"))
        found = stored(dealt.groupBy("block").applyInArrow(_compared(window, block, cosine), "node bigint, links bigint, root bigint"), "projection-links")
        counted = found.groupBy("node").agg(F.sum("links").alias("links"))
        ends = found.select("node", "root").unionByName(within.select("node", "root")).where("node <> root")
        edges = stored(ends.select(F.least("node", "root").alias("u"), F.greatest("node", "root").alias("v")).distinct(), "projection-edges")
        roots = components(edges)
        base = named.select("node", "v", "n", "lo").join(few(roots, 300_000), "node", "left").withColumn("root", F.coalesce("root", "node"))
        base = base.join(few(counted, 300_000), "node", "left").join(few(within.select("node", "size"), 300_000), "node", "left")
        links = F.coalesce("links", F.lit(0)) + F.coalesce("size", "n") - 1
        labelled = stored(base.select("v", "root", "lo", links.alias("n_links")), "projection-labelled")
        least = labelled.groupBy("root").agg(F.min("lo").alias("component_id"))
        known = labelled.join(least, "root").select("v", "n_links", "component_id")
        out = rows.where("v is not null").join(known, "v").select("vec_id", "n_links", "component_id")
        alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        both = out.unionByName(alone)
        return scope.keep(stored(both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "projection-result"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
