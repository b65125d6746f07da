"""Documents and vectors: chunks, chunk ids, personal-data screening, nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import few, scratch, stored

#: Separators in the order they are tried, and sizes in characters.
SEPARATORS = ("\n\n", "\n", ". ", ", ", " ")
CHUNK, OVERLAP, LEAST = 500, 50, 30
#: Patterns of personal data.
PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "card": r"\b[0-9]{16}\b",
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "phone": r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
}


def split_text(text: str, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that fits, each beginning with the end of the last."""

    def parts(s: str, level: int) -> list[str]:
        if len(s) <= size:
            return [s]
        if level == len(SEPARATORS):
            return [s[i : i + size] for i in range(0, len(s), size)]
        return [p for piece in s.split(SEPARATORS[level]) if piece for p in parts(piece, level + 1)]

    out, held = [], ""
    for p in parts(text, 0):
        if held and len(held) + 1 + len(p) > size:
            out.append(held)
            tail = held[-overlap:] if overlap and len(p) + overlap < size else ""
            held = (tail + " " + p).strip()
        else:
            held = f"{held} {p}" if held else p
    out.append(held)
    return [x for x in (y.strip() for y in out) if len(x) >= least]


def chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, at, content, chunk_id (of document, place and first 50 characters)."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: split_text(t, size, overlap))

    out = docs.select("doc_id", F.posexplode(cut("text")).alias("at", "content"))
    return out.withColumn("chunk_id", F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("at").cast("string"), F.substring("content", 1, 50))), 1, 16))


def personal_counts(text: Column) -> dict[str, Column]:
    return {k: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, p in PERSONAL.items()}


def redacted(text: Column) -> Column:
    for k, p in PERSONAL.items():
        text = F.regexp_replace(text, p, f"[{k}]")
    return text


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of doubles, in whole-number order of their places."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def reranked(found: DataFrame, score: Column, k: int, least: float) -> DataFrame:
    """found (query_id, vec_id, ...) ordered by another score, which may cost more as it sees few pairs: the best k of each query that reach `least`."""
    scored = found.withColumn("score", F.round(score, 6)).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """query_id, vec_id, similarity, rank: the k vectors of greatest cosine for every query, itself apart.

    Exact: every query meets every vector, in groups of a bounded number of either, each of which gives k for each of its
    queries.  Neither goes through the driver.
    """
    one = F.lit(0).alias("cell")
    v = F.col("embedding").cast("array<double>").alias("embedding")
    asked = queries.select(one, F.col("vec_id").alias("_r"), F.col("vec_id").alias("query_id"), v)
    held = vectors.select(one, F.col("vec_id").alias("_r"), "vec_id", v)
    return _ranked(asked, held, k, PIECE)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


#: Vectors of the sample that cells are fitted on at most, cells at most, sampled queries and the recall wanted of them, and vectors of a piece of a cell.
CELL_SAMPLE, MOST_CELLS, TRIED, RECALL, PIECE = 20_000, 4096, 500, 0.95, 4096


@dataclass
class Cells:
    centres: np.ndarray
    probes: int  # cells that a query looks into


def fit_cells(vectors: DataFrame, sample: int = CELL_SAMPLE, most: int = MOST_CELLS, rounds: int = 8, k: int = 10) -> Cells:
    """About the root of as many cells as there are vectors, by spherical k-means over a bounded sample, chosen by a hash of the id.

    A query looks into as many cells as it takes to find RECALL of the k nearest within the sample: few where vectors
    lie in clusters, most cells where they have no order at all.
    """
    n = vectors.count()
    if not n:
        return Cells(np.zeros((0, 0)), 1)
    drawn = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int(min(1.0, sample / n) * (1 << 40)))
    x = np.array([r.embedding for r in drawn.select("vec_id", "embedding").orderBy("vec_id").limit(sample).collect()], np.float64)
    if not len(x):
        x = np.array([r.embedding for r in vectors.orderBy("vec_id").limit(1).collect()], np.float64)
    x = _unit(x)
    cells = max(1, min(most, len(x), round(n**0.5)))
    centres = x[np.random.default_rng(5).choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        at = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        full = np.bincount(at, minlength=cells) > 0
        centres[full] = _unit(sums[full])
    q = x[: min(TRIED, len(x))]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -2
    near = np.argsort(-s, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1), axis=1)  # of each cell in the query's order
    needed = np.sort(np.take_along_axis(place, (x @ centres.T).argmax(axis=1)[near], axis=1).ravel())
    return Cells(centres, int(needed[int(RECALL * (len(needed) - 1))]) + 1 if len(needed) else cells)


def in_cells(vectors: DataFrame, centres: np.ndarray, n: int, name: str) -> DataFrame:
    """(cell, id, embedding) of each vector's n nearest cells; every vector is placed, in the sample or not."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argsort(-(_matrix(batch.column("embedding")) @ shared.value.T), axis=1, kind="stable")[:, :n]
            at = np.repeat(np.arange(len(batch)), near.shape[1])
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), rows.column("vec_id"), rows.column("embedding")], names=["cell", name, "embedding"])

    return vectors.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(run, f"cell int, {name} long, embedding array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def dealt(asked: DataFrame, held: DataFrame, keys: list[str], piece: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with `_a` and `_h`, to be grouped together by keys and these: of a key's rows, `piece` of either side about meet in a group.

    So a key that many rows ask for, or that holds many, is many groups of a bounded size; every row asked meets every row held.  Rows are
    told apart by `_r`.  Keys that one side alone has are left out.
    """
    parts = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(piece)).cast("int").alias(n))
    sizes = few(stored(parts(asked, "_na").join(parts(held, "_nh"), keys), "pieces"), 200_000)  # a row per key
    own = lambda n: F.pmod(F.xxhash64("_r"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = asked.join(sizes, keys).select(*asked.columns, own("_na").alias("_a"), every("_nh").alias("_h"))
    h = held.join(sizes, keys).select(*held.columns, every("_na").alias("_a"), own("_nh").alias("_h"))
    return a, h, [*keys, "_a", "_h"]


def nearest_in_cells(queries: DataFrame, vectors: DataFrame, cells: Cells, k: int = 10, piece: int = PIECE) -> DataFrame:
    """nearest(), but a query meets only the vectors of the cells nearest to it: not exact (its recall is tested), with work that shrinks as cells get smaller.

    Cells of more than `piece` vectors are split, and so are the queries that look into one: each piece gives k for each of its queries.
    """
    placed = in_cells(vectors, cells.centres, 1, "vec_id").select("cell", F.col("vec_id").alias("_r"), "vec_id", "embedding")
    asked = stored(in_cells(queries, cells.centres, cells.probes, "query_id").select("cell", F.col("query_id").alias("_r"), "query_id", "embedding"), "cell-queries")
    return _ranked(asked, placed, k, piece)


def _ranked(asked: DataFrame, held: DataFrame, k: int, piece: int) -> DataFrame:
    """asked: cell, _r, query_id, embedding; held: cell, _r, vec_id, embedding."""
    left, right, by = dealt(asked, held, ["cell"], piece)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        qid, vid = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        q, v = (_matrix(t.column("embedding").combine_chunks()) for t in (left, right))
        out = []
        for i in range(0, len(qid) if len(vid) else 0, 1000):
            s = np.round(q[i : i + 1000] @ v.T, 6)
            s[qid[i : i + 1000, None] == vid[None, :]] = -2
            order = np.lexsort((np.broadcast_to(vid, s.shape), -s), axis=1)[:, :k]
            top = np.take_along_axis(s, order, axis=1)
            keep = (top > -2).ravel()
            out.append((np.repeat(qid[i : i + 1000], order.shape[1])[keep], vid[order].ravel()[keep], top.ravel()[keep]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "similarity"), columns, strict=True)))

    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, "query_id long, vec_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


#: Rows of an owner's cell that meet at once.
MET = 4096


def _visited(centres: np.ndarray, least: float | None):
    """Each row with its own cell, and (least given) with every other cell that may hold a vector of that cosine to it.

    Of two vectors in the cells of c' and c, the difference reaches over the plane between c' and c: if x lies further from
    it than the chord of the least cosine, no vector beyond it is near enough.
    """
    gaps = np.linalg.norm(centres[:, None] - centres[None, :], axis=2)
    chord = (2 - 2 * least) ** 0.5 + 1e-9 if least is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            d = _matrix(batch.column("e")) @ centres.T
            own = d.argmax(axis=1)
            if least is None:
                row, cell = np.arange(len(batch)), own
            else:
                row, cell = np.nonzero(d[np.arange(len(d)), own][:, None] - d <= chord * gaps[own])
            out = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    return run


SEEN = "_r long, owner string, at long, vec_id long, e array<double>"


def best_earlier(asked: DataFrame, held: DataFrame, centres: np.ndarray, least: float, piece: int = MET) -> DataFrame:
    """(_r, best): of the rows held that came before a row asked, to its owner, with a cosine of `least` to it: the nearest, then the first; rows without any are left out.

    Both have the columns SEEN.  All such are found: a row asked meets the cells that may hold one.  A task gives a row for each row asked at most.
    """
    a = asked.mapInArrow(_visited(centres, least), f"{SEEN}, cell int")
    h = held.mapInArrow(_visited(centres, None), f"{SEEN}, cell int")
    left, right, by = dealt(a, h, ["owner", "cell"], piece)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, out = left.column("_r").to_numpy(), []
        if len(rows) and right.num_rows:
            (at, i), (bt, j) = ((t.column("at").to_numpy(), t.column("vec_id").to_numpy()) for t in (left, right))
            x, y = (_matrix(t.column("e").combine_chunks()) for t in (left, right))
            line = np.lexsort((j, bt))
            bt, j, y = bt[line], j[line], y[line]
            for k in range(0, len(rows), 1024):
                s = x[k : k + 1024] @ y.T
                a_, i_ = at[k : k + 1024, None], i[k : k + 1024, None]
                s[~((bt < a_) | ((bt == a_) & (j < i_))) | (s < least)] = -2
                s = np.round(s, 6)
                top = s.argmax(axis=1)  # the first of equal ones
                found = np.flatnonzero(s[np.arange(len(s)), top] > -2)
                out.append((rows[k + found], s[found, top[found]], bt[top[found]], j[top[found]]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        return pa.table(dict(zip(("_r", "similarity", "at", "vec_id"), columns, strict=True)))

    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, "_r long, similarity double, at long, vec_id long")
    return found.groupBy("_r").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "at", "vec_id")).alias("best"))


def admitted(memories: DataFrame, least: float = 0.85, piece: int = MET) -> DataFrame:
    """vec_id, owner, accepted, duplicate_of, similarity of each row of memories (vec_id, owner, at, embedding): memories are written in order of `at`, then vec_id.

    One is rejected if its owner already has one of a cosine of `least` to it; duplicate_of is the nearest of those (rounded to 6 places), then the first.
    The result is that of going through them one by one.  It is found in rounds: what has no earlier undecided neighbour is accepted, what has
    an accepted one is rejected, so that a group of near copies is decided in one round.  Equal vectors of an owner are decided by the first.
    Rows of one time and id are one memory; a memory whose vector is null, empty or zero is accepted; null owners are one owner.
    """
    with scratch() as scope:
        e = F.col("embedding").cast("array<double>")
        whole = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
        owner = F.coalesce(F.concat(F.lit("="), F.col("owner").cast("string")), F.lit(""))
        rows = stored(memories.select(F.monotonically_increasing_id().alias("_r"), owner.alias("_o"), "owner", F.col("at").cast("long").alias("at"), "vec_id", F.when(whole, e).alias("e")), "memories")
        real = rows.where("e is not null").select("_r", F.col("_o").alias("owner"), "at", "vec_id", "e")
        first = real.groupBy("owner", "e").agg(F.min(F.struct("at", "vec_id", "_r")).alias("f"))
        open_ = stored(first.select("f._r", "owner", "f.at", "f.vec_id", "e"), "memories-open")
        most = open_.groupBy("owner").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        # As many cells as pieces of the largest owner; one where owners are small.
        centres = fit_cells(open_.select(F.col("_r").alias("vec_id"), F.col("e").alias("embedding")), most=max(1, min(MOST_CELLS, most // piece))).centres
        kept = None
        while open_.limit(1).count():
            waits = stored(best_earlier(open_, open_, centres, least, piece).select("_r"), "memories-wait")
            new = stored(open_.join(few(waits, 300_000), "_r", "left_anti").select(*open_.columns), "memories-new")
            rest = open_.join(few(waits, 300_000), "_r", "left_semi").select(*open_.columns)
            near = stored(best_earlier(rest, new, centres, least, piece).select("_r"), "memories-near")
            open_ = stored(rest.join(few(near, 300_000), "_r", "left_anti").select(*open_.columns), "memories-open")
            kept = new if kept is None else kept.unionByName(new)
        if kept is None:
            found = rows.where("false").select("_r", F.lit(None).cast("struct<far:double,at:bigint,vec_id:bigint>").alias("best"))
        else:
            found = stored(best_earlier(real, kept, centres, least, piece), "memories-best")
        out = rows.join(found, "_r", "left")
        return scope.keep(stored(out.select("vec_id", "owner", F.col("best").isNull().alias("accepted"), F.col("best.vec_id").alias("duplicate_of"), (-F.col("best.far")).alias("similarity")), "memories-result"))
