"""Operator 11, periodic runs of words by a harmonic grid.

A run of period p and length 2p at least covers two neighbouring multiples of p.  So for each p up to
half the text, only the n/p pairs (kp, kp + p) are looked at, n log n pairs in all: how far the text
goes on alike from both, forwards and backwards, gives the run that covers them.  These extensions are
found for all pairs at once, by binary search over prefix hashes in numpy.  Short texts share one
vectorised pass; pairs are taken in slices of a fixed number, so that memory does not grow with them.

Prefix hashes are polynomials modulo 2^64, which can be wrong; so the words of every run found are
compared, and where that fails, the period is gone through word by word.  A stretch is found under
its period and its multiples; the least of them stays.

Defined results: null and empty texts and texts of white space alone have no words, no runs and an
empty collapsed text; null ids stay null; repeated rows are taken each by itself; a run may lie in
another or overlap it; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import py_words, words

#: Words of the shortest run.
LEAST = 12
#: Words of texts that go through one pass together, and pairs of a slice.
TOGETHER, SLICE = 1 << 16, 1 << 18

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A well spread 64-bit value for each word number."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Prefixes:
    """Hashes of any stretch of a word sequence in constant time."""

    def __init__(self, ids: np.ndarray) -> None:
        self.powers = np.ones(len(ids) + 1, np.uint64)
        np.cumprod(np.full(len(ids), BASE, np.uint64), out=self.powers[1:])
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(_mixed(ids) * self.powers[:-1], out=self.sums[1:])

    def alike(self, i: np.ndarray, p: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the `size` words from i on are those p places further."""
        s = self.sums
        return (s[i + size] - s[i]) * self.powers[p] == s[i + p + size] - s[i + p]

    def reach(self, i: np.ndarray, p: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words, `most` at most, are alike from i and i + p on (back: before them)."""
        found = np.zeros(len(i), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step := step >> 1:
            size = found + step
            ok = np.flatnonzero(size <= most)
            size, at = size[ok], i[ok]
            ok = ok[self.alike(at - size if back else at, p[ok], size)]
            found[ok] += step
        return found


def _grid(sizes: np.ndarray, first: np.ndarray, slice_of: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of all (text number, place, period) of the grids of texts with these sizes and first places."""
    text = np.repeat(np.arange(len(sizes)), sizes // 2)
    p = np.arange(len(text)) - np.repeat(np.cumsum(sizes // 2) - sizes // 2, sizes // 2) + 1
    ends = np.cumsum((sizes[text] - 1) // p) if len(text) else np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    for lo in range(0, int(ends[-1]) if len(ends) else 0, slice_of):
        a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, lo + slice_of, "left")
        begin, end = np.maximum(starts[a:b], lo), np.minimum(ends[a:b], lo + slice_of)
        row = np.repeat(np.arange(a, b), end - begin)
        k = np.arange(len(row)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + np.repeat(begin - starts[a:b], end - begin)
        yield text[row], first[text[row]] + k * p[row], p[row]


def _by_word(ids: np.ndarray, p: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, p) of the stretches of one period, word by word."""
    same = np.concatenate(([False], ids[:-p] == ids[p:], [False]))
    edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
    return [(a, b + p, p) for a, b in edges.tolist() if b - a >= max(p, least - p)]


def runs_of(texts: list[list[bytes]], least: int = LEAST, slice_of: int = SLICE) -> list[np.ndarray]:
    """Of each text (its words) the runs as rows (start, length, period), in order of start and period."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    last = np.cumsum(sizes)
    first = last - sizes
    hashes, found = Prefixes(ids), np.zeros((0, 4), np.int64)  # text, start, end, period
    for text, i, p in _grid(sizes, first, slice_of):
        keep = np.flatnonzero(ids[i] == ids[i + p])
        text, i, p = text[keep], i[keep], p[keep]
        # A run goes on for half of what it needs at least, forwards or backwards.
        need = np.maximum(p, least - p)
        half = (need + 1) // 2
        ahead, behind = last[text] - i - p, i - first[text]
        fits, fitted = half <= ahead, half <= behind
        likely = np.zeros(len(i), bool)
        likely[fits] = hashes.alike(i[fits], p[fits], half[fits])
        likely[fitted] |= hashes.alike(i[fitted] - half[fitted], p[fitted], half[fitted])
        text, i, p, need, ahead, behind = (x[likely] for x in (text, i, p, need, ahead, behind))
        forth, back = hashes.reach(i, p, ahead, False), hashes.reach(i, p, behind, True)
        whole = forth + back >= need
        rows = np.stack([text, i - back, i + p + forth, p], axis=1)[whole]
        found = _least_periods(np.concatenate([found, rows]))
    return _verified(found, ids, first, last, least)


def _least_periods(rows: np.ndarray) -> np.ndarray:
    """One row of each (text, start, end): that of the least period."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, 1:3] != rows[:-1, 1:3]).any(axis=1)
    return rows[new]


def _verified(found: np.ndarray, ids: np.ndarray, first: np.ndarray, last: np.ndarray, least: int) -> list[np.ndarray]:
    good, wrong = [], set()
    for text, a, b, p in found.tolist():
        lo, hi = first[text], last[text]
        ends_here = (a == lo or ids[a - 1] != ids[a - 1 + p]) and (b == hi or ids[b] != ids[b - p])
        if ends_here and np.array_equal(ids[a : b - p], ids[a + p : b]):
            good.append((text, a - lo, b - lo, p))
        else:
            wrong.add(text)
    # A wrong extension may also have hidden runs of other periods behind it: the text is done anew without hashes.
    good = [r for r in good if r[0] not in wrong]
    for text in wrong:
        own = ids[first[text] : last[text]]
        good += [(text, *r) for p in range(1, len(own) // 2 + 1) for r in _by_word(own, p, least)]
    rows = np.array(good, np.int64).reshape(-1, 4)
    out = []
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(first) + 1))
    for k in range(len(first)):
        r = _least_periods(rows[cuts[k] : cuts[k + 1]])
        r = r[np.lexsort((r[:, 3], r[:, 1]))]
        out.append(np.stack([r[:, 1], r[:, 2] - r[:, 1], r[:, 3]], axis=1))
    return out


def collapsed(text: list[bytes], runs: np.ndarray) -> str:
    """The words that no run contains after its first period, with single spaces."""
    if len(runs):
        depth = np.zeros(len(text) + 1, np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
        text = [text[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
    return b" ".join(text).decode()


def _found(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def done(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
            runs = runs_of(texts, least)
            ends = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
            flat = np.concatenate(runs)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"]))
            return pa.RecordBatch.from_arrays([ids, lists.cast(kind), pa.array([collapsed(t, r) for t, r in zip(texts, runs, strict=True)], pa.string())], names=["doc_id", "runs", "collapsed"])

        for batch in batches:
            ids, texts, begin, size = batch.column("doc_id"), [], 0, 0
            for k, t in enumerate(batch.column("text")):
                texts.append(py_words(t.as_py()))
                size += len(texts[-1])
                if size >= TOGETHER:
                    yield done(ids[begin : k + 1], texts)
                    texts, begin, size = [], k + 1, 0
            if texts:
                yield done(ids[begin:], texts)

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs (array of start, length, period in words, by start and period) and collapsed (the text without repeats) of every whole text; no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_found(least), f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_cycles(docs: DataFrame) -> DataFrame:
    """doc_id and text; of a tenth of the ids, chosen by CRC-32, with the words from some place on repeating a number of them."""
    # Words first, in a step of their own: used often below, they are not split again for each word.
    split = docs.select("doc_id", "text", words(F.col("text")).alias("w"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    placed = split.select("doc_id", "text", "w", ((F.col("h") % 10 == 0) & (n > 0)).alias("chosen"), F.when(n > 0, a).cast("int").alias("a"), F.when(n > 0, p).cast("int").alias("p"))
    cycled = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return placed.select("doc_id", F.when(F.col("chosen"), F.array_join(cycled, " ")).otherwise(F.col("text")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: all documents, a tenth of them with cycles laid in; the longest run, digests of all runs and of the collapsed text."""
    found = periodic_runs(with_cycles(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length, -r.start, -r.period)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed").select(
        "doc_id",
        "n_runs",
        (-F.col("m.col2")).alias("start"),
        F.col("m.length").alias("length"),
        (-F.col("m.col3")).alias("period"),
        F.floor(1000 * F.col("m.length") / -F.col("m.col3")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


# CRC-32 of the id by half bytes; a run is a stretch of equal words a period apart, so neighbours among the pairs of equal words.
SQL = r"""
WITH nibbles AS (SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(0, 4)), lambda c, b: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(0, 16) r(i))),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (
  SELECT k, doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT & 15, ascii(x)::BIGINT >> 4]))),
    lambda c, b: xor(c >> 4, t[1 + (xor(c, b) & 15)])), 4294967295) AS h FROM d, nibbles),
g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, h // 10 AS g FROM c),
x AS (
  SELECT k, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM g),
e AS (SELECT k, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM x),
m AS (SELECT e.k, e.i, f.i - e.i AS p FROM e JOIN e f ON e.k = f.k AND e.word = f.word AND f.i > e.i AND 2 * (f.i - e.i) <= e.n),
s AS (
  SELECT k, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY k, p ORDER BY i) AS stretch FROM m)
  GROUP BY k, p, stretch HAVING count(*) >= p AND count(*) + p >= 12),
r AS (SELECT k, start, length, min(p) AS period FROM s GROUP BY k, start, length),
gone AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT e.k, string_agg(word, ' ' ORDER BY e.i) AS text FROM e ANTI JOIN gone ON e.k = gone.k AND e.i = gone.i GROUP BY e.k),
q AS (SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
        max({'length': length, 'start': -start, 'period': -period}) AS b FROM r GROUP BY k)
SELECT x.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-b.start)::BIGINT AS start, b.length::BIGINT AS length, (-b.period)::BIGINT AS period, (1000 * b.length // -b.period)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM x LEFT JOIN q USING (k) LEFT JOIN kept USING (k)
"""
