"""Operator 5, quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics of whole texts are standardised and mapped to FEATURES random cosines, whose products
approximate a Gaussian kernel.  Every partition sums its normal equations; Spark adds the sums, and the
driver solves one system of fixed size.  A part of the labelled rows set aside calibrates: scores fall in
fixed bins, and pool-adjacent-violators over the bins gives a monotone map to probabilities.

Defined results: null and empty texts have all statistics zero and are scored like others; null labels
are no labels, several labels of one document are averaged, labels of unknown documents are ignored;
with no usable label all scores are 0.5, with labels of one kind their mean; repeated rows score alike;
an empty table gives no rows; further columns pass through, those named like the results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch, stored

FEATURES, BINS, SEED = 256, 1000, 11
STATISTICS = 20


def statistics(text: str | None) -> list[float]:
    """STATISTICS numbers about a whole text, all of them moderate in size."""
    raw = (text or "").encode()
    w = raw.split()
    n = len(w)
    if not n:
        return [0.0] * STATISTICS
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = by[65:91].sum(), by[97:123].sum(), by[48:58].sum()
    sizes = np.fromiter(map(len, w), np.int64, n)
    share = by[by > 0] / len(raw)
    lines = [x for x in (x.strip() for x in raw.split(b"\n")) if x]
    distinct = len(set(w))
    windows = len(set(zip(w, w[1:], w[2:], strict=False))) / (n - 2) if n > 2 else 1.0
    symbols = sum(int(by[c]) for c in b"#*$%&|<>")
    return [
        math.log1p(n),
        float(sizes.mean()) / 4,
        math.log1p(float(sizes.std())),
        math.log1p(int(sizes.max())),
        math.log1p(4 * symbols / n),
        math.log1p(4 * int(by[33]) / n),
        float(upper / max(1, upper + lower)),
        math.log1p(float(digits / n)),
        float(by[128:].sum() / len(raw)),
        math.log1p(float(by[46] + by[44]) / n),
        distinct / n,
        math.log(distinct) / math.log(n + 1),
        windows,
        len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        float(-(share * np.log2(share)).sum()),
        math.log1p(float((by[34] + by[39:42].sum() + by[45] + by[47] + by[58:60].sum()) / n)),
        float((sizes > 12).mean()),
        float((sizes < 3).mean()),
        math.log1p(int(by[124]) / n),
    ]


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))


def _rows_of(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def statistics_of(text: Column) -> Column:
    """The statistics of each text, as an array; no other column goes to Python."""

    def run(texts: pa.Array) -> pa.Array:
        return _lists(np.array([statistics(t.as_py()) for t in texts], np.float64).reshape(-1, STATISTICS))

    return F.arrow_udf(run, "array<double>")(text)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of each text."""
    return docs.select("doc_id", statistics_of(F.col("text")).alias("x"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None
    constant: float | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.turn + self.shift) * math.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        r = self.raw(x)
        # A thousandth of the score keeps the order of documents within a level of the isotonic map.
        return np.clip(0.999 * np.interp(r, self.knots, self.values) + 0.001 / (1 + np.exp(-4 * (r - 0.5))), 0.0, 1.0)


def _summed(model: Model):
    """Normal equations of a partition, one row for each of their lines; the last entry is the right-hand side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        n = 0
        for batch in batches:
            z, y = model.features(_rows_of(batch.column("x"))), batch.column("y").to_numpy()
            total += z.T @ np.hstack([z, y[:, None]])
            n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), _lists(total)], names=["i", "line"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each number added up; a task holds one sum for each of its numbers."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        lines = batch.column("line").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES + 2)
        for i, line in zip(batch.column("i").to_pylist(), lines, strict=True):
            sums[i] = sums[i] + line if i in sums else line.copy()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), _lists(np.array(list(sums.values())))], names=["i", "line"])


def _raw_scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_rows_of(batch.column("x")))), batch.column("y")], names=["r", "y"])

    return run


def isotonic(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nearest non-decreasing values to mean under the weights."""
    blocks: list[list[float]] = []
    for w, m in zip(weight.tolist(), mean.tolist(), strict=True):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2]
    return np.concatenate([np.full(int(n), m) for _, m, n in blocks]) if blocks else np.zeros(0)


def fit(measures: DataFrame, labels: DataFrame, ridge: float = 1e-4) -> Model:
    """The model of labelled rows that are not held out: all of them, three quarters for ridge, the rest for calibration."""
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.avg("quality").cast("double").alias("y"))
    rows = measures.where(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("_id")).select("x", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("aside"))
    with scratch():
        return _fit(stored(rows, "quality-rows"), ridge)


def _fit(rows: DataFrame, ridge: float) -> Model:
    moments = rows.agg(F.count("*"), F.avg("y"), *[g(F.col("x")[i]) for i in range(STATISTICS) for g in (F.avg, F.stddev_pop)], F.min("y"), F.max("y")).first()
    rng = np.random.default_rng(SEED)
    mean, scale = np.array([x or 0.0 for x in moments[2:-2:2]]), np.array([x or 0.0 for x in moments[3:-2:2]])
    model = Model(mean, np.maximum(scale, 1e-3), rng.normal(0, 1 / math.sqrt(STATISTICS), (STATISTICS, FEATURES)), rng.uniform(0, 2 * math.pi, FEATURES))
    if not moments[0] or moments[-1] == moments[-2]:
        model.constant = float(moments[1]) if moments[0] else 0.5
        return model
    fitting, aside = rows.where(~F.col("aside")), rows.where("aside")
    if not fitting.limit(1).count() or not aside.limit(1).count():
        fitting = aside = rows
    lines = fitting.mapInArrow(_summed(model), "i int, line array<double>")
    sums = lines.repartition("i").mapInArrow(_added, "i int, line array<double>").collect()  # FEATURES + 1 rows
    system = np.zeros((FEATURES + 1, FEATURES + 2))
    for i, line in sums:
        system[i] = line
    n = system[-1, FEATURES]
    penalty = np.full(FEATURES + 1, ridge * n)
    penalty[-1] = 1e-9 * n
    model.weights = np.linalg.solve(system[:, :-1] + np.diag(penalty), system[:, -1])
    at = F.floor(F.least(F.greatest("r", F.lit(-0.5)), F.lit(1.5)) * (BINS / 2))
    binned = aside.mapInArrow(_raw_scores(model), "r double, y double").groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.avg("r").alias("r")).collect()
    binned.sort(key=lambda b: b["at"])
    count, r = np.array([b["n"] for b in binned], float), np.array([b["r"] for b in binned])
    model.knots, model.values = r, isotonic(count, np.array([b["y"] for b in binned]))
    return model


def score_of(model: Model, x: Column) -> Column:
    """The score of each array of statistics."""
    return F.arrow_udf(lambda xs: pa.array(model.score(_rows_of(xs)), pa.float64()), "double")(x)


def score(docs: DataFrame, model: Model, x: Column | None = None) -> DataFrame:
    """docs with score and predicted; x: the column of statistics where they are known, else they are taken of the text."""
    docs = docs.drop("score", "predicted")
    found = docs.withColumn("score", score_of(model, statistics_of(F.col("text")) if x is None else x))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document, by a model of the labelled rows with crc32(doc_id) mod 3 not 1."""
    with scratch() as s:
        measures = s.keep(stored(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality-measures"))
        model = fit(measures, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(measures, model, F.col("x")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
