"""Operator 2, language-model scoring: a log-bilinear model trained by noise-contrastive estimation.

Counting: every task counts its tokens, Spark adds the counts; they are kept as a table.  Of the tokens above
1 / HEAD of the corpus, which are collected, those with UNIT_COUNT occurrences in training texts are units of
the model, the MOST_UNITS most frequent at most; so the model grows with the corpus up to that bound.  All
other tokens are in 256 tail classes, by their ending; within a class a token has its add-one share of the
class's count, so the model's probabilities sum to one over known tokens and one unknown of each class.

Model: two previous tokens, each one of the context codes (units of CONTEXT_COUNT occurrences have their own,
MOST_CONTEXTS at most; others one of ENDINGS by their ending), predict q = E[a] D1 + E[b] D2; unit u scores
q . R[u] + b[u].  As a score is a sum of a part of a and one of b, the normalisers of all contexts over all
units are one matrix product of their exponentials.

Training is by NCE against the units' frequencies, with noise shared by a batch so that its scores are matrix
products.  Texts are dealt to trainers and rounds by a hash of their content and doc_id; the trainers' number
grows with the corpus, to the power of two thirds, and does not depend on its partitions.  In a round every trainer goes on
from one model, in the order of the hashes; then each line of the parameters is averaged by how often the
trainers have seen its unit or context.  So every training text is used once, and other partitions give the
same model but for the order of additions.

Counts of tail tokens reach the documents by a join on the token; none of them has over one millionth of
the corpus, so no key is hot.

Defined results: null and empty texts are their end token alone; repeated rows count and score each by
itself; with no training rows all counts are 0; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import few, scratch, stored
from .text import SPACES, py_lower_words

#: The end of a text; no word holds a line break.
END = b"\n"
HEAD, MOST_UNITS, UNIT_COUNT = 1_000_000, 32_768, 20
CLASSES, ENDINGS, MOST_CONTEXTS, CONTEXT_COUNT = 256, 256, 2048, 500
WIDTH, NOISE, BATCH, RATE, SEED = 24, 64, 4096, 0.04, 3
#: Texts of the warm start, which only gives all trainers one direction; whole texts up to this many tokens.
WARM_TEXTS, WARM_TOKENS = 800, 10_000
#: Rounds of training; their trainers are as many as the tokens over this, to the power of two thirds.
ROUNDS, TRAINER_TOKENS = 3, 1 << 21
#: Lines of parameters in a row, weight of a line that a trainer has not seen, and tokens coded and scored at once.
LINES, UNSEEN, CODED_AT_ONCE, SCORED = 1024, 1e-3, 50_000, 50_000
#: Units and contexts of a block of the normalisers' product.
UNIT_BLOCK, CONTEXT_BLOCK = 2048, 256


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def tail_class(token: bytes) -> int:
    return zlib.crc32(token[-3:]) % CLASSES


# ---------------------------------------------------------------- counts


def token_counts(docs: DataFrame) -> DataFrame:
    """token, c (in training texts), c_all, over whole texts; docs has doc_id, text and held_out.  Partial sums are made before tokens are moved."""
    flat = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase + SPACES[1:], string.ascii_lowercase + " " * 5)
    tokens = docs.select("held_out", F.explode(F.concat(F.split(flat, " "), F.array(F.lit(END.decode())))).alias("token")).where("token <> ''")
    return tokens.groupBy("token").agg(F.sum(F.when(F.col("held_out"), 0).otherwise(1)).alias("c"), F.count("*").alias("c_all"))


@dataclass
class Lexicon:
    """What tasks know of tokens: units of the vocabulary, counts of the head, and sums of the tail classes."""

    tokens: list[bytes]  # of the head; the vocabulary first, by frequency
    counts: np.ndarray
    n_units: int  # of the vocabulary
    class_sum: np.ndarray  # training count of the class's tokens outside the vocabulary
    class_types: np.ndarray
    train_tokens: int
    train_types: int
    all_tokens: int

    def unit_counts(self) -> np.ndarray:
        return np.concatenate([self.counts[: self.n_units], self.class_sum]).astype(np.float64)

    def frequency(self) -> np.ndarray:
        return (self.unit_counts() + 1) / (self.unit_counts() + 1).sum()

    def contexts(self) -> np.ndarray:
        """The context code of each unit: frequent words have their own, others that of their ending; the last code is the text's begin."""
        own = min(int((self.counts[: self.n_units] >= CONTEXT_COUNT).sum()), MOST_CONTEXTS - ENDINGS - 1)
        words = [i if i < own and t != END else own + tail_class(t) % ENDINGS for i, t in enumerate(self.tokens[: self.n_units])]
        return np.array(words + [own + c % ENDINGS for c in range(CLASSES)] + [own + ENDINGS], np.int64)

    def head_units(self) -> np.ndarray:
        """The unit of each token of the head."""
        return np.array([i if i < self.n_units else self.n_units + tail_class(t) for i, t in enumerate(self.tokens)], np.int32)


class Numbered(dict):
    """Numbers of tokens: of the head from 0, others -1 - class; new ones are remembered up to a bound."""

    def __init__(self, tokens: list[bytes], most: int = 300_000):
        super().__init__(zip(tokens, range(len(tokens)), strict=True))
        self.most = len(tokens) + most

    def __missing__(self, token: bytes) -> int:
        n = -1 - tail_class(token)
        if len(self) < self.most:
            self[token] = n
        return n


def lexicon(counts: DataFrame) -> Lexicon:
    n, n_all, types = counts.agg(F.sum("c"), F.sum("c_all"), F.count(F.when(F.col("c") > 0, 1))).first()
    n, n_all = n or 0, n_all or 0
    head = counts.where((F.col("c_all") * HEAD >= n_all) | (F.col("token") == END.decode())).collect()  # HEAD at most
    head.sort(key=lambda r: (r.token != END.decode(), -r.c, r.token))
    n_units = min(MOST_UNITS, sum(r.c >= UNIT_COUNT or r.token == END.decode() for r in head))
    units = sorted(head[:n_units], key=lambda r: (-r.c, r.token))
    head = units + head[n_units:]
    tokens = [r.token.encode() for r in head]
    ending = F.substring(F.col("token").cast("binary"), -3, 3)
    sums = counts.where("c > 0").groupBy((F.crc32(ending) % CLASSES).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    class_sum, class_types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        class_sum[r.k], class_types[r.k] = r.c, r.n
    for t, r in zip(tokens[:n_units], head, strict=False):
        if r.c:
            class_sum[tail_class(t)] -= r.c
            class_types[tail_class(t)] -= 1
    return Lexicon(tokens, np.array([r.c for r in head], np.float64), n_units, class_sum, class_types, n, types, n_all)


def _coded(shared):
    """Per text: its units as uint16, what does not depend on the model, and its tokens outside the head with their numbers of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        number, unit_of = Numbered(words.tokens), words.head_units()
        head, known = np.log10(words.counts + 1), words.counts > 0
        of_class = np.log10(words.class_sum + words.class_types + 1)
        n_types = math.log10(words.train_tokens + words.train_types + 1)
        row = TaskContext.get().partitionId() << 36
        def group(held: list[list[bytes]]) -> list[tuple]:
            nonlocal row
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            ends = np.cumsum(sizes)
            k = np.fromiter(map(number.__getitem__, chain.from_iterable(held)), np.int32, int(ends[-1]))
            inside = k >= 0
            at = np.where(inside, k, 0)
            u = np.where(inside, unit_of[at], words.n_units - 1 - k)
            of_head = np.where(inside, head[at], 0.0)
            fixed = np.where(u >= words.n_units, of_head - of_class[np.maximum(u - words.n_units, 0)], 0.0)
            starts = ends - sizes
            base, fixed = (np.add.reduceat(x, starts) for x in (of_head, fixed))
            n_known = np.add.reduceat((inside & known[at]).astype(np.int64), starts)
            u, outside = u.astype("<u2"), np.flatnonzero(~inside)
            cut = np.searchsorted(outside, ends).tolist()
            out, before = [], 0
            for i, (w, a, b, c) in enumerate(zip(held, starts.tolist(), ends.tolist(), cut, strict=True)):
                rest = Counter([w[j - a] for j in outside[before:c].tolist()])
                out.append((row, b - a, int(n_known[i]), float(base[i]) - (b - a) * n_types, float(fixed[i]), u[a:b].tobytes(), [t.decode() for t in rest], list(rest.values())))
                row, before = row + 1, c
            return out

        for batch in batches:
            held, size, first = [], 0, 0
            for i, text in enumerate(batch.column("text")):
                w = py_lower_words(text.as_py())
                w.append(END)
                held.append(w)
                size += len(w)
                if size >= CODED_AT_ONCE or i + 1 == len(batch):
                    columns = [pa.array(x, t) for x, t in zip(zip(*group(held), strict=True), CODED_KINDS, strict=True)]
                    some = batch.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("held_out"), *columns], names=["doc_id", "held_out", *(f.split()[0] for f in CODED.split(", "))])
                    held, size, first = [], 0, i + 1

    return run


CODED = "row long, n_tokens long, n_known long, base double, fixed double, units binary, tokens array<string>, times array<int>"
CODED_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32())]


def coded(docs: DataFrame, words: Lexicon) -> DataFrame:
    """docs (doc_id, text, held_out) with the columns of CODED in place of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(words)
    return docs.select("doc_id", "held_out", "text").mapInArrow(_coded(shared), f"doc_id {kind}, held_out boolean, {CODED}")


# ---------------------------------------------------------------- model


@dataclass
class Model:
    e: np.ndarray  # contexts x WIDTH
    d1: np.ndarray
    d2: np.ndarray
    r: np.ndarray  # units x WIDTH
    b: np.ndarray

    @staticmethod
    def start(frequency: np.ndarray, n_contexts: int) -> Model:
        """Scores are the units' log frequencies at first, normalised from the outset."""
        rng = np.random.default_rng(SEED)
        near = lambda *shape: (rng.normal(0, 0.1, shape)).astype(np.float32)
        return Model(near(n_contexts, WIDTH), np.eye(WIDTH, dtype=np.float32) + near(WIDTH, WIDTH), np.eye(WIDTH, dtype=np.float32) + near(WIDTH, WIDTH), near(len(frequency), WIDTH), np.log(frequency).astype(np.float32))

    @staticmethod
    def filled(like: Model, value: float) -> Model:
        return Model(*(np.full_like(p, value) for p in like.parts()))

    def parts(self) -> list[np.ndarray]:
        return [self.e, self.d1, self.d2, self.r, self.b]

    def lines(self) -> np.ndarray:
        """All parameters as lines of WIDTH + 1 numbers."""
        return np.vstack([np.pad(np.vstack([self.e, self.d1, self.d2]), ((0, 0), (0, 1))), np.hstack([self.r, self.b[:, None]])])

    @staticmethod
    def of_lines(lines: np.ndarray, n_contexts: int) -> Model:
        k, w = n_contexts, WIDTH
        return Model(lines[:k, :w].copy(), lines[k : k + w, :w].copy(), lines[k + w : k + 2 * w, :w].copy(), lines[k + 2 * w :, :w].copy(), lines[k + 2 * w :, w].copy())

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        return self.e @ self.d1, self.e @ self.d2

    def normalisers(self, rows: slice = slice(None)) -> np.ndarray:
        """[a, b]: log of the sum over units of exp(score) in that context, for the rows a; the sum of products is one matrix product, by blocks of units."""
        first, second = self.halves()
        first, at = first[rows], range(0, len(self.r), UNIT_BLOCK)
        of_a = lambda i: first @ self.r[i : i + UNIT_BLOCK].T
        of_b = lambda i: second @ self.r[i : i + UNIT_BLOCK].T + self.b[i : i + UNIT_BLOCK]
        top1, top2 = (np.max([f(i).max(axis=1) for i in at], axis=0) for f in (of_a, of_b))
        z = np.zeros((len(first), len(second)))
        for i in at:
            z += np.exp(of_a(i) - top1[:, None]) @ np.exp(of_b(i) - top2[:, None]).T
        return (np.log(z) + top1[:, None] + top2).astype(np.float32)


def by_sum(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of values added up by index, of which there are 65,536 at most."""
    out = np.zeros((n, values.shape[1]), np.float32)
    order = np.argsort(index.astype(np.uint16), kind="stable")  # a radix sort
    found = index[order]
    starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    out[found[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    with np.errstate(over="ignore"):
        np.exp(np.negative(x, out=x), out=x)
        x += 1
        return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive estimation in batches, steps scaled by each parameter's past gradients."""

    def __init__(self, model: Model, past: Model, frequency: np.ndarray, context: np.ndarray, seed: int):
        self.m, self.past, self.context, self.rng = model, past, context, np.random.default_rng(seed)
        self.cdf, self.log_noise = np.cumsum(frequency), np.log(NOISE * frequency).astype(np.float32)
        self.units, self.contexts, self.held, self.size = np.zeros(len(frequency)), np.zeros(len(model.e)), [], 0

    def step(self, a: np.ndarray, b: np.ndarray, u: np.ndarray) -> None:
        m, n = self.m, len(u)
        noise = np.minimum(np.searchsorted(self.cdf, self.rng.random(NOISE) * self.cdf[-1]), len(self.cdf) - 1)
        first, second = m.halves()
        q, rn = first[a] + second[b], m.r[noise]
        ru = m.r[u]
        g_real = 1 - sigmoid(np.einsum("ij,ij->i", q, ru) + m.b[u] - self.log_noise[u])  # upwards
        g_false = sigmoid(q @ rn.T + (m.b[noise] - self.log_noise[noise]))
        ru *= g_real[:, None]
        g_q = ru
        g_q -= g_false @ rn
        g1, g2 = by_sum(a, g_q, len(m.e)), by_sum(b, g_q, len(m.e))
        # Only the lines of units that the batch or its noise holds are touched.
        of_units = np.empty((n + NOISE, WIDTH + 1), np.float32)
        np.multiply(q, g_real[:, None], out=of_units[:n, :-1])
        of_units[:n, -1] = g_real
        np.negative(g_false.T @ q, out=of_units[n:, :-1])
        of_units[n:, -1] = -g_false.sum(axis=0)
        held = np.concatenate([u, noise])
        order = np.argsort(held.astype(np.uint16), kind="stable")
        found = held[order]
        starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        g_u, touched = np.add.reduceat(of_units[order], starts, axis=0), found[starts]
        everything = slice(None)
        grads = [(m.e, self.past.e, g1 @ m.d1.T + g2 @ m.d2.T, everything), (m.d1, self.past.d1, m.e.T @ g1, everything), (m.d2, self.past.d2, m.e.T @ g2, everything), (m.r, self.past.r, g_u[:, :-1], touched), (m.b, self.past.b, g_u[:, -1], touched)]
        for p, h, g, rows in grads:
            g /= n
            past = h[rows] + g * g
            h[rows] = past
            g *= RATE
            g /= np.sqrt(past, out=past)
            p[rows] += g

    def text(self, units: bytes) -> None:
        u = np.frombuffer(units, "<u2").astype(np.int64)
        self.held.append((*contexts_of(u, self.context), u))
        self.size += len(u)
        if self.size >= BATCH:
            self.flush()

    def flush(self) -> None:
        if not self.size:
            return
        a, b, u = (np.concatenate(x) for x in zip(*self.held, strict=True))
        for at in range(0, len(u), BATCH):
            self.step(a[at : at + BATCH], b[at : at + BATCH], u[at : at + BATCH])
        self.units += np.bincount(u, minlength=len(self.units))
        self.contexts += np.bincount(a, minlength=len(self.contexts)) + np.bincount(b, minlength=len(self.contexts))
        self.held, self.size = [], 0


def contexts_of(u: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the token before each, and of the one before that; context ends with the code of the begin."""
    code = np.empty(len(u) + 2, np.int64)
    code[:2] = context[-1]
    code[2:] = context[u]
    return code[1:-1], code[:-2]


def _trained(shared, turn: int):
    """A trainer's texts, in order, to its lines of parameters and past gradients with their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = None
        for batch in batches:
            for k, units in zip(batch.column("trainer").to_pylist(), batch.column("units").to_pylist(), strict=True):
                if trainer is None:
                    start, past, frequency, context = shared.value
                    copy = lambda m: Model(*(p.copy() for p in m.parts()))
                    trainer = Trainer(copy(start), copy(past), frequency, context, SEED + k * ROUNDS + turn + 1)
                trainer.text(units)
        if trainer is None:
            return
        trainer.flush()
        lines = np.hstack([trainer.m.lines(), trainer.past.lines()]).astype("<f4")
        weight = np.concatenate([trainer.contexts, np.full(2 * WIDTH, trainer.units.sum()), trainer.units]) + UNSEEN
        at = range(0, len(lines), LINES)
        yield pa.RecordBatch.from_arrays(
            [pa.array([i // LINES for i in at], pa.int32()), pa.array([weight[i : i + LINES].tobytes() for i in at], pa.binary()), pa.array([lines[i : i + LINES].tobytes() for i in at], pa.binary())],
            names=["block", "weight", "lines"],
        )

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block after another to its average lines; one block is held at a time."""
    now, total, sums = None, None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([(sums / total[:, None]).astype("<f4").tobytes()], pa.binary())], names=["block", "lines"])

    for batch in batches:
        for block, weight, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            w = np.frombuffer(weight)
            x = np.frombuffer(lines, "<f4").reshape(len(w), -1) * w[:, None]
            if block != now:
                if now is not None:
                    yield row()
                now, total, sums = block, np.zeros(len(w)), np.zeros(x.shape)
            total, sums = total + w, sums + x
    if now is not None:
        yield row()


def train(parts: DataFrame, words: Lexicon) -> Model:
    """The model of all texts of parts (see coded) that are not held out."""
    frequency, context = words.frequency(), words.contexts()
    n_contexts = int(context[-1]) + 1
    model = Model.start(frequency, n_contexts)
    past = Model.filled(model, 1e-8)
    texts = parts.where("not held_out").withColumn("key", F.xxhash64("doc_id", "units"))
    n = max(1, round((words.train_tokens / TRAINER_TOKENS) ** (2 / 3)))
    # First by a threshold of the hash, so that tasks do not each send as many as are wanted of all; copies are one text.
    n_texts = texts.count()
    drawn = texts.where((F.col("n_tokens") <= WARM_TOKENS) & (F.pmod("key", F.lit(1 << 40)) < int(min(1.0, 2 * WARM_TEXTS / max(n_texts, 1)) * (1 << 40))))
    warm = drawn.groupBy("key").agg(F.first("units").alias("units")).orderBy("key").select("units").limit(WARM_TEXTS).collect()
    if not warm and not words.train_tokens:
        return model
    trainer = Trainer(model, past, frequency, context, SEED)
    for r in warm:
        trainer.text(r.units)
    trainer.flush()
    # Copies under one id have one key: where these are many, they are dealt by their row.
    copies = texts.groupBy("key").agg(F.count("*").alias("n")).where((F.col("n") > 1000) & (F.col("n") * 8 * n * ROUNDS > n_texts))
    copies = stored(copies.select(F.col("key").alias("_key")), "lm-copies")
    if copies.limit(1).count():
        texts = texts.join(few(copies), F.col("key") == F.col("_key"), "left").withColumn("key", F.when(F.col("_key").isNull(), F.col("key")).otherwise(F.xxhash64("row")))
    dealt = texts.select("key", F.pmod("key", F.lit(n)).cast("int").alias("trainer"), F.pmod(F.shiftright("key", 20), F.lit(ROUNDS)).alias("turn"), "units")
    for turn in range(ROUNDS):
        shared = parts.sparkSession.sparkContext.broadcast((model, past, frequency, context))
        ordered = dealt.where(F.col("turn") == turn).repartitionById(n, F.col("trainer")).sortWithinPartitions("trainer", "key")
        lines = ordered.select("trainer", "units").mapInArrow(_trained(shared, turn), "block int, weight binary, lines binary")
        rows = lines.repartition("block").sortWithinPartitions("block").mapInArrow(_averaged, "block int, lines binary").collect()  # the model's lines
        shared.unpersist()
        if rows:
            found = np.concatenate([np.frombuffer(r.lines, "<f4") for r in sorted(rows, key=lambda r: r.block)]).reshape(-1, 2 * (WIDTH + 1))
            model, past = (Model.of_lines(x, n_contexts) for x in np.hsplit(found, 2))
    return model


def all_normalisers(spark, model: Model) -> np.ndarray:
    """Model.normalisers, a task for each block of contexts."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.column("a").to_pylist():
                z = shared.value.normalisers(slice(a, a + CONTEXT_BLOCK))
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([z.tobytes()], pa.binary())], names=["a", "z"])

    n = len(model.e)
    blocks = spark.range(0, n, CONTEXT_BLOCK, -(-n // CONTEXT_BLOCK)).withColumnRenamed("id", "a")
    found = sorted(blocks.mapInArrow(run, "a long, z binary").collect(), key=lambda r: r.a)  # MOST_CONTEXTS squared at most
    shared.unpersist()
    return np.concatenate([np.frombuffer(r.z, np.float32) for r in found]).reshape(n, n)


# ---------------------------------------------------------------- scores


def _scored(shared):
    """Coded texts to their scores, many texts in one product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, log_z, context = shared.value
        first, second = model.halves()

        def scores(texts: list[np.ndarray]) -> np.ndarray:
            a, b = (np.concatenate(x) for x in zip(*(contexts_of(u, context) for u in texts), strict=True))
            u = np.concatenate(texts)
            p = np.einsum("ij,ij->i", first[a] + second[b], model.r[u]) + model.b[u] - log_z[a, b]
            return np.add.reduceat(p.astype(np.float64), np.cumsum([0, *map(len, texts[:-1])])) / math.log(10)

        for batch in batches:
            found, held, size = [], [], 0
            for units in batch.column("units"):
                u = np.frombuffer(units.as_buffer(), "<u2").astype(np.int64)
                held.append(u)
                size += len(u)
                if size >= SCORED:
                    found.append(scores(held))
                    held, size = [], 0
            if held:
                found.append(scores(held))
            if found:
                rest = [n for n in batch.schema.names if n != "units"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(np.concatenate(found))], names=[*rest, "model"])

    return run


def score(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    held = held_out(F.col("doc_id")) if held is None else held
    docs = docs.select("doc_id", "text", held.alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    with scratch() as s:
        counts = stored(token_counts(docs), "lm-counts")
        words = lexicon(counts)
        parts = stored(coded(docs, words), "lm-parts")
        model = train(parts, words)
        shared = docs.sparkSession.sparkContext.broadcast((model, all_normalisers(docs.sparkSession, model), words.contexts()))
        scored = parts.drop("tokens", "times").mapInArrow(_scored(shared), f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, fixed double, model double")
        pairs = parts.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("p")).select("row", F.col("p.tokens").alias("token"), F.col("p.times").alias("n"))
        rare = counts.where((F.col("c") > 0) & (F.col("c_all") * HEAD < F.lit(words.all_tokens))).select("token", "c")
        sums = pairs.join(rare, "token").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("rest"))
        rest = F.coalesce("rest", F.lit(0.0))
        found = scored.join(sums, "row", "left").select(
            "doc_id", "held_out", "n_tokens",
            (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
            F.lit(words.train_tokens).cast("long").alias("train_tokens"),
            (F.col("base") + rest).alias("base_score"),
            (F.col("model") + F.col("fixed") + rest).alias("score"),
        )
        return s.keep(stored(found, "lm-scores"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents, by a model of those with crc32(doc_id) mod 7 not 2."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
