import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lm


def tokens(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), "\n"]


def by_hand(rows):
    train = Counter(t for d, x in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for t in tokens(x))
    n, v = sum(train.values()), len(train)
    out = []
    for d, x in rows:
        t = tokens(x)
        out.append((d, zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2, len(t), sum(train[w] > 0 for w in t), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t), 6)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return [(r.doc_id, r.text) for r in docs.collect()], lm.score(docs).collect()


def test_counts_and_base(scored):
    rows, got = scored
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == by_hand(rows)


def test_model_beats_base_on_held_out_texts(scored):
    out = [r for r in scored[1] if r.held_out]
    base, model, n = (sum(x) for x in zip(*((r.base_score, r.score, r.n_tokens) for r in out)))
    assert model > base + 0.1 * n


def test_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{x}e{x % 7}" for x in rng.integers(0, 300, 40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", lm.held_out(lm.F.col("doc_id")).alias("held_out"))
    counts = lm.token_counts(docs)
    words = lm.lexicon(counts)
    model = lm.train(lm.coded(docs, words), words)
    log_z = model.normalisers()
    first, second = model.halves()
    begin = words.contexts()[-1]
    assert log_z.shape == (begin + 1, begin + 1)
    for a, b in ((3, 5), (begin, begin), (200, 17)):
        p = np.exp((first[a] + second[b]) @ model.r.T + model.b - log_z[a, b])
        assert abs(p.sum() - 1) < 1e-4
    known = {r.token: r.c for r in counts.collect() if r.c > 0}
    vocabulary = {t.decode() for t in words.tokens[: words.n_units]}
    per_class = np.zeros(lm.CLASSES)
    for t, c in known.items():
        if t not in vocabulary:
            k = lm.tail_class(t.encode())
            per_class[k] += (c + 1) / (words.class_sum[k] + words.class_types[k] + 1)
    assert np.allclose(per_class + 1 / (words.class_sum + words.class_types + 1), 1)


def test_partitions_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(lm, "TRAINER_TOKENS", 1 << 12)
    monkeypatch.setattr(lm, "CONTEXT_COUNT", 50)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.limit(3))
    a, b = ({(r.doc_id, r.n_tokens): r.score for r in lm.score(docs.repartition(n)).collect()} for n in (2, 13))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= 1e-4 * abs(a[k]) + 1e-6 for k in a)


def test_scores_by_hand(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}e{x % 5}" for x in rng.integers(0, 200, rng.integers(0, 60)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", lm.held_out(lm.F.col("doc_id")).alias("held_out"))
    words = lm.lexicon(lm.token_counts(docs))
    model = lm.train(lm.coded(docs, words), words)
    got = {r.doc_id: r.score for r in lm.score(docs.drop("held_out")).collect()}
    train = Counter(t for d, x in rows if zlib.crc32(str(d).encode()) % 7 != 2 for t in tokens(x))
    unit = {t.decode(): i for i, t in enumerate(words.tokens[: words.n_units])}
    context = words.contexts()
    for d, x in rows:
        codes, total = [context[-1]] * 2, 0.0
        for t in tokens(x):
            k = lm.tail_class(t.encode())
            u = unit.get(t, words.n_units + k)
            logits = (model.e[codes[-1]] @ model.d1 + model.e[codes[-2]] @ model.d2) @ model.r.T + model.b
            total += (logits[u] - np.log(np.exp(logits.astype(float)).sum())) / math.log(10)
            if u >= words.n_units:
                total += math.log10((train[t] + 1) / (words.class_sum[k] + words.class_types[k] + 1))
            codes.append(context[u])
        assert abs(got[d] - total) < 1e-3 * (1 + abs(total))


def test_odd_tables(spark):
    rows = [(1, None), (2, ""), (None, "a B c"), (4, "x " * 60000), (4, "x " * 60000), (9, "\x1c\x85 é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "true AS held_out", "1 AS row", "2 AS model")
    got = lm.score(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == by_hand(rows)
    assert all(r.score <= 0 for r in got)
    assert lm.score(docs.limit(0)).count() == 0
    out = lm.score(docs, lm.F.lit(True)).collect()
    assert {r.train_tokens for r in out} == {0} and len(out) == 6
