import random
import re
from itertools import permutations

import pyarrow as pa
import pytest

from tidemark.llm import interaction as m


def failed(doc_id, text, docs):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    out = set()
    if len(w) < 50:
        out.add("A")
    if 100 * len(set(w)) < 65 * len(w):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
        out.add("C")
    if re.search(r"[#$%&*|]", t):
        out.add("D")
    if doc_id is not None and any(x is not None and x < doc_id and (u or "") == t for x, _, u in docs):
        out.add("E")
    return out


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    parts = {}
    for d, s, t in docs:
        parts.setdefault(s or "", []).append((d, failed(d, t, docs)))
    rows = []
    for part, members in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = members, []
            for k, f in enumerate(order):
                out = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                rows.append([part, "".join(order), k + 1, len(left), len(out), sum(f in x[1] for x in gone), sum(x[1] == {f} for x in members), sum(x[0] in good for x in out), sum(x[0] in toxic for x in out)])
                gone = gone + out
                total[f] += len(out)
        for r in rows:
            if r[0] == part:
                r.append(total[r[1][r[2] - 1]])
    return sorted(tuple(r) for r in rows)


def made(n, seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(("Abc", "def", "ghi#", "x%d" % rng.randrange(200), "y%d" % rng.randrange(900)))
    pool = [" ".join(word() for _ in range(rng.choice((3, 49, 50, 70)))) for _ in range(12)] + [None, "", " \n", "é" * 60, "W " * 3000, " ".join(f"u{i}" for i in range(60))]
    hot = pool[5]
    ids = [None, None, None] + list(range(n))
    docs = [(rng.choice(ids), rng.choice(("s1", "s1", "s1", "s2", None, "")), hot if rng.random() < 0.4 else rng.choice(pool)) for _ in range(n)]
    labels = [(rng.choice(ids), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(n)]
    return docs, labels


@pytest.mark.parametrize("ranges", [1, 13])
def test_equals_brute_force_over_few_and_many_ranges(spark, ranges):
    docs, labels = made(160)
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 AS mask", "2 AS part", "3 AS fp", "4 AS least", "5 AS good")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS part")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        masks = sorted(((r.doc_id, r.part, r["mask"]) for r in m.failure_masks(d.repartition(5)).collect()), key=str)
        assert masks == sorted(((i, s or "", sum(1 << "ABCDE".index(f) for f in failed(i, t, docs))) for i, s, t in docs), key=str)
        got = sorted(tuple(r) for r in m.audit(d, y).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == brute(docs, labels)


def test_texts_of_one_fingerprint_are_told_apart():
    """Two texts under one fingerprint, over batches; an earlier range's rows decide by way of the ends."""
    kind = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("text", pa.string()), ("fp", pa.int64())])
    rows = [(3, "p", "a", 7), (5, "p", "a", 7), (1, "p", "b", 7), (1, "p", "b", 7), (2, "p", "b", 7), (4, "p", "b", 9), (None, "p", "c", 9), (6, "p", "c", 9), (8, "p", "c", 9)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows[i : i + 2]], kind) for i in range(0, len(rows), 2)]
    out = [r for b in m._in_order(iter(batches)) for r in b.to_pylist()]
    docs, ends = [r for r in out if r["mask"] is not None], [r for r in out if r["mask"] is None]
    assert [bool(r["mask"] & m.DUPLICATE) for r in docs] == [False, True, False, False, True, False, False, False, True]
    assert [r["fp"] for r in docs] == [7] * 5 + [None] * 4
    assert sorted((r["fp"], r["least"]) for r in ends) == [(9, 4), (9, 6)]
    assert list(m._in_order(iter([]))) == []


def test_empty_tables_and_other_id_types(spark):
    docs = spark.createDataFrame([("b", "s", "t"), ("a", "s", "t")], "doc_id string, source string, text string")
    labels = spark.createDataFrame([], "doc_id string, quality int, toxic int")
    assert m.audit(docs.limit(0), labels).count() == 0
    got = {r.doc_id: r["mask"] for r in m.failure_masks(docs).collect()}
    assert got == {"a": 1, "b": 1 | m.DUPLICATE}
    assert m.audit(docs, labels).count() == 600
