import math
import random

import pytest

from tidemark.llm import simhash as sh

M = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_components(values):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    vs = sorted(values)
    for i, a in enumerate(vs):
        for b in vs[:i]:
            if bin((a ^ b) & M).count("1") <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {v: root(v) for v in values}


def found_components(spark, values, crowd=sh.CROWD):
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    out = {v: v for v in values}
    out |= {r.node: r.root for r in sh.components(sh.links(nodes, crowd)).collect()}
    return out


def test_crowded_and_sparse_clusters(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(120):
        values.add(signed(rng.getrandbits(64)))
    for size, spread in ((90, 3), (40, 6), (12, 4), (3, 2), (2, 2)):
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for _ in range(rng.randint(0, spread)):
                x ^= 1 << rng.randrange(64)
            values.add(signed(x))
    chain = rng.getrandbits(64)
    for i in range(0, 60, 2):
        chain ^= 3 << i
        values.add(signed(chain))
    want = brute_components(values)
    for crowd in (2, 16, sh.CROWD):
        assert found_components(spark, values, crowd) == want


def test_all_neighbours_of_one_value(spark):
    values = {0} | {signed(1 << i) for i in range(64)} | {signed((1 << i) | (1 << (i + 1) % 64)) for i in range(64)}
    assert found_components(spark, values) == brute_components(values)


def plain_simhash(text):
    import re

    import xxhash

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w)] if 0 < len(w) <= 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_matches_definition():
    for text in (None, "", " \n", "One", "One two", "one two three", "a b c d e f g a b c", "É x y Z\x0bq\x1cr " * 40, "w " * 70000):
        assert sh.simhash(text) & M == plain_simhash(text)


def test_documents_end_to_end(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from home " * 8
    rows = [(5, base), (2, base), (9, base.upper()), (7, None), (3, ""), (None, "something else entirely here now"), (4, "unrelated words go in this text " * 5), (4, "unrelated words go in this text " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS root", "3 AS component_id")
    got = sorted(((r.doc_id, r.component_id) for r in sh.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 2), (2, 2), (9, 2), (7, 3), (3, 3), (None, None), (4, 4), (4, 4)], key=str)
    kept = sorted((r.doc_id for r in sh.keep_one(docs).collect()), key=str)
    assert kept == sorted([2, 3, None, 4], key=str)
    assert sh.keep_one(docs).columns == docs.columns
    assert sh.near_duplicates(docs.limit(0)).count() == 0
    assert sh.keep_one(docs.limit(0)).count() == 0


def test_keep_one_under_null_and_repeated_ids(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (1, d), (8, e), (8, e), (9, a + " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _fp", "2 AS _kept")
    assert len({sh.simhash(t) for t in (a, b, c, d, e)}) == 5
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(9, a + " "), (None, b), (7, c), (1, d), (8, e)], key=str)
    nulls = sh.keep_one(docs.where("doc_id is null"))
    assert sorted(r.text for r in nulls.collect()) == [a, b]


def test_keep_one_loses_no_component_whatever_the_partitions(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.choice((1, 3, 40)))) for _ in range(25)] + ["", None]
    rows = [(rng.choice((None, None, 1, 2, 3, 4, 5)), rng.choice(texts)) for _ in range(120)]
    fp = {t: sh.simhash(t) for t in texts}
    root = brute_components(set(fp.values()))
    members = {}
    for doc, text in rows:
        members.setdefault(root[fp[text]], []).append((doc is None, doc or 0, fp[text], text))
    want = sorted((min(m)[:3] for m in members.values()))
    seen = set()
    for parts in (1, 2, 5, 11):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        kept = [(r.doc_id, r.text) for r in sh.keep_one(docs).collect()]
        assert sorted((d is None, d or 0, fp[t]) for d, t in kept) == want
        assert all((d, t) in rows for d, t in kept)
        seen.add(tuple(sorted(kept, key=str)))
    assert len(seen) == 1


def test_keep_similar_finds_edited_copies_and_leaves_others(spark):
    from test_pipeline import similar_roots

    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = " ".join(word() for _ in range(50))
    texts = []
    for n, copies in ((60, 2), (120, 3), (400, 150), (1500, 2), (90, 40)):
        base = [word() for _ in range(n)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 60))):
                w[rng.randrange(n)] = word()
            texts.append(" ".join(w))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(150)]
    texts += [" ".join(word() for _ in range(rng.randint(0, 90))) for _ in range(200)] + ["", None, " ", "One two", "one  TWO\n", "a b c d e", "a b c d f", "x " * 30000, "x " * 29000]
    rng.shuffle(texts)
    rows = [(rng.choice((None, i, i, i, i)), t) for i, t in enumerate(texts)] + [(3, texts[0]), (3, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS _h", "3 AS h", "4 AS minima", "5 AS u").repartition(6)
    kept = sh.keep_similar(docs)
    assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    root = similar_roots({t for _, t in rows})
    groups = {}
    for d, t in rows:
        groups.setdefault(root[t], []).append((d is None, d or 0))
    # What is dropped always has a kept one in its group, which is the first; of what is to go, hardly anything stays.
    assert {root[t] for _, t in found} == set(groups)
    assert all(min(m) in {(d is None, d or 0) for d, t in found if root[t] == r} for r, m in groups.items())
    assert len(found) - len(groups) <= 0.05 * (len(rows) - len(groups))
    assert sh.keep_similar(docs.limit(0)).count() == 0
    nulls = sh.keep_similar(docs.where("text is null or trim(text) = ''"))
    assert nulls.count() == 1


def test_keep_similar_leaves_out_no_pair_at_the_threshold(spark):
    from test_pipeline import similar_roots

    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(100000)}"
    hub = [word() for _ in range(200)]
    texts = [" ".join(hub)]
    # Each is alike to the hub alone (0.82 to 0.86), and to it by no key's least or greatest node; then pairs at 0.8 and just below.
    for _ in range(90):
        at = rng.sample(range(0, 200, 10), 4)
        texts.append(" ".join(word() if i in at else w for i, w in enumerate(hub)))
    for lost in (0, 1, 2, 3):
        for n in (5, 9, 14, 49, 94, 184):
            base = [word() for _ in range(n)]
            texts += [" ".join(base), " ".join(base[: n - lost])]
    chain = [word() for _ in range(120)]
    for _ in range(40):  # each is alike to the one before
        texts.append(" ".join(chain))
        chain[rng.randrange(5, 115)] = word()
    template = [word() for _ in range(70)]
    texts += [" ".join(template + [word() for _ in range(20)]) for _ in range(80)]
    root = similar_roots(set(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    first = {}
    for d, t in enumerate(texts):
        first.setdefault(root[t], d)
    assert sorted(r.doc_id for r in sh.keep_similar(docs).collect()) == sorted(first.values())
    assert len(first) < len(texts) - 100


@pytest.mark.parametrize("similarity", [0.8, 0.5, 0.9])
def test_first_shingles_meet(similarity):
    for n in range(1, 400):
        for m in range(n, 400):
            both = math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)
            if both <= n:  # the sizes allow it: what is not shared may all come first
                assert n - both < sh.first_of(n, similarity) and m - both < sh.first_of(m, similarity)
