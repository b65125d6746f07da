import hashlib

import numpy as np

from tidemark.llm import fingerprint as fp
from tidemark.llm.simhash import shingle_digests
from tidemark.llm.text import py_lower_words


def shingles(text):
    d = shingle_digests(py_lower_words(text), 5)
    return {d[i : i + 8] for i in range(0, len(d), 8)}


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


def test_strings_round_trip():
    for t in (None, "", "one", "a b c d e f", prose(1, 5000)):
        s = fp.sketch(t)
        n, kept = fp.from_string(fp.to_string(s))
        assert n == s[0] and (kept == s[1]).all()


def test_short_texts_are_compared_exactly():
    a, b = prose(2, 30), prose(2, 20) + " and other words follow here now"
    x, y = shingles(a), shingles(b)
    assert fp.containment(fp.sketch(a), fp.sketch(b)) == len(x & y) / len(x)
    assert fp.likeness(fp.sketch(a), fp.sketch(b)) == len(x & y) / min(len(x), len(y))
    assert fp.likeness(fp.sketch(""), fp.sketch(None)) == 1 and fp.likeness(fp.sketch("a"), fp.sketch("")) == 0


def test_containment_of_very_unequal_texts():
    part = prose(3, 2000)
    whole = prose(4, 15000) + " " + part + " " + prose(5, 15000)
    assert fp.containment(fp.sketch(part), fp.sketch(whole)) > 0.97
    assert abs(fp.containment(fp.sketch(whole), fp.sketch(part)) - 2000 / 32000) < 0.02


def test_merged_is_the_sketch_of_both():
    a, b = prose(6, 4000), prose(7, 3000)
    m = fp.merged(fp.sketch(a), fp.sketch(b))
    union = shingles(a) | shingles(b)
    h = np.unique(np.array([int.from_bytes(x, "big") >> 16 for x in union], np.uint64))
    assert (m[1] == h[h < fp.THRESHOLD]).all()
    assert abs(m[0] / len(union) - 1) < 0.15


def plain_sketch(text):
    """The sketch from its definition: distinct 48-bit hashes of 5-word shingles, those below the threshold, but 32 at least."""
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w)] if 0 < len(w) <= 5 else [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
    h = sorted({xxhash.xxh64_intdigest(x.encode(), 42) >> 16 for x in s})
    below = [x for x in h if x < (1 << 48) // 16]
    return len(h), below if len(below) >= 32 else h[:32]


def test_sketch_matches_definition():
    for t in (None, "", "One", "a b C d e", "a b c d e f a b c d e f", prose(8, 400), prose(9, 9000), "É x\x0by Z " * 300):
        n, kept = fp.sketch(t)
        assert (n, kept.tolist()) == plain_sketch(t)


def plain_likeness(a, b):
    (n, x), (m, y) = plain_sketch(a), plain_sketch(b)
    if not n or not m:
        return float(n == m)
    upto = min(1 << 48 if len(k) == c else max((1 << 48) // 16, k[-1] + 1) for c, k in ((n, x), (m, y)))
    x, y = {v for v in x if v < upto}, {v for v in y if v < upto}
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


def by_hand(rows):
    import xxhash

    def place(row):
        h = 42 if row[1] is None else xxhash.xxh64_intdigest(row[1], 42)
        return (row[0] is not None, row[0], h - (1 << 64) if h >> 63 else h)

    order = sorted(rows, key=place, reverse=True)
    out = []
    for i, (doc, text) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1] or ""
        text = text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        s, e = fp.sketch(text), fp.sketch(edited)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.to_string(s), fp.to_string(e), plain_likeness(text, edited), plain_likeness(text, nxt)))
    return sorted(out, key=str)


def test_neighbours(spark):
    rows = [(i * 3 % 101, prose(i, i % 60) + "é" * (i % 5)) for i in range(101)] + [(500, None), (-4, ""), (None, "x y z"), (7, "twice"), (7, "twice")]
    nameless = [(None if i % 2 else i, prose(i, 40)) for i in range(120)] + [(None, "the same")] * 90 + [(3, "again " * 9)] * 25
    for some in (rows, rows[:1], rows[:2], [(None, "a"), (None, "b c")], [(1, "q r"), (None, None)], nameless, nameless[-25:]):
        docs = spark.createDataFrame(some, "doc_id long, text string").selectExpr("*", "1 AS bucket", "2 AS head", "3 AS h").repartition(5)
        for partition_bytes in (fp.PARTITION_BYTES, 500):
            got = sorted((tuple(r) for r in fp.beside_next(docs, partition_bytes).collect()), key=str)
            assert got == by_hand(some)
    named = [(None if d is None else f"id-{d}é", t) for d, t in nameless]
    got = fp.beside_next(spark.createDataFrame(named, "doc_id string, text string").repartition(3), 2000)
    assert got.schema["doc_id"].dataType.simpleString() == "string"
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(named)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fp.beside_next(empty).count() == 0 and fp.fingerprints(empty).count() == 0
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.fingerprint for r in fp.fingerprints(docs).where("doc_id = 7").collect()} >= {fp.to_string(fp.sketch("twice"))}
