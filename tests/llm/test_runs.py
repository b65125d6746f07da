import hashlib
import random

import numpy as np

from tidemark.llm import runs


def brute(w, least=12):
    """Runs by the definition: every stretch, its least period, and that no neighbour keeps it."""
    n, found = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, b - a, p) for (a, b), p in found.items())


def as_rows(x):
    return [tuple(r) for r in x.tolist()]


def texts(rng, how_many):
    out = []
    for _ in range(how_many):
        alphabet = rng.choice((1, 2, 2, 3, 5, 30))
        w = [rng.randrange(alphabet) for _ in range(rng.randint(0, 90))]
        if rng.random() < 0.5 and w:
            at, p = rng.randrange(len(w)), rng.randint(1, 20)
            piece = w[at : at + p]
            w[at:at] = piece * rng.randint(1, 5)
        out.append([str(x).encode() for x in w])
    return out


def test_equals_the_definition_whatever_goes_together():
    rng = random.Random(11)
    batch = texts(rng, 300)
    want = [brute(t) for t in batch]
    for slice_of in (7, 1000, runs.SLICE):
        assert [as_rows(r) for r in runs.runs_of(batch, slice_of=slice_of)] == want
    assert [as_rows(runs.runs_of([t])[0]) for t in batch[:40]] == want[:40]
    assert [as_rows(r) for r in runs.runs_of(batch, least=2)] == [brute(t, 2) for t in batch]


def test_wrong_hashes_change_nothing(monkeypatch):
    batch = texts(random.Random(5), 60)
    want = [brute(t) for t in batch]
    real = runs.Prefixes.alike
    rng = np.random.default_rng(2)
    monkeypatch.setattr(runs.Prefixes, "alike", lambda self, i, p, size: real(self, i, p, size) | (rng.random(len(i)) < 0.3))
    assert [as_rows(r) for r in runs.runs_of(batch)] == want


def test_thue_morse_breaks_the_hash_and_not_the_result():
    w = [bin(i).count("1") % 2 for i in range(1 << 12)]
    w = np.array(w + [1 - x for x in w] + w)
    p = runs.Prefixes(w)
    assert p.alike(np.array([0]), np.array([1 << 12]), np.array([1 << 12]))[0]  # and they are not
    want = {}
    for q in range(1, len(w) // 2 + 1):
        for a, b, _ in runs._by_word(w, q, runs.LEAST):
            want.setdefault((a, b), q)
    assert as_rows(runs.runs_of([[b"%d" % x for x in w]])[0]) == sorted((a, b - a, q) for (a, b), q in want.items())


def test_collapsed_keeps_first_periods():
    w = "x a b a b a b a b a b a b y".split()
    (found,) = runs.runs_of([[x.encode() for x in w]])
    assert as_rows(found) == [(1, 12, 2)]
    assert runs.collapsed([x.encode() for x in w], found) == "x a b y"


def test_documents(spark):
    cycle = " ".join(f"w{i}" for i in range(700))
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b"), (4, "a " * 30000), (5, " ".join([cycle] * 5)), (None, "é ß " * 9 + "end"), (6, "one two three"), (6, "z " * 12), (6, "z " * 12), (7, "z " * 11), (8, "q\x1cr " * 12),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS collapsed", "3 AS h")
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(docs.repartition(3)).collect()), key=str)
    want = sorted(((d, brute((t or "").encode().split()), None) for d, t in rows if d != 4), key=str)
    assert [(d, r) for d, r, _ in got if d != 4] == [(d, r) for d, r, _ in want]
    by = {d: (r, c) for d, r, c in got}
    assert by[4] == ([(0, 30000, 1)], "a") and by[5] == ([(0, 3500, 700)], cycle) and by[1] == ([], "") and by[8] == ([(0, 12, 1)], "q\x1cr")
    assert by[None][1] == "é ß end"
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_on_its_own_table(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(None, "a " * 20), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    want = []
    for d, t in rows:
        w = (t or "").split()
        n = len(w)
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        r = brute(w)
        gone = {i for s, length, p in r for i in range(s + p, s + length)}
        best = min(r, key=lambda x: (-x[1], x[0], x[2])) if r else (None, None, None)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in r)
        want.append((d, len(r), *best, 1000 * best[1] // best[2] if r else None, digest(lines), digest(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = [tuple(r) for r in runs.query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows if d is not None) > 5
