"""Memories admitted in order of arrival, against the rule applied one by one."""

import numpy as np
import pytest

from tidemark.operators import retrieval


def one_by_one(rows, least=0.85):
    out, kept = {}, {}
    for k, (i, owner, at, e) in sorted(enumerate(rows), key=lambda x: (x[1][2], x[1][0])):
        if e is None or any(x is None for x in e) or not any(e):
            out[k] = (i, owner, True, None, None)
            continue
        u = np.array(e) / np.linalg.norm(e)
        near = [(-round(float(u @ v), 6), t, j) for t, j, v in kept.setdefault(owner, []) if (t, j) < (at, i) and float(u @ v) >= least]
        if near:
            best = min(near)
            out[k] = (i, owner, False, best[2], -best[0])
        else:
            out[k] = (i, owner, True, None, None)
            kept[owner].append((at, i, u))
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("piece", [retrieval.MET, 40])
def test_admission_equals_the_rule(spark, piece):
    """A hot owner with a group of near copies and a chain, exact copies, ties in time, vectors that say nothing, and no owner at all."""
    rng = np.random.default_rng(piece)
    centre = rng.normal(size=8)
    vectors = [centre + rng.normal(size=8) * 0.1 for _ in range(150)] + [rng.normal(size=8) for _ in range(60)]
    turn = lambda a: [np.cos(a), np.sin(a)] + [0.0] * 6
    vectors += [np.array(turn(0.3 * k)) for k in range(20)] + [vectors[0]] * 10 + [vectors[170]] * 3
    owners = ["hot"] * 6 + ["b", None]
    rows = [(i, owners[rng.integers(len(owners))], int(rng.integers(150)), [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000, "hot", 0, None), (1001, "hot", 0, [0.0] * 8), (1002, "b", 5, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, owner string, at long, embedding array<double>").selectExpr("*", "1 AS e", "2 AS _r", "3 AS cell").repartition(3)
    got = sorted((tuple(r) for r in retrieval.admitted(df, piece=piece).collect()), key=str)
    assert got == one_by_one(rows)
    assert sum(not r[2] for r in got) > 150
    assert retrieval.admitted(df.limit(0)).count() == 0


def test_no_neighbour_is_missed_by_the_bound(spark):
    """Every pair at the least cosine or above meets in a cell, in any number of cells."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 6))
    rows = [(i, "o", i, v[i].tolist()) for i in range(len(v))]
    m = spark.createDataFrame([(i, o, at, i, e) for i, o, at, e in rows], "_r long, owner string, at long, vec_id long, e array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = np.tril(u @ u.T >= 0.85, -1).any(axis=1)
    for n in (1, 7, 30):
        found = retrieval.best_earlier(m, m, u[:n], 0.85, 50)
        assert {r._r for r in found.collect()} == set(np.flatnonzero(near).tolist())
        cells = m.mapInArrow(retrieval._visited(u[:n], 0.85), f"{retrieval.SEEN}, cell int").count()
        assert n == 1 or cells < n * len(v)
