import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality


def auc(score, y):
    order = np.argsort(score, kind="stable")
    s, y = np.asarray(score)[order], np.asarray(y)[order]
    rank = np.empty(len(s))
    values, start, count = np.unique(s, return_index=True, return_counts=True)
    for a, n in zip(start, count, strict=True):
        rank[a : a + n] = a + (n + 1) / 2
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    out = quality.query(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    assert auc([r.score for r in rows], [r.quality for r in rows]) > 0.99
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.98
    n, lo, hi = out.agg(F.count("*"), F.min("score"), F.max("score")).first()
    assert n == 10000 and 0 <= lo and hi <= 1


def test_isotonic_is_the_nearest_monotone_map():
    rng = np.random.default_rng(0)
    w, m = rng.uniform(0.5, 2, 60), np.linspace(0, 1, 60) + rng.normal(0, 0.3, 60)
    f = quality.isotonic(w, m)
    assert (np.diff(f) >= 0).all()
    cost = (w * (f - m) ** 2).sum()
    for _ in range(300):
        g = np.sort(f + rng.normal(0, 0.05, 60))
        assert (w * (g - m) ** 2).sum() >= cost - 1e-9


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, None), (3, ""), (None, "x"), (4, "w " * 50000), (1, "some words here")], "doc_id long, text string").selectExpr("*", "7 AS score", "8 AS y", "9 AS aside")
    m = quality.measured(docs)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(m, none)
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (3, 1), (None, 0), (4, None), (99, 0), (2, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.fit(m, one)).collect()} <= {1.0, 0.5}
    both = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(4, 1)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(m, both)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.limit(0), model).count() == 0


def test_fit_equals_one_dense_system(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{j}" for j in rng.integers(0, 60, rng.integers(1, 80))) + "!" * int(rng.integers(0, 9))) for i in range(300)]
    y = {i: int("w7 " in t or len(t) > 200) for i, t in rows}
    m = quality.measured(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    model = quality.fit(m, spark.createDataFrame(list(y.items()), "doc_id long, quality int"))
    known = m.where(~quality.held_out(F.col("doc_id"))).select("doc_id", "x", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("aside")).collect()
    x, aside = np.array([r.x for r in known]), np.array([r.aside for r in known])
    label = np.array([y[r.doc_id] for r in known], float)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-3))
    z = model.features(x[~aside])
    penalty = np.append(np.full(quality.FEATURES, 1e-4), 1e-9) * len(z)
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ label[~aside]), atol=1e-6)
    raw = model.raw(x[aside])
    at = np.floor(np.clip(raw, -0.5, 1.5) * (quality.BINS / 2))
    bins = np.unique(at)
    count = np.array([(at == b).sum() for b in bins], float)
    assert np.allclose(model.knots, [raw[at == b].mean() for b in bins])
    assert np.allclose(model.values, quality.isotonic(count, np.array([label[aside][at == b].mean() for b in bins])))
