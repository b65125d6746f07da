import pytest

from tidemark.llm import mixing


def filled(sizes, share=1.5, epochs=2.0):
    """Water-filling by rounds: (source, size) in order to targets."""
    weight = {s: (3, 1, 2)[i % 3] for i, (s, _) in enumerate(sizes)}
    cap = {s: epochs * n for s, n in sizes}
    left, free, out = share * sum(n for _, n in sizes), {s for s, _ in sizes}, {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= cap[s]}
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        for s in over:
            out[s], left = cap[s], left - cap[s]
        free -= over
    return out


@pytest.mark.parametrize("sizes", [[("a", 10)], [("a", 1000), ("b", 10), ("c", 500)], [("a", 5), ("b", 9000), ("c", 70), ("d", 3), ("e", 0), (None, 800)], [("a", 0), ("b", 0)], [("a", 100), ("b", 100), ("c", 100)]])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    want = filled(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix(spark):
    rows = [(i, "w " * (i * 13 % 97), f"s{i * i % 7}") for i in range(900)] + [(None, None, None), (5, "", None), (7000, "v " * 60000, "s1"), (9, "x y", None), (9, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS target", "2 AS _s", "3 AS place")
    m = mixing.mix(docs).collect()
    assert len(m) == len(rows)
    again = {(r.doc_id, r.size, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert {(r.doc_id, r.size, r.taken) for r in m} == again
    for s in {r.source for r in m}:
        own = [r for r in m if r.source == s]
        assert own[0].source_size == sum(r.size for r in own) and all(r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and out.count() == sum(r.repetitions for r in m)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_rows(docs.limit(0)).count() == 0
