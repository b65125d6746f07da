import numpy as np
import pytest
import xxhash
from test_pipeline import by_hand_lines

from tidemark.llm import linededup as ld


@pytest.mark.parametrize("bits", [ld.MAX_BITS, 64])
def test_lines(spark, bits):
    shared = [f"a passage number {i} that several documents hold" for i in range(40)]
    rows = [(d, "\n".join([f"own line of the document {d} and no other", *(shared[(d + j) % 40].upper() if d % 2 else "\t" + shared[(d + j) % 40] + " \r" for j in range(d % 6)), "short"])) for d in range(60)]
    rows += [(100, None), (101, ""), (None, shared[0]), (None, shared[1]), (7, shared[3]), (200, ("é" * 19 + "\n") * 3), (201, "é" * 19), (202, "é" * 19), (203, "é" * 20), (204, "É" * 20), (205, "é" * 20 + "\x0b"), (206, "é" * 20), (300, (shared[5] + "\n") * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS n_lines", "3 AS keeper", "4 AS _id").repartition(5)
    got = ld.dedup_lines(docs, max_bits=bits).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(by_hand_lines(rows), key=str)
    assert all(r.n_lines - r.n_dropped == (r.text.count("\n") + 1 if r.text or r.n_lines > r.n_dropped else 0) for r in got)
    assert ld.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("range_lines", [ld.RANGE_LINES, 100])
def test_filter_has_every_key_of_two_documents(spark, range_lines):
    rng = np.random.default_rng(0)
    keys = [f"a line that is long enough, number {x}" for x in rng.integers(0, 4000, 5000)]
    docs = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "doc_id long, text string").repartition(9)
    twice = ld.twice_filter(docs, range_lines=range_lines)
    assert len(twice.packed) == (1 if range_lines > 5000 else 64)

    def held(ks):
        return twice.holds(np.array([xxhash.xxh64_intdigest(k) for k in ks], np.uint64))

    again = [k.encode() for k in set(keys) if keys.count(k) > 1]
    once = [k.encode() for k in set(keys) if keys.count(k) == 1]
    assert held(again).all() and held(once).mean() < 0.1
    # The filter is sized by the repeated lines, not by all.
    more = docs.unionByName(spark.range(5000, 25000).selectExpr("id AS doc_id", "concat('a line found nowhere else: ', id) AS text"))
    assert ld.twice_filter(more, range_lines=1 << 20).packed.size <= ld.twice_filter(docs, range_lines=1 << 20).packed.size


def test_many_rows_without_an_id(spark):
    """Rows of one null id are one document; what each text loses is gathered by text."""
    rng = np.random.default_rng(2)
    shared = [f"a passage number {i} that many documents hold" for i in range(300)]
    rows = [(None, "\n".join(shared[k] for k in rng.choice(300, 5))) for _ in range(400)] + [(d, "\n".join(shared[d : d + 40])) for d in range(0, 260, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS h", "8 AS _h", "9 AS _oh").repartition(6)
    got = ld.dedup_lines(docs)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(by_hand_lines(rows), key=str)
    gone = ld.lost_lines(docs.select("doc_id", "text"), 20, 3, ld.MAX_BITS)
    assert gone.where("size(_gone) > 40").count() == 0 and gone.where("_id is null").count() > 300
    nulls = docs.where("doc_id is null")
    assert sorted(r.text for r in ld.dedup_lines(nulls).collect()) == sorted(t for d, t in rows if d is None)
