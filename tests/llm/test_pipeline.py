import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_packing import check_places, pieces_by_hand

import corpus_pipeline as cp
from tidemark.llm import linededup, simhash

SF = "/root/testdata/sf0.001"


def by_hand_lines(rows):
    held = {}
    for doc, text in rows:
        for k in set(linededup.line_keys(text)):
            held.setdefault(k, set()).add(doc)
    out = []
    for doc, text in rows:
        kept = [x for x, k in zip((text or "").split("\n"), linededup.line_keys(text)) if not k or len(held[k]) < 3 or doc == max(held[k], key=lambda d: (d is not None, d))]
        out.append((doc, "\n".join(kept)))
    return out


def similar_roots(texts, k=5, similarity=0.8):
    """{text: root}: what pairs of texts with 0.8 of their shingles in common connect; texts of the same words are alike."""
    words = {t: b" ".join((t or "").encode().lower().split()) for t in texts}
    sets = {w: frozenset(simhash.shingle_hashes(w.decode(), k).tolist()) for w in words.values()}
    parent = {w: w for w in sets}

    def root(w):
        while parent[w] != w:
            w = parent[w]
        return w

    held = {}
    for w, s in sets.items():
        for x in sorted(s)[: len(s) // 5 + 1]:  # two texts at 0.8 share one of these
            held.setdefault(x, []).append(w)
    for group in held.values():
        for i, u in enumerate(group):
            for v in group[:i]:
                both = len(sets[u] & sets[v])
                if root(u) != root(v) and both >= similarity * (len(sets[u]) + len(sets[v]) - both):
                    parent[root(u)] = root(v)
    return {t: root(w) for t, w in words.items()}


def by_hand_near(rows):
    root = similar_roots({t for _, t in rows})
    least = {}
    for doc, text in rows:
        least[root[text]] = min(least.get(root[text], doc), doc)
    return [(d, t) for d, t in rows if least[root[t]] == d]


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, out, step = docs.columns, docs, {}
    for name, stage in cp.STAGES:
        out = stage(spark, out, sf)
        step[name] = out = cp.stored(out, f"test-{name}")
        if name != "pack":
            assert out.columns == columns
    table = lambda d: sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect())
    kept = table(step["quality"])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = {d for d, _ in kept}
    assert sum(d in ids for d, q in labels.items() if q) >= 0.95 * sum(labels.values())
    assert table(step["lines"]) == sorted(by_hand_lines(kept))
    assert table(step["near_dups"]) == sorted(by_hand_near(table(step["lines"])))
    mixed = table(step["mix"])
    assert set(mixed) <= set(table(step["near_dups"])) and max(map(mixed.count, mixed)) <= 2
    rows = step["pack"].collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == pieces_by_hand(mixed)
    check_places(rows)


def test_empty_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS score", "2 AS x", "3 AS n_lines", "4 AS fp", "5 AS size", "6 AS target", "7 AS bin", "8 AS component_id")
    for some in (docs, docs.limit(0), docs.selectExpr("doc_id", "CAST(NULL AS string) AS text", "lang", "CAST(NULL AS string) AS source", "n_chars", "score", "x", "n_lines", "fp", "size", "target", "bin", "component_id")):
        out = some
        for name, stage in cp.STAGES:
            out = cp.stored(stage(spark, out, SF), f"odd-{name}")
            if name != "pack":
                assert out.columns == docs.columns and {r.n_lines for r in out.select("n_lines").collect()} <= {3}


def test_repeated_and_null_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    again = docs.where("doc_id % 3 = 0")
    docs = docs.unionByName(again).unionByName(again.withColumn("text", F.concat(F.lit("some other words come first here. "), "text"))).unionByName(docs.where("doc_id % 7 = 0").withColumn("doc_id", F.lit(None).cast("long"))).repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    table = lambda d: sorted(((r.doc_id, r.text) for r in d.select("doc_id", "text").collect()), key=str)
    lines = cp.stored(cp.drop_lines(spark, docs, SF), "again-lines")
    assert table(lines) == sorted(by_hand_lines(rows), key=str)
    left = table(lines)
    root = similar_roots({t for _, t in left})
    kept = cp.stored(cp.drop_near_duplicates(spark, lines, SF), "again-near")
    found = table(kept)
    assert sorted(root[t] for _, t in found) == sorted(set(root.values()))
    for d, t in found:
        assert (d is None, d or 0) == min((e is None, e or 0) for e, u in left if root[u] == root[t])
    mixed = cp.stored(cp.mix_sources(spark, kept, SF), "again-mix")
    rows = cp.pack_sequences(spark, mixed, SF).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == pieces_by_hand(table(mixed))


def test_tokenizer_is_a_parameter():
    assert public_tokenizers.path("word_bpe_49k.json").endswith(".json")
