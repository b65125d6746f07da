import re
from collections import Counter

from tidemark.llm import rules


def by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {p for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


TEXTS = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "x x x x", "é É\x0bq\x1cr ß #|*\nx\nx\n \n\nx", "one two three\n" * 30, "w " * 30000, "the quick brown fox " + " ".join(f"w{i}" for i in range(80))]


def test_measures_and_ledger(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b c a b c"), (3, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS w", "2 AS failed", "3 AS n_words", "4 AS s")
    entries = rules.ledger(docs)
    lines = {r.doc_id: (r.n_bullets, r.n_ellipses) for r in rules.ledger(spark.createDataFrame([(1, " - a\n* b\n\u2022c\nd ... \ne\u2026\n-"), (2, None)], "doc_id long, text string")).collect()}
    assert lines == {1: (4, 2), 2: (0, 0)}
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in entries.collect()), key=str)
    assert got == sorted(((d, *by_hand(t)) for d, t in rows), key=str)
    kept = {r.doc_id: r.kept for r in rules.apply_policy(entries).collect()}
    assert kept[11] and not any(v for k, v in kept.items() if k != 11)
    assert rules.ledger(docs.limit(0)).count() == 0


def test_ablation(spark):
    entries = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 3), (5, 4), (6, 64 + 4)], "doc_id long, failed long")
    got = {r.rule: (r.n_failed, r.n_sole, r.rejected, r.n_docs) for r in rules.ablation(entries, "v1").collect()}
    assert got == {"few_words": (3, 2, 3, 6), "repeated_words": (1, 0, 3, 6)}
    got = {r.rule: (r.n_failed, r.n_sole) for r in rules.ablation(entries, "v2").collect()}
    assert got["symbols"] == (2, 1) and got["word_length"] == (1, 0) and got["shouting"] == (0, 0) and "bullets" not in got
    assert len(rules.ablation(entries).collect()) == len(rules.RULES)
    assert {r.n_failed for r in rules.ablation(entries.limit(0)).collect()} == {0}


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (rules.ledger(docs), rules.query(spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
