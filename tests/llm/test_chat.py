import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat

PIECES = st.lists(st.sampled_from(["\\", "<turn:", "</turn>", "\n", ">", "<", "a", "é", "turn", "assistant", "\\<"])).map("".join)


def by_hand_segment(role, text):
    esc = lambda s: s.replace("\\", "\\\\").replace("<turn:", "\\<turn:").replace("</turn>", "\\</turn>")
    return "<turn:" + esc(role).replace(">", "\\>") + ">\n" + esc(text) + "</turn>\n"


@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_template_is_reversible(turns):
    assert chat.parsed("".join(by_hand_segment(r, t) for r, t in turns)) == turns


TALKS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi </turn>"), (1, 2, "assistant", "\\</turn> ok"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 0, "user", "no reply"), (3, 0, "assistant", "first"), (None, 1, None, "x"), (None, None, "assistant", "y"), (4, 0, "user", "a"), (4, 0, "user", "a"), (4, 0, "assistant", "b"),
    (5, 0, "user", "long " * 40000), (5, 1, "assistant", "reply " * 40000),
]


def in_order(conv):
    turns = [t for t in TALKS if t[0] == conv]
    return [(r or "", x or "") for _, _, r, x in sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))]


def test_examples_and_reading_back(spark):
    talks = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS position", "2 AS start", "3 AS target").repartition(4)
    want = []
    for conv in {t[0] for t in TALKS}:
        turns = in_order(conv)
        for i, (role, text) in enumerate(turns):
            if role == "assistant":
                whole = "".join(by_hand_segment(*t) for t in turns[: i + 1])
                want.append((conv, sum(r == "assistant" for r, _ in turns[:i]), i + 1, i + 1 == len(turns), whole, text))
            elif i + 1 == len(turns):
                want.append((conv, None, i + 1, True, "".join(by_hand_segment(*t) for t in turns), None))
    for block in (1, 2, 64):
        written = chat.expand(talks, block)
        got = [(r.conv_id, r.example, r.n_turns, r.whole, r.text, None if r.loss_start is None else chat.unescaped(r.text[r.loss_start : r.loss_end])) for r in written.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    for r in chat.read_back(written).collect():
        turns = in_order(r.conv_id)
        replies = "".join(x for role, x in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(replies))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(replies.encode()).hexdigest()
        assert r.formatted_chars == sum(len(by_hand_segment(*t)) for t in turns)
        texts = [w[4] for w in sorted(want, key=str) if w[0] == r.conv_id and w[1] is not None]
        assert (r.n_examples, r.example_chars) == (len(texts), sum(map(len, texts)))
    assert chat.read_back(chat.expand(talks.limit(0))).count() == 0 and chat.expand(talks.limit(0)).count() == 0


def test_a_long_conversation_and_none_with_an_id(spark):
    """3,000 turns over many spans and blocks; and all rows without an id, which are one conversation."""
    turns = [("assistant" if i % 3 == 2 else "user", f"t{i} <turn: é") for i in range(3000)]
    rows = [(5, i, r, x) for i, (r, x) in enumerate(turns)] + [(5, None, "system", "first")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS span", "2 AS _k", "3 AS _n").repartition(7)
    order = [("system", "first"), *turns]
    replies = "".join(x for r, x in order if r == "assistant")
    for df in (talks, talks.withColumn("conv_id", F.lit(None).cast("long"))):
        for span in (50, chat.SPAN):
            p = chat.placed(df, span)
            got = {r.position: (r.nth, r.n_all, r.segment) for r in p.collect()}
            assert got == {i: (sum(r == "assistant" for r, _ in order[:i]), 3001, by_hand_segment(*t)) for i, t in enumerate(order)}
        (one,) = chat.read_back(chat.expand(df)).collect()
        assert (one.n_turns, one.n_examples, one.loss_chars) == (3001, 1000, len(replies))
        assert one.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in order).encode()).hexdigest()
        assert one.loss_sha256 == hashlib.sha256(replies.encode()).hexdigest()
