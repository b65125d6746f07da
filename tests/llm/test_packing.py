import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
CODER = packing.WordEncoder(PATH)
LETTERS = st.sampled_from([*"abzEJTx'’sdlvm.,!?-*<|>#09 \n\t\x0b\x02\x85\xa0éÉßŸÿ÷×İıǰ̌́ΣςñªºµЖ中\U0001f600€Kͅ", "'s", "'re", "n't", "<|endoftext|>", "<|"])


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, max_size=14))
def test_words_give_the_ids_of_whole_texts(parts):
    text = "".join(parts)
    assert CODER.encode([text])[0] == np.array(CODER.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def pieces_by_hand(texts):
    out = []
    for doc, text in texts:
        ids = CODER.whole.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            out.append((doc, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def check_places(rows, capacity=2048):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_places(spark):
    texts = [(i, "word " * (i * 7 % 900)) for i in range(300)] + [(301, None), (302, ""), (None, "x"), (5, "again"), (5, "again"), (400, "long word, " * 9000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS bin", "2 AS place", "3 AS fill").repartition(6)
    rows = packing.pack(docs, PATH).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == pieces_by_hand(texts)
    n = check_places(rows)
    total = sum(r.length for r in rows)
    assert n <= 1.02 * -(-total // 2048) + 1
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_later_rounds_join_what_tasks_left(spark):
    texts = [(i, "word " * 300) for i in range(64)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(64), PATH).collect()
    assert check_places(rows) <= 12


@pytest.mark.parametrize("lengths", [[], [2048], [1] * 5000, [1025] * 7 + [1023] * 7, list(range(1, 2049))])
def test_best_fit(lengths):
    bins, places, fill = packing.best_fit(np.array(lengths, dtype=np.int64))
    assert fill.sum() == sum(lengths) and (fill <= 2048).all()
    assert len(fill) <= np.ceil(sum(lengths) / 2048) + 1
