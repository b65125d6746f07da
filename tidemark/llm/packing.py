"""Operator 9, best-fit packing: hierarchical residual packing of tokenised documents.

A first pass tokenises whole texts and, within each task's block of documents, places pieces best-fit
in decreasing order.  Bins that are nearly full are done.  The others travel as items to the next
round, in which FAN_IN times fewer tasks see a larger pool: a bin keeps its pieces together and is
placed as one item.  The last round closes every bin.  What travels is (item, length), never a text; each round is written
to the shared folder, and a piece's place is the sum of its places on the way up.

Tokens: ids of each word are remembered in the worker, since a text's ids are its words' ids one after
another; a text that holds a special token's string is encoded whole.

Defined results: a null or empty text is the closing id alone, one piece of length 1; repeated rows
and null ids are packed each by itself; a length of exactly the capacity is one full piece; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import text as text_

CAPACITY = 2048
#: Items that a task packs at once, rounds at most, and how many tasks' residuals meet in one of the next round.
BLOCK, FAN_IN = 50_000, 8
#: Words, and as many stems, that a worker remembers.
REMEMBERED = 700_000
#: A bin is done when no more than this part of it is empty.
NEARLY = 128
TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class WordEncoder:
    """Ids of texts as little-endian uint32 bytes, by words where that is the same.

    The vocabulary's pre-tokeniser parts runs of letters from other characters and drops white space,
    so closing punctuation is encoded apart from its stem; stems of lower-case Latin letters need no
    normalising and go to the merges directly, many in one call.  Anything else is encoded as it stands.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.table = dict(enumerate(byte_letters()))
        self.stems: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, stems: set[bytes]) -> None:
        direct = []
        for s in stems:
            if s.isalpha() and s.islower():  # of ASCII
                direct.append((s, s.decode()))
            elif _lower_letters(s):
                direct.append((s, s.decode("latin-1").translate(self.table)))
            else:
                self.stems[s] = self._encode(s.decode())
        for at in range(0, len(direct), 20_000):
            some = direct[at : at + 20_000]
            done = self.letters.encode(" ".join([x for _, x in some]), add_special_tokens=False)
            ids = np.array(done.ids, dtype="<u4").tobytes()
            ends = (4 * np.searchsorted(np.array(done.word_ids, dtype=np.int64), np.arange(len(some) + 1))).tolist()
            self.stems.update([(s, ids[x:y]) for (s, _), x, y in zip(some, ends, ends[1:], strict=False)])

    def encode(self, texts: list[str]) -> list[bytes]:
        get, found, unknown = self.words.get, [], set()
        for text in texts:
            raw = text.encode()
            words = [] if b"<|" in raw else raw.split()
            ids = list(map(get, words))
            found.append((words, ids))
            if None in ids:
                unknown.update([w for w, x in zip(words, ids, strict=True) if x is None])
        if len(self.words) + len(unknown) > REMEMBERED:
            self.words.clear()
        if len(self.stems) + len(unknown) > REMEMBERED:
            self.stems.clear()
        stems, parts, new = self.stems, [], set()
        for w in unknown:
            pair = (w if w.islower() else w.lower(), b"") if w.isalpha() else _parts(w)
            parts.append(pair)
            new.update([x for x in pair if x and x not in stems])
        self._learn(new)
        fresh = {w: stems[stem] + stems[tail] if tail else stems[stem] for w, (stem, tail) in zip(unknown, parts, strict=True)}
        self.words.update(fresh)
        out = []
        for text, (words, ids) in zip(texts, found, strict=True):
            if not words:
                out.append(self._encode(text) if text else b"")
                continue
            if None in ids:
                ids = [fresh[w] if x is None else x for w, x in zip(words, ids, strict=True)]
            out.append(b"".join(ids))
        return out


#: Letters of Latin-1, and those that neither normalising nor lower-casing changes.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_LOWER = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch


def _lower_letters(word: bytes) -> bool:
    return _LOWER(word.decode()) is not None


def _parts(word: bytes) -> tuple[bytes, bytes]:
    """A word's stem and closing punctuation, where the pre-tokeniser parts them too; stems of Latin-1 letters in lower case."""
    stem = word.rstrip(TAIL)
    if stem.isalpha():  # of ASCII
        return stem.lower(), word[len(stem) :]
    text = stem.decode()
    if _LETTERS(text):
        return text.lower().encode(), word[len(stem) :]
    if stem and stem[-1:].isalnum():  # of ASCII
        return stem, word[len(stem) :]
    return word, b""


_ENCODERS: dict[str, WordEncoder] = {}
text_.REMEMBERED.append(_ENCODERS)


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file; it lives until the worker begins another operator's work."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit in decreasing order: each item's bin and place in it, and each bin's fill."""
    n = len(lengths)
    bins, places = np.zeros(n, np.int64), np.zeros(n, np.int64)
    fill: list[int] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g: some bin has a gap of g
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = gaps >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps ^= 1 << gap
        else:
            gap, b = capacity, len(fill)
            fill.append(0)
        bins[i], places[i] = b, fill[b]
        fill[b] += size
        gap -= size
        if gap:
            if not by_gap[gap]:
                gaps |= 1 << gap
            by_gap[gap].append(b)
    return bins, places, np.array(fill, np.int64)


def _bin_ids(level: int, block: int, n: int) -> np.ndarray:
    """Numbers that no other task, block or round gives."""
    return (np.int64(level) << 60) | (np.int64(TaskContext.get().partitionId()) << 36) | ((np.int64(block) << 24) + np.arange(n, dtype=np.int64))


PIECES = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def _tokenised(path: str, end: int, capacity: int, with_ids: bool):
    """Documents to pieces, each with its place in a bin of this task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        close = int(end).to_bytes(4, "little")
        rows: list = []
        held, block, kind = [], 0, None

        def packed():
            nonlocal rows, held, block
            ids = pa.concat_arrays(held)
            at, piece, start, crc, length, raw = zip(*rows, strict=True)
            lengths = np.array(length, np.int64)
            bins, places, fill = best_fit(lengths, capacity)
            columns = [ids.take(pa.array(at, pa.int64())), *(pa.array(x, t) for x, (_, t) in zip((piece, start, length, crc), PIECES, strict=True))]
            columns += [pa.array(_bin_ids(0, block, len(fill))[bins]), pa.array(places)]
            names = ["doc_id", *(n for n, _ in PIECES), "bin", "place"]
            if with_ids:
                columns.append(pa.array(raw, pa.binary()))
                names.append("ids")
            rows, held, block = [], [], block + 1
            return pa.RecordBatch.from_arrays(columns, names=names)

        seen = 0
        for batch in batches:
            held.append(batch.column("doc_id"))
            some, size, first = [], 0, 0
            texts = batch.column("text")
            for i in range(len(texts) + 1):
                if i == len(texts) or size > 1 << 20:
                    for j, ids in enumerate(coder.encode(some), first):
                        ids += close
                        for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                            part = ids[at : at + 4 * capacity]
                            rows.append((seen + j, piece, at // 4, zlib.crc32(part), len(part) // 4, part if with_ids else None))
                    some, size, first = [], 0, i
                if i < len(texts):
                    some.append(texts[i].as_py() or "")
                    size += len(some[-1])
            seen += len(batch)
            if len(rows) >= BLOCK:
                yield packed()
                seen = 0
        if rows:
            yield packed()

    return run


def _repacked(level: int, capacity: int):
    """(item, length) to the item's bin and place in this round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, block = [], 0, 0

        def packed():
            t = pa.Table.from_batches(held)
            bins, places, fill = best_fit(t.column("item_length").to_numpy(), capacity)
            up = _bin_ids(level, block, len(fill))[bins]
            return pa.RecordBatch.from_arrays([t.column("item").combine_chunks(), pa.array(up), pa.array(places), pa.array(fill[bins])], names=["item", "up", "up_place", "fill"])

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= BLOCK:
                yield packed()
                held, n, block = [], 0, block + 1
        if held:
            yield packed()

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, bin long, place long" + ", ids binary" * with_ids
    pieces = stored(docs.select("doc_id", "text").mapInArrow(_tokenised(path, end, capacity, with_ids), schema), "pack-0")
    tasks = max(1, pieces.rdd.getNumPartitions())
    fills = pieces.groupBy("bin").agg(F.sum("length").alias("fill"))
    open_bins = stored(fills.where(F.col("fill") < capacity - capacity // NEARLY), "pack-open")
    placed = pieces
    level = 0
    while level == 0 or tasks > 1:  # up to the round in which all that is left meets in one task
        level, tasks = level + 1, max(1, tasks // FAN_IN)
        items = open_bins.select(F.col("bin").alias("item"), F.col("fill").alias("item_length"))
        moved = stored(items.repartition(tasks, F.xxhash64("item")).sortWithinPartitions("item").mapInArrow(_repacked(level, capacity), "item long, up long, up_place long, fill long"), f"pack-{level}")
        placed = placed.join(moved.select("item", "up", "up_place"), F.col("bin") == F.col("item"), "left").withColumn("place", F.col("place") + F.coalesce("up_place", F.lit(0))).withColumn("bin", F.coalesce("up", "bin")).drop("item", "up", "up_place")
        if tasks > 1:
            open_bins = stored(moved.where(F.col("fill") < capacity - capacity // NEARLY).select(F.col("up").alias("bin"), "fill").distinct(), "pack-open")
    return placed.withColumnRenamed("bin", "sequence_id").withColumnRenamed("place", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all documents in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
