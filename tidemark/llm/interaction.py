"""Operator 13, how filters interact, with duplicates found by sorting.

Texts are range-sorted by fingerprint (XXH64), full text and doc_id, so a large group of copies spreads
over partitions and no task holds one.  A task goes through its rows in order and compares each text with
the one before, which takes the memory of one row; in the same pass it measures the other four
filters.  What it gives is a small row for each document: a mask with a bit for each filter that fails it.

At the boundaries, a group of one fingerprint may have begun in an earlier partition.  Each
partition gives the texts of its last fingerprint (by SHA-256) with their least doc_id, a row or so; documents under
its first fingerprint look their text up among those.

Masks meet the labels by doc_id and become counters by part, which are additive: a count, a count of good and a
count of toxic documents for each of the 32 masks, summed before any shuffle.  All orders and steps are
arithmetic on these counters, as is the Shapley value: of the 120 orders, a filter comes first among the k that
fail a document in 120 / k.

Defined results: null and empty texts are equal texts of no words; a null source is the part ''; a row
counts as a duplicate if the same text occurs under a smaller doc_id, so neither do rows that repeat
one doc_id, nor does a null doc_id, which is no duplicate and makes none; a document is good (toxic) if any of its labels says so; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import few, scratch, stored

#: The filters by their bits, and the order in which their letters are permuted.
FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
ORDERS = math.factorial(len(FILTERS))

CAPITALS, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"


def text_mask(text: str) -> int:
    """Bits of the filters A to D that fail a text."""
    raw = text.encode()
    w = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (len(w) < 50) | (100 * len(set(w)) < 65 * len(w)) << 1 | (100 * capitals > 5 * len(text)) << 2 | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the sorted partition as (doc_id, part, mask, fp, digest, least); the last two are null but for what boundaries need."""
    names = ["doc_id", "part", "mask", "fp", "digest", "least"]
    first = fp = text = least = digest = None  # the partition's first fingerprint; the row before
    ends: dict[bytes, object] = {}  # texts of the current fingerprint, and the least doc_id of each
    begun, base, kind = False, 0, None
    for batch in batches:
        ids, masks, fps, digests = batch.column("doc_id"), [], [], []
        kind = ids.type
        for doc_id, now, t in zip(ids, batch.column("fp").to_pylist(), batch.column("text"), strict=True):
            d, t = doc_id.as_py(), t.as_py()
            if not begun or now != fp:
                first = first if begun else now
                begun, fp, text, ends = True, now, None, {}
            if text is None or t != text:
                text, least, base, digest = t, None, text_mask(t), hashlib.sha256(t.encode()).digest()
            if least is None:  # null ids come first
                least = ends[digest] = d
            masks.append(base | (DUPLICATE if d is not None and least is not None and d > least else 0))
            fps.append(now if now == first else None)
            digests.append(digest if now == first else None)
        n = len(batch)
        yield pa.RecordBatch.from_arrays([ids, batch.column("part"), pa.array(masks, pa.int32()), pa.array(fps, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(n, kind)], names=names)
    ends = {k: v for k, v in ends.items() if v is not None}
    if ends:
        n = len(ends)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array([fp] * n, pa.int64()), pa.array(list(ends), pa.binary()), pa.array(list(ends.values()), kind)], names=names)


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")).withColumn("fp", F.xxhash64("text"))
    # The cuts of the ranges come of sampled fp and doc_id; rows that lie between two cuts are in full order then.
    ranged = rows.repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    with scratch() as s:
        found = s.keep(stored(ranged.mapInArrow(_in_order, f"doc_id {kind}, part string, mask int, fp bigint, digest binary, least {kind}"), "interaction-masks"))
    begun = found.where("mask is null").groupBy("fp", "digest").agg(F.min("least").alias("before"))
    opened = found.where("mask is not null and fp is not null").drop("least").join(few(begun), ["fp", "digest"], "left")
    earlier = F.coalesce(F.col("doc_id") > F.col("before"), F.lit(False))
    opened = opened.select("doc_id", "part", F.when(earlier, F.col("mask").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("mask")).alias("mask"))
    return found.where("mask is not null and fp is null").select("doc_id", "part", "mask").unionByName(opened)


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, and all, good and toxic: arrays with the count of each mask."""
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("toxic"))
    # Copies of one row are one before the join, so that no doc_id is hot there; null ids have no label and stay apart.
    many = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    found = many.where("doc_id is not null").join(known, "doc_id", "left").select("part", "mask", "n", "good", "toxic")
    none = F.lit(None).cast("long")
    found = found.unionByName(many.where("doc_id is null").select("part", "mask", "n", none.alias("good"), none.alias("toxic")))
    sums = found.groupBy("part", "mask").agg(F.sum("n").alias("all"), *[F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c) for c in ("good", "toxic")])
    filled = sums.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("all", "good", "toxic")))).alias("m"))  # 32 entries at most
    at = lambda c: F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda i: F.coalesce(F.element_at("m", i)[c], F.lit(0))).alias(c)
    return filled.select("part", *[at(c) for c in ("all", "good", "toxic")])


def _sum(counts: str, where) -> Column:
    """The sum of an array by mask over the masks that a condition on them holds for."""
    kept = F.transform(counts, lambda n, m: F.when(where(m), n).otherwise(F.lit(0)))
    return F.aggregate(kept, F.lit(0).cast("long"), lambda a, b: a + b)


def orders(spark) -> DataFrame:
    """filter_order, step, bit (of the step's filter) and before (mask of those that come earlier): 600 rows."""
    rows = [("".join(o), k + 1, 1 << FILTERS.index(o[k]), sum(1 << FILTERS.index(x) for x in o[:k])) for o in permutations(FILTERS) for k in range(len(o))]
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order and step, from the counters alone: 80 cases of a filter after a set of others, each of which stands for some of the 600 steps."""
    spark = counts.sparkSession
    cases = F.explode(F.array(*[F.struct(F.lit(1 << f).alias("bit"), F.lit(b).alias("before")) for f in range(len(FILTERS)) for b in range(MASKS) if not b >> f & 1]))
    c = counts.select("*", cases.alias("case")).select("part", "all", "good", "toxic", "case.*")
    hit = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    now = lambda m: hit(m) & ~gone(m)
    share = F.aggregate(F.transform("all", lambda n, m: F.when(hit(m), (n * (ORDERS / F.greatest(F.bit_count(m), F.lit(1)))).cast("long")).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b)
    each = c.select(
        "part", "bit", "before",
        _sum("all", lambda m: ~hit(m) & ~gone(m)).alias("kept"), _sum("all", now).alias("removed"), _sum("all", lambda m: hit(m) & gone(m)).alias("redundant"),
        _sum("all", lambda m: m == F.col("bit")).alias("unique_fails"), _sum("good", now).alias("good_lost"), _sum("toxic", now).alias("toxic_lost"), share.alias("shapley"),
    )
    return each.join(F.broadcast(orders(spark)), ["bit", "before"]).drop("bit", "before")  # 600 rows


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return interactions(counters(failure_masks(docs), labels))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: all documents, by source."""
    found = audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
     'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS f
  FROM d LEFT JOIN l USING (doc_id)),
x AS (SELECT part, good, toxic, [f.A, f.B, f.C, f.D, f.E] AS f, f.A::INT + f.B::INT + f.C::INT + f.D::INT + f.E::INT AS n_failed FROM m),
s(letter, i) AS (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS p
  FROM s a JOIN s b ON b.i <> a.i JOIN s c ON c.i NOT IN (a.i, b.i) JOIN s d ON d.i NOT IN (a.i, b.i, c.i) JOIN s e ON e.i NOT IN (a.i, b.i, c.i, d.i)),
k AS (SELECT part, f, n_failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY ALL),
t AS (
  SELECT part, filter_order, step, n, good, toxic, n_failed, f[p[step]] AS hit, len(list_filter(p[1:step - 1], lambda i: f[i])) > 0 AS gone
  FROM k, o, range(1, 6) r(step)),
q AS (
  SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE hit AND n_failed = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM t GROUP BY part, filter_order, step)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM q
"""
