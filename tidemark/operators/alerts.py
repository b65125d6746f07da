"""Alert rules over quotes: created, listed, deleted, and fired once each."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of rows in the order in which those of one time count: deletions, then quotes, then new rules.
DELETED, QUOTE, CREATED = 0, 1, 2


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a symbol in order of time to (rule_id, quote_id): the live rules are held by threshold, those above (below) the price apart."""
    symbol, above, below, live = None, [], [], {}
    for batch in batches:
        out = []
        for s, kind, rule, op, x, quote in zip(*(batch.column(c).to_pylist() for c in ("symbol", "kind", "rule_id", "op", "x", "quote_id")), strict=True):
            if s != symbol:
                symbol, above, below, live = s, [], [], {}
            if kind == CREATED:
                live[rule] = True
                heapq.heappush(above, (x, rule)) if op == ">=" else heapq.heappush(below, (-x, rule))
            elif kind == DELETED:
                live.pop(rule, None)
            else:
                for heap, limit in ((above, x), (below, -x)):
                    while heap and heap[0][0] <= limit:
                        _, r = heapq.heappop(heap)
                        if live.pop(r, None):
                            out.append((r, quote))
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], names=["rule_id", "quote_id"])


def fired(rules: DataFrame, quotes: DataFrame) -> DataFrame:
    """rules with `quote_id` and `status`: the first quote of its symbol after a rule was made, and before it was deleted, that fulfils it; triggered, deleted or active.

    rules: rule_id, symbol, op (>= or <=), x, created, deleted (null: not); quotes: quote_id, symbol, at, price.  At one time deletions come first, then quotes
    by id, then new rules, which so do not see them.  A rule without a threshold, a time or a known operator never fires, nor does one deleted by the time it is made.

    One sweep in order of time for each symbol: a quote takes the rules that it fulfils from the top of two heaps, so no rule meets a quote that does not fire
    it and no pairs are formed.  A task holds the live rules of a symbol, and streams its quotes; quotes that fire nothing are not kept.
    """
    usable = F.col("x").isNotNull() & ~F.isnan("x") & F.col("created").isNotNull() & F.col("op").isin(">=", "<=") & (F.col("deleted").isNull() | (F.col("deleted") > F.col("created")))
    none = F.lit(None)
    made = rules.where(usable).select("symbol", F.col("created").alias("at"), F.lit(CREATED).alias("kind"), "rule_id", "op", "x", none.cast("long").alias("quote_id"))
    gone = rules.where(usable & F.col("deleted").isNotNull()).select("symbol", F.col("deleted").alias("at"), F.lit(DELETED).alias("kind"), "rule_id", "op", "x", none.cast("long").alias("quote_id"))
    seen = quotes.where(F.col("at").isNotNull() & F.col("price").isNotNull() & ~F.isnan("price")).select("symbol", "at", F.lit(QUOTE).alias("kind"), none.cast("long").alias("rule_id"), none.cast("string").alias("op"), F.col("price").alias("x"), "quote_id")
    rows = made.unionByName(gone).unionByName(seen).where(F.col("symbol").isNotNull())
    ordered = rows.repartition("symbol").sortWithinPartitions("symbol", "at", "kind", "quote_id", "rule_id")
    hits = ordered.select("symbol", "kind", "rule_id", "op", F.col("x").cast("double").alias("x"), "quote_id").mapInArrow(_swept, "rule_id long, quote_id long")
    status = F.when(F.col("quote_id").isNotNull(), "triggered").when(F.col("deleted").isNotNull(), "deleted").otherwise("active")
    return rules.join(hits, "rule_id", "left").withColumn("status", status)
