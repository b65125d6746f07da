"""Operator 10, mixing sources to target weights: capped water-filling, then seeded repetitions.

Targets: every source gets its share by weight, but no more than `max_epochs` times its size; the
excess goes to the others by weight until none is above its cap.  That is one level L with
target = min(cap, L * weight), found on the table of sources.

Sampling: with rate = target / size a source's documents are all repeated floor(rate) times, and
documents amounting to the fraction left over once more.  These are the first in a seeded order of
hashes, so that a rerun, in whatever partitions, chooses the same.  The cut in that order is found by
sizes summed over hash prefixes, a digit at a time (SOURCES x 4096 sums each), so no source,
however large, is sorted or lands in one task.

Defined results: a null text has size 0; a null source is a source of its own, ordered last;
documents of size 0 cost nothing and are kept floor(rate) times, or once more if their hash is before
the cut; a source of size 0 has target 0; rows with equal doc_id and text are ordered alike and are
taken together; null ids are hashed as an empty string; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import aside, discard, few, scratch, stored
from .text import words

#: Sources in code-point order (null last) weigh these, repeating.
CYCLE = (3, 1, 2)
#: Columns that mix() adds; columns of docs with these names are replaced.
ADDED = ("size", "source_size", "target", "repetitions", "taken")
#: Hex digits of the hash that each pass of the search for a cut decides, and the passes: 60 bits.
DIGITS, PASSES = 3, 5


def sizes(docs: DataFrame, seed: int = 17) -> DataFrame:
    """docs with `size` (words) and `place`, 15 hex digits that order the documents of a source."""
    return docs.withColumn("size", F.size(words(F.col("text"))).cast("long")).withColumn("place", F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, DIGITS * PASSES))


def source_targets(per_source: DataFrame, share: float = 1.5, max_epochs: float = 2.0, cycle=CYCLE) -> DataFrame:
    """(source, source_size) with weight and target; the table has one row per source, of which there are few.

    Ordered by cap / weight, the first k sources are held at their caps and the rest share what is
    left by weight; k is the first at which no further source would exceed its cap.
    """
    weight = F.element_at(F.array(*map(F.lit, cycle)), ((F.col("at") - 1) % len(cycle) + 1).cast("int")).cast("double")
    everything, after = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("ratio", "at")
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    t = per_source.withColumn("at", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    held = F.coalesce(F.sum("cap").over(after.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(after.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.col("total") - held) / rest)  # if this source and all after it share what is left
    # Held is a prefix in this order: a source whose ratio is under its own level is at its cap.
    level = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "at", "level"))).over(everything)["level"]
    return t.withColumn("l", level).select("source", "source_size", "weight", F.when(F.col("l").isNull() | (F.col("ratio") <= F.col("l")), F.col("cap")).otherwise(F.col("l") * F.col("weight")).alias("target"))


def cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole repetitions, and the place before which documents are taken once more.

    At each pass the sizes under the chosen prefix are summed by the next digits; the cut is in the
    digit whose running sum passes what is wanted.  At the last the crossing place itself is taken if
    that comes nearer.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = targets.withColumn("whole", F.floor(rate + 1e-12).cast("long")).withColumn("want", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    t = t.select("source", "source_size", "target", "whole", "want", (F.col("want") > 0).alias("extra"), F.lit("").alias("prefix"))
    for k in range(PASSES):
        upto = DIGITS * (k + 1)
        s = sized.select(F.col("source").alias("s"), F.substring("place", 1, upto).alias("p"), "size")
        if k:
            s = s.join(few(t.select(F.col("source").alias("s2"), F.col("prefix").alias("q"))), F.col("s").eqNullSafe(F.col("s2")) & (F.substring("p", 1, DIGITS * k) == F.col("q"))).select("s", "p", "size")
        sums = s.groupBy("s", "p").agg(F.sum("size").alias("size"))
        run = F.sum("size").over(Window.partitionBy("s").orderBy("p"))
        j = sums.withColumn("run", run).join(few(t.select(F.col("source").alias("s2"), "want")), F.col("s").eqNullSafe(F.col("s2")))
        first = j.where(F.col("run") > F.col("want")).groupBy("s").agg(F.min(F.struct("p", "run", "size")).alias("c"))
        t = t.join(few(first), F.col("source").eqNullSafe(F.col("s")), "left")
        found = F.col("c").isNotNull()
        t = stored(
            t.select(
                "source", "source_size", "target", "whole", "extra",
                # Nothing passes what is wanted: all that is under the prefix is taken ("~" is after any digit).
                F.when(found, F.col("want") - (F.col("c.run") - F.col("c.size"))).otherwise(F.col("want")).alias("want"),
                F.when(found, F.col("c.p")).otherwise(F.concat("prefix", F.lit("~" * DIGITS))).alias("prefix"),
                F.when(found, F.col("c.size")).otherwise(F.lit(0)).alias("at_cut"),
            ),
            "mix-cut",
        )
        if k < PASSES - 1:
            t = t.drop("at_cut")  # needed at the full depth alone
    return t.withColumn("take_cut", (F.col("want") * 2 > F.col("at_cut")) & (F.col("at_cut") > 0)).drop("at_cut", "want")


def repeated(sized: DataFrame, keys: DataFrame, share: float, max_epochs: float, cycle) -> DataFrame:
    """sized (source, size, place and others) with source_size, target, repetitions and taken, by the stored keys (source, size, place) of all rows."""
    with scratch() as s:
        per_source = stored(keys.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-source")
        chosen = s.keep(stored(cuts(keys, source_targets(per_source, share, max_epochs, cycle)), "mix-chosen"))
    j = sized.join(few(chosen.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")), "left")
    more = F.col("extra") & ((F.col("place") < F.col("prefix")) | ((F.col("place") == F.col("prefix")) & F.col("take_cut")))
    return j.withColumn("repetitions", F.col("whole") + more.cast("long")).withColumn("taken", F.col("size") * F.col("repetitions"))


def mix(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, cycle=CYCLE, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target (its source's), repetitions and taken (size x repetitions), one row per input row."""
    docs, back = aside(docs, ("place", "whole", "extra", "prefix", "take_cut", "_s"))
    own = [c for c in docs.columns if c not in ADDED]
    sized = sizes(docs.select(*own), seed)
    keys = stored(sized.select("source", "place", "size"), "mix-size")
    found = repeated(sized, keys, share, max_epochs, cycle)
    discard(keys)
    return found.select(*own, *ADDED).withColumnsRenamed(back)


def taken(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, cycle=CYCLE, seed: int = 17) -> DataFrame:
    """doc_id and what mix() adds, one row per input row; texts are read once, for their sizes."""
    keys = stored(sizes(docs.select("doc_id", "text", "source"), seed).select("doc_id", "source", "place", "size"), "mix-size")
    return repeated(keys, keys, share, max_epochs, cycle).select("doc_id", *ADDED)


def mixed_rows(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, in docs' columns."""
    moved, back = aside(docs, ADDED)
    m = mix(moved, **params)
    return m.withColumn("_copy", F.explode(F.expr("if(repetitions > 0, sequence(1L, repetitions), array())"))).drop("_copy", *ADDED).withColumnsRenamed(back).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the mix of all documents at 150 % of their size, two epochs at most."""
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15) AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM d GROUP BY source),
w AS (
  SELECT *, [3, 1, 2][((pos - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap,
         sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total FROM s),
r AS (
  SELECT *, cap / weight AS ratio,
         (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT (SELECT level FROM r WHERE level < ratio ORDER BY ratio, pos LIMIT 1) AS l),
t AS (
  SELECT source, source_size, CASE WHEN l IS NULL OR ratio <= l THEN cap ELSE l * weight END AS target FROM r, l),
u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END::BIGINT AS whole FROM t),
v AS (SELECT *, greatest(target - whole * source_size, 0.0) AS want FROM u),
p AS (
  SELECT d.*, v.source_size, v.target, v.whole, v.want,
         sum(size) OVER (PARTITION BY d.source ORDER BY place) AS run,
         sum(size) OVER (PARTITION BY d.source, place) AS here
  FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source),
q AS (
  SELECT *, CASE WHEN want <= 0 THEN 0 WHEN run <= want THEN 1
                 WHEN run - here <= want AND here > 0 AND (want - (run - here)) * 2 > here THEN 1 ELSE 0 END AS more FROM p)
SELECT doc_id, size, source_size, target, (size * (whole + more))::BIGINT AS taken, (whole + more)::BIGINT AS repetitions FROM q
"""
