"""As-of, interval and bitemporal lookups: rows in one order per key with what is known carried forward, so that no pairs are formed.

A key with more than HOT_ROWS rows is cut into buckets of time, at quantiles of its times.  What is known is
carried forward within buckets, which are tasks' work of their own, and what a bucket ends with goes to those after it, so
no key is in one task as a whole.  Other keys are one bucket each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import few

#: Rows of a key that are in one task at most, keys above that at most, and buckets that these are cut into.
HOT_ROWS, MOST_HOT, BUCKETS = 2_000_000, 1000, 128
#: The day of an end that is open.
OPEN = (1 << 31) - 2


@dataclass
class Cut:
    """The keys that are cut into buckets, and the first time of each bucket but the first."""

    keys: DataFrame | None
    times: list

    def add(self, df: DataFrame, key: str, time: str) -> DataFrame:
        """df with its bucket `_b`; 0 for keys that are not cut.  Rows without a key meet nothing and are spread."""
        none = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(time), F.lit(BUCKETS)).cast("int"))
        if self.keys is None:
            return df.withColumn("_b", none.otherwise(0))
        hot = self.keys.select(F.col(key).alias("_hot"))
        found = df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")  # MOST_HOT rows
        return found.withColumn("_b", none.when(F.col("_hot").isNull() | F.col(time).isNull(), 0).otherwise(self.bucket(F.col(time)))).drop("_hot")

    def bucket(self, time: Column, lo: int = 0, hi: int | None = None) -> Column:
        """How many of the times are at or before it, by halving."""
        hi = len(self.times) if hi is None else hi
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(time < F.lit(self.times[mid]), self.bucket(time, lo, mid)).otherwise(self.bucket(time, mid + 1, hi))


def cut_hot(df: DataFrame, key: str, time: str, hot_rows: int, buckets: int) -> Cut:
    """Keys are counted in one pass over the key alone; times are looked at only where a key is hot."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    hot = [r[0] for r in sizes.where(F.col(key).isNotNull()).orderBy(F.col("n").desc()).limit(MOST_HOT).collect()]
    if not hot:
        return Cut(None, [])
    keys = df.sparkSession.createDataFrame([(k,) for k in hot], df.select(key).schema)
    marks = df.join(F.broadcast(keys), key, "left_semi").agg(F.percentile_approx(time, [(i + 1) / buckets for i in range(buckets - 1)], 10_000)).first()[0]
    return Cut(keys, sorted(set(marks or [])))


def backward_asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, strict: bool = False, hot_rows: int = HOT_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """left with `value` of the last right row of its key at or before (strict: before) its time; null if there is none, or no key or time.

    Both sides are laid in one order per key and bucket and the last known value is carried forward, so each side
    moves once and no pair is formed.
    """
    name = f"asof_{value}"
    marks = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key), F.col(right_time).alias("_t"), F.col(value).alias("_v"), F.lit(1 if strict else 0).alias("_o"))
    marks = marks.groupBy(key, "_t", "_o").agg(F.max("_v").alias("_v"))  # ties in time: the greatest value
    asked = left.withColumn("_t", F.col(left_time)).withColumn("_o", F.lit(0 if strict else 1))
    times = left.select(key, F.col(left_time).alias("_t")).unionByName(right.select(key, F.col(right_time).alias("_t")))
    cut = cut_hot(times, key, "_t", hot_rows, buckets)
    both = cut.add(asked.withColumn("_l", F.lit(True)).unionByName(marks.withColumn("_l", F.lit(False)), allowMissingColumns=True), key, "_t")
    w = Window.partitionBy(key, "_b").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn(name, F.last("_v", ignorenulls=True).over(w))
    if cut.keys is not None:
        ends = cut.add(marks.join(F.broadcast(cut.keys), key, "left_semi"), key, "_t").where("_v is not null").groupBy(key, "_b").agg(F.max_by("_v", "_t").alias("_e"))
        every = cut.keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(len(cut.times)))).alias("_b"))
        before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carried = every.join(ends, [key, "_b"], "left").select(F.col(key).alias("_k"), F.col("_b").alias("_c"), F.last("_e", ignorenulls=True).over(before).alias("_e"))
        carried = few(carried.where("_e is not null"), MOST_HOT * BUCKETS)
        out = out.join(carried, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")), "left").withColumn(name, F.coalesce(name, "_e"))
    return out.where("_l").select(*left.columns, name)


def _swept(key: str, label: str, begins: list[int], out: pa.Schema):
    """Spans in order of key, bucket, start, end and label to disjoint pieces of each bucket's days."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # spans that are live, an earlier end above a later one
        group, day, rows = None, 0, []

        def until(to: int) -> None:
            """Give what is visible from `day` to the day before `to`."""
            nonlocal day
            while held and day < to:
                end, value = held[-1]
                if end >= day:
                    rows.append((group[0], day, min(end, to - 1), value))
                    day = min(end, to - 1) + 1
                if end < day:
                    held.pop()
            day = max(day, to)

        def close() -> None:
            if group is not None:
                until(begins[group[1]] if group[2] and group[1] < len(begins) else OPEN + 1)
                held.clear()

        for batch in batches:
            for k, b, cut, s, e, value in zip(*(batch.column(c).to_pylist() for c in (key, "_b", "_cut", "_s", "_e", label)), strict=True):
                if group is None or (k, b) != group[:2]:
                    close()
                    group, day = (k, b, cut), s
                    if cut and b:
                        day = max(day, begins[b - 1])
                until(s)
                while held and held[-1][0] <= e:
                    held.pop()  # hidden by the new span for good
                held.append((e, value))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                rows.clear()
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return run


def disjoint(spans: DataFrame, key: str, start: str, end: str, label: str, hot_rows: int = HOT_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """key, start, end, label: of spans [start, end] of days (end null: open) that may overlap, what is visible: on each day the live span that started last.

    Of several with one start the longest counts, then the greatest label.  Spans without a key or a start or with an end before it hold no day.
    A sweep goes through a key's spans by start with those still live on a stack; to a later bucket of a cut key go the spans that
    reach it and that no later span before it hides.  A piece ends where its bucket does and goes on in the next.
    """
    days = spans.where(F.col(key).isNotNull() & F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start))))
    s = days.select(key, F.unix_date(start).alias("_s"), F.coalesce(F.unix_date(end), F.lit(OPEN)).alias("_e"), F.col(label)).distinct()
    cut = cut_hot(s, key, "_s", hot_rows, buckets)
    s = cut.add(s, key, "_s")
    if cut.keys is None:
        s = s.withColumn("_cut", F.lit(False))
    else:
        hot = cut.keys.select(F.col(key).alias("_hot"))
        s = s.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_cut", F.col("_hot").isNotNull()).drop("_hot")
        own = s.where("_cut")
        later = F.max("_e").over(Window.partitionBy(key, "_b").orderBy("_s", "_e", label).rowsBetween(1, Window.unboundedFollowing))
        last = cut.bucket(F.col("_e"))
        left = own.withColumn("_later", later).withColumn("_last", last).where("_last > _b and (_later is null or _e > _later)")
        tops = own.groupBy(key, "_b").agg(F.max("_e").alias("_top")).groupBy(key).agg(F.collect_list(F.struct("_b", "_top")).alias("_tops"))  # a key's buckets
        left = left.join(few(tops, MOST_HOT), key)
        hidden = F.array_min(F.transform(F.filter("_tops", lambda x: (x["_b"] > F.col("_b")) & (x["_top"] >= F.col("_e"))), lambda x: x["_b"]))
        upto = F.least("_last", F.coalesce(hidden, "_last"))
        carried = left.select(key, F.explode(F.sequence(F.col("_b") + 1, upto)).alias("_b"), "_cut", "_s", "_e", label)
        s = s.unionByName(carried)
    kinds = {f.name: f.dataType for f in s.schema}
    dealt = s.select(key, "_b", "_cut", "_s", "_e", label).repartition(key, "_b").sortWithinPartitions(key, "_b", "_s", "_e", label)
    shape = StructType([StructField(key, kinds[key]), StructField("_s", IntegerType()), StructField("_e", IntegerType()), StructField(label, kinds[label])])
    out = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in shape])
    found = dealt.mapInArrow(_swept(key, label, [int(t) for t in cut.times], out), shape)
    return found.select(key, F.date_from_unix_date("_s").alias(start), F.when(F.col("_e") < OPEN, F.date_from_unix_date(F.when(F.col("_e") < OPEN, F.col("_e")))).alias(end), label)


def interval_lookup(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, label: str, hot_rows: int = HOT_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """points with `label` of the span [start, end] of days (end null: open) that holds their day; null if there is none.

    Spans may overlap: of those that hold the day, the one that started last counts (see disjoint()).
    """
    s = disjoint(spans, key, start, end, label, hot_rows, buckets)
    s = s.select(F.col(key), F.col(start), F.struct(F.col(end).isNull().alias("open"), F.col(end).alias("end"), F.col(label).alias("label")).alias("_span"))
    found = backward_asof(points, s, key, at, start, "_span", hot_rows=hot_rows, buckets=buckets)
    holds = F.col("asof__span.open") | (F.col("asof__span.end") >= F.col(at))
    return found.select(*points.columns, F.when(holds, F.col("asof__span.label")).alias(label))


def runs(df: DataFrame, key: str, order: list[str], label: str, day: str) -> DataFrame:
    """Consecutive rows of a key with one label as intervals: key, label, start_date, end_date (null: still open)."""
    w = Window.partitionBy(key).orderBy(*order)
    new = (~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    grouped = df.withColumn("_run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = grouped.groupBy(key, "_run", label).agg(F.min(day).alias("start_date"))
    after = F.lead("start_date").over(Window.partitionBy(key).orderBy("_run"))
    return spans.select(key, label, "start_date", F.date_sub(after, 1).alias("end_date"))


def bitemporal_latest(facts: DataFrame, as_of: DataFrame, keys: tuple[str, ...] = ("code", "period")) -> DataFrame:
    """The row visible for each as_of and keys: original statements (flag 0) by latest announcement, else restated ones by earliest.

    facts: the keys, ann_date, flag, value; as_of: one row per date asked, in any number.  Each fact first counts at the
    first date asked from its announcement on, found by its day in a calendar of the dates asked.  What is known on that date is one row
    for each key; the last original and the first restated one are carried along in one order per key, and a row goes to
    the dates up to the next change.  So a key has a row per date asked at most, whatever its facts, and nothing is compared by inequality.
    """
    dates = as_of.select("as_of").where("as_of is not null").distinct()
    first, n = dates.agg(F.min("as_of"), F.count("*")).first()
    line = Window.partitionBy(F.lit(0)).orderBy("as_of")  # the dates asked alone
    order = dates.select("as_of", F.row_number().over(line).alias("_n"), F.lag("as_of").over(line).alias("_before"))
    days = order.select("_n", F.explode(F.sequence(F.coalesce(F.date_add("_before", 1), "as_of"), "as_of")).alias("_day"))
    known = facts.where(F.col("value").isNotNull() & F.col("ann_date").isNotNull()).withColumn("_day", F.greatest(F.col("ann_date"), F.lit(first).cast("date")))
    seen = known.join(few(days, 500_000), "_day")
    version = F.struct("ann_date", "value")
    step = seen.groupBy(*keys, "_n").agg(F.max(F.when(F.col("flag") == 0, version)).alias("_o"), F.min(F.when(F.col("flag") != 0, version)).alias("_r"))
    w = Window.partitionBy(*keys).orderBy("_n")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    carried = step.select(*keys, "_n", F.coalesce(F.lead("_n").over(w) - 1, F.lit(n)).alias("_to"), F.coalesce(F.max("_o").over(so_far), F.min("_r").over(so_far)).alias("c"))
    held = carried.select(*keys, F.explode(F.sequence(F.col("_n"), F.col("_to").cast("int"))).alias("_n"), "c")
    return held.join(few(order.select("_n", "as_of"), 500_000), "_n").select("as_of", *keys, F.col("c.ann_date").alias("ann_date"), F.col("c.value").alias("value"))


def ratio_to_previous(df: DataFrame, key: str, order: str, x: str):
    return F.try_divide(F.col(x), F.lag(x).over(Window.partitionBy(key).orderBy(order)))
