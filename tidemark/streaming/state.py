"""Keyed latest state, fire-once alerts, hourly windows and mixed frames over event streams.

Events may come in any order and at any time: nothing is dropped for being late.  Keyed state is
held by transformWithState, in RocksDB and the query's checkpoint in the shared folder.  Latest-wins goes by event time and id rather than by
arrival; a key that an event closes is deleted but for a mark of when it was, so that an older event that comes
after it does not open it again, and a timer takes the mark away once it is KEPT old.  Hours are upserts: a batch
writes what it adds to each, and readers sum.

Queries run in update mode: a batch writes only the keys that it changed, to a folder of its own number in
the shared folder, so that a batch that is run again after a restart replaces itself.  Readers take each key's last
batch, or the sum.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.panel import clean
from ..session import scratch_path

#: Milliseconds of processing time that the mark of a closed key stays.
KEPT = 7 * 24 * 3600 * 1000
#: Timers are looked at in batches that have data; else they would keep a run over what is there from ending.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def events(spark: SparkSession, sf_dir: str, files: int = 4) -> DataFrame:
    """The events table as a file stream; ts as an instant."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path + "*").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("value", clean(F.col("value")))


@contextlib.contextmanager
def _conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(result: DataFrame, label: str, per_batch: Callable[[DataFrame], DataFrame] = lambda b: b, schema: StructType | None = None) -> DataFrame:
    """Run an update-mode stream over all that is there; what its batches gave, with their number as `batch`."""
    spark = result.sparkSession
    out = scratch_path(spark, label)

    def put(batch: DataFrame, n: int) -> None:
        per_batch(batch).write.mode("overwrite").parquet(f"{out}/rows/batch={n}")

    with _conf(spark, ROCKS):
        q = result.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(StructType([*(schema or result.schema), StructField("batch", LongType())])).parquet(f"{out}/rows")


def drained(result: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The last row of each key."""
    rows = written(result, label)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*result.columns), "batch").alias("r"))
    return last.select("r.*")


class Latest(StatefulProcessor):
    """Per user the last event by (ts, event_id) and the number of events; a value of 1 or less closes the position."""

    OUT = "user_id bigint, event_id bigint, event_type string, value double, n bigint, closed boolean"

    def __init__(self, kept: int = KEPT) -> None:
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp, event_id bigint, event_type string, value double, n bigint")
        self.mark = handle.getValueState("mark", "ts timestamp, event_id bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        mark = self.mark.get() if held is None and self.mark.exists() else None
        n = held[4] if held else mark[2] if mark else 0
        best = (held[0], held[1], held[2], held[3]) if held else (mark[0], mark[1], None, None) if mark else None
        for part in rows:
            n += len(part)
            top = part.sort_values(["ts", "event_id"]).iloc[-1]
            if best is None or (top.ts, top.event_id) > (pd.Timestamp(best[0]), best[1]):
                best = (top.ts.to_pydatetime(), int(top.event_id), top.event_type, None if pd.isna(top.value) else float(top.value))
        _, event_id, kind, value = best
        closed = value is None or value <= 1
        if closed:
            self.last.clear()
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.mark.update((best[0], event_id, n))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.kept)
        else:
            self.mark.clear()
            self.last.update((*best, n))
        yield pd.DataFrame({"user_id": [key[0]], "event_id": [event_id], "event_type": [kind], "value": [value], "n": [n], "closed": [closed]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.mark.clear()
        yield from ()

    def close(self) -> None:
        pass


class FirstAlert(StatefulProcessor):
    """Fires at a user's first event over the threshold, once; an earlier event that comes late corrects which it was."""

    OUT = "user_id bigint, event_id bigint, n bigint, fired boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "ts timestamp, event_id bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.first.get() if self.first.exists() else None
        first, n = ((pd.Timestamp(held[0]), held[1]), held[2]) if held else (None, 0)
        for part in rows:
            n += len(part)
            top = part.sort_values(["ts", "event_id"]).iloc[0]
            first = min(first, (top.ts, int(top.event_id))) if first else (top.ts, int(top.event_id))
        self.first.update((first[0].to_pydatetime(), first[1], n))
        yield pd.DataFrame({"user_id": [key[0]], "event_id": [first[1]], "n": [n], "fired": [held is None]})

    def close(self) -> None:
        pass


def latest(stream: DataFrame, kept: int = KEPT) -> DataFrame:
    """Per user the last event, how many there were, and whether it closed the position; open_only() takes those away."""
    rows = stream.select("user_id", "ts", "event_id", "event_type", "value").where("user_id is not null and ts is not null")
    return rows.groupBy("user_id").transformWithStateInPandas(Latest(kept), Latest.OUT, "Update", "ProcessingTime")


def open_only(rows: DataFrame) -> DataFrame:
    return rows.where("not closed").drop("closed")


def first_alerts(stream: DataFrame, over: float = 450.0) -> DataFrame:
    """Each user's first event over the threshold and the number of such; `fired` in the one batch that gives the alert."""
    rows = stream.where((F.col("value") > over) & F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select("user_id", "ts", "event_id")
    return rows.groupBy("user_id").transformWithStateInPandas(FirstAlert(), FirstAlert.OUT, "Update", "None")


def hourly(stream: DataFrame, label: str = "stream-hours") -> DataFrame:
    """Tumbling hours by type, of all events however late: batches write what they add, and it is summed."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    added = lambda b: b.groupBy(hour, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    shape = added(stream).schema
    parts = written(stream, label, added, shape)
    return parts.groupBy("hour", "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("value"), 2).alias("value"))


#: Frames by their kind, as they come.
FRAMES = {
    "position": "symbol string, contract struct<symbol:string>, quantity double, average_cost double, market_value double, unrealized_pnl double, market_price double",
    "quote": "symbol string, latest_price double, change double, volume long, timestamp long",
    "asset": "account string, cash double, gross_position_value double, buying_power double, currency string",
}
#: Places that every normalised frame has.
NORMAL = ("symbol", "qty", "price", "amount", "pct")


def parsed(stream: DataFrame, frame: str = "frame") -> DataFrame:
    """The stream with `kind`, NORMAL and `reason`: frames are JSON {"kind": ..., "body": {...}} of several shapes.

    A position's symbol may stand in its contract; its amount is the market value, or quantity times average cost;
    its percentage is the unrealised profit over that cost.  A quote's percentage is its change over the price before.  An
    asset's symbol is its account and its amount the equity.  Missing and zero numbers fall back as stated, others to 0.  A frame that cannot be read
    has a reason, and goes to the dead letters: not_json, no_kind, unknown_kind, bad_body, no_symbol.
    """
    raw = F.col(frame)
    head = F.from_json(raw, "kind string, body string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    df = stream.withColumn("_h", head).withColumn("kind", F.col("_h.kind"))
    body = lambda k: F.from_json(F.when(F.col("kind") == k, F.col("_h.body")), f"{FRAMES[k]}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    df = df.withColumns({f"_{k}": body(k) for k in FRAMES})
    either = lambda x, y: F.when(F.coalesce(x, F.lit(0.0)) != 0, x).otherwise(y)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    p, q, a = (F.col(f"_{k}") for k in ("position", "quote", "asset"))
    cost = zero(p["quantity"]) * zero(p["average_cost"])
    of = lambda x, y, z: F.when(F.col("kind") == "position", x).when(F.col("kind") == "quote", y).when(F.col("kind") == "asset", z)
    symbol = of(F.coalesce(F.nullif(p["contract"]["symbol"], F.lit("")), p["symbol"]), q["symbol"], a["account"])
    bad = F.coalesce(p["_corrupt"], q["_corrupt"], a["_corrupt"]).isNotNull()
    reason = F.when(raw.isNull() | F.col("_h").isNull() | F.col("_h._corrupt").isNotNull(), "not_json").when(F.col("kind").isNull(), "no_kind").when(~F.col("kind").isin(*FRAMES), "unknown_kind").when(F.col("_h.body").isNull() | bad, "bad_body").when(F.coalesce(symbol, F.lit("")) == "", "no_symbol")
    return df.withColumns(
        {
            "symbol": symbol,
            "qty": of(zero(p["quantity"]), zero(q["volume"].cast("double")), F.lit(0.0)),
            "price": of(either(p["market_price"], zero(p["average_cost"])), zero(q["latest_price"]), F.lit(0.0)),
            "amount": of(either(p["market_value"], cost), F.lit(0.0), zero(a["cash"]) + zero(a["gross_position_value"])),
            "pct": of(F.when(cost > 0, 100 * F.try_divide(zero(p["unrealized_pnl"]), cost)).otherwise(0.0), zero(100 * F.try_divide(q["change"], q["latest_price"] - q["change"])), F.lit(0.0)),
            "reason": reason,
        }
    ).drop("_h", *[f"_{k}" for k in FRAMES])


def routed(stream: DataFrame, frame: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(good, dead): what a stream of frames gave, normalised, and what could not be read, as it came and with its reason."""
    rows = written(parsed(stream, frame), label)
    return rows.where("reason is null").drop("reason", frame, "batch"), rows.where("reason is not null").drop("kind", *NORMAL, "batch")
