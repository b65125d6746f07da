"""Streaming queries, each held against the same question asked of the table at rest; and published versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, table
from ..sources.versions import Versions, fingerprint, upserted
from ..streaming import state


def latest_state(spark, sf_dir: str) -> DataFrame:
    return state.open_only(state.drained(state.latest(state.events(spark, sf_dir)), ["user_id"], "stream-latest"))


def stream_alerts(spark, sf_dir: str) -> DataFrame:
    return state.drained(state.first_alerts(state.events(spark, sf_dir)), ["user_id"], "stream-alerts").drop("fired")


def stream_hours(spark, sf_dir: str) -> DataFrame:
    return state.hourly(state.events(spark, sf_dir))


def frames(events: DataFrame) -> DataFrame:
    """Events as a broker's frames: JSON of three shapes, a fifth of them damaged in one of five ways."""
    symbol = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    v, cost, last = F.round("value", 2), F.lit(2.5), F.round(F.col("value") / 2, 3)
    wrap = lambda kind, body: F.to_json(F.struct(F.lit(kind).alias("kind"), body.alias("body")))
    own = wrap("position", F.struct(symbol.alias("symbol"), v.alias("quantity"), cost.alias("average_cost"), last.alias("unrealized_pnl")))
    by_contract = wrap("position", F.struct(F.struct(symbol.alias("symbol")).alias("contract"), v.alias("quantity"), cost.alias("average_cost"), F.lit(7.0).alias("market_value"), F.lit(3.5).alias("market_price")))
    quote = wrap("quote", F.struct(symbol.alias("symbol"), (F.col("event_id") % 97 + 10).cast("double").alias("latest_price"), F.lit(2.0).alias("change"), F.col("event_id").alias("volume")))
    asset = wrap("asset", F.struct(symbol.alias("account"), v.alias("cash"), F.lit(10.0).alias("gross_position_value")))
    k = F.col("event_id") % 25
    damaged = F.when(k == 20, F.concat(F.lit('{"kind": "quote", "body": '), v.cast("string"))).when(k == 21, F.lit('{"body": {}}')).when(k == 22, F.lit('{"kind": "rumour", "body": {}}'))
    damaged = damaged.when(k == 23, F.lit('{"kind": "position", "body": {"symbol": "X", "quantity": "many"}}')).otherwise(F.lit('{"kind": "asset", "body": {"cash": 1.0}}'))
    whole = F.when(k < 5, own).when(k < 10, by_contract).when(k < 15, quote).otherwise(asset)
    return events.select("event_id", F.when(k < 20, whole).otherwise(damaged).alias("frame"))


def stream_frames(spark, sf_dir: str) -> DataFrame:
    """Frames of a stream, normalised, together with the dead letters and their reasons."""
    good, dead = state.routed(frames(state.events(spark, sf_dir)), "frame", "stream-frames")
    good = good.select("event_id", "kind", "symbol", *[F.round(c, 4).alias(c) for c in state.NORMAL[1:]])
    return good.unionByName(dead.drop("frame"), allowMissingColumns=True)


def publish_and_rollback(spark, sf_dir: str) -> DataFrame:
    """Orders published, corrected and published again, then rolled back: what each read sees."""
    v = Versions(spark, scratch_path(spark, "versions"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    first = v.publish(o)
    second = v.publish(upserted(v.read(), o.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0)), ["o_orderkey"]))
    seen = [("first", v.read(first)), ("second", v.read())]
    v.rollback(first)
    seen.append(("after_rollback", v.read()))
    assert fingerprint(v.read(first)) == fingerprint(v.read()) != fingerprint(v.read(second))
    out = None
    for name, df in seen:
        one = df.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_if(F.col("o_totalprice") == 0).alias("n_zero")).withColumn("step", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {"latest_state": latest_state, "stream_alerts": stream_alerts, "stream_hours": stream_hours, "stream_frames": stream_frames, "publish_and_rollback": publish_and_rollback}
SQL = {
    "latest_state": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
        SELECT user_id, event_id, event_type, value, n FROM l WHERE k = 1 AND value > 1""",
    "stream_alerts": "SELECT user_id, (min({'ts': ts, 'event_id': event_id})).event_id AS event_id, count(*) AS n FROM events WHERE value > 450 GROUP BY 1",
    "stream_hours": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
    "stream_frames": """WITH e AS (SELECT event_id, event_id % 25 AS k, 'U' || user_id AS symbol, CASE WHEN isfinite(value) THEN round(value, 2) END AS v, CASE WHEN isfinite(value) THEN round(value / 2, 3) END AS half FROM events)
        SELECT event_id, 'position' AS kind, symbol, coalesce(v, 0) AS qty, 2.5::DOUBLE AS price, round(coalesce(v, 0) * 2.5, 4) AS amount, round(CASE WHEN v > 0 THEN 100 * half / (v * 2.5::DOUBLE) ELSE 0 END, 4) AS pct, NULL AS reason FROM e WHERE k < 5
        UNION ALL SELECT event_id, 'position', symbol, coalesce(v, 0), 3.5::DOUBLE, 7.0::DOUBLE, 0.0::DOUBLE, NULL FROM e WHERE k BETWEEN 5 AND 9
        UNION ALL SELECT event_id, 'quote', symbol, event_id::DOUBLE, (event_id % 97 + 10)::DOUBLE, 0.0, round(100 * 2.0::DOUBLE / (event_id % 97 + 8), 4), NULL FROM e WHERE k BETWEEN 10 AND 14
        UNION ALL SELECT event_id, 'asset', symbol, 0.0, 0.0, round(coalesce(v, 0) + 10, 4), 0.0, NULL FROM e WHERE k BETWEEN 15 AND 19
        UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL, ['not_json', 'no_kind', 'unknown_kind', 'bad_body', 'no_symbol'][k - 19] FROM e WHERE k >= 20""",
    "publish_and_rollback": """WITH s AS (SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END), 2) AS less, count(*) FILTER (WHERE o_totalprice = 0) AS z0,
          count(*) FILTER (WHERE o_orderstatus = 'F' OR o_totalprice = 0) AS z1 FROM orders)
        SELECT 'first' AS step, n, total, z0 AS n_zero FROM s UNION ALL SELECT 'second', n, less, z1 FROM s UNION ALL SELECT 'after_rollback', n, total, z0 FROM s""",
}
