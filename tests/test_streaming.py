"""Streams over one and many shuffled files give what the table at rest gives."""

import datetime as dt

import pytest

from tidemark.streaming import state

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = {}
    e = spark.read.parquet(f"{SF}/events.parquet").selectExpr("*", "rand(3) as r")
    for n in (1, 4, 12):
        d = str(tmp_path_factory.mktemp(f"files{n}"))
        e.repartition(n, "r").sortWithinPartitions("r").drop("r").write.parquet(f"{d}/events.parquet")
        out[n] = d
    return out


@pytest.fixture(scope="module")
def rest(spark):
    return spark.read.parquet(f"{SF}/events.parquet").collect()


@pytest.mark.parametrize("n", [1, 4, 12])
def test_hours_lose_nothing(spark, tables, rest, n):
    want = {}
    for r in rest:
        at = (r.ts.replace(minute=0, second=0, microsecond=0), r.event_type)
        want[at] = (want.get(at, (0, 0.0))[0] + 1, want.get(at, (0, 0.0))[1] + r.value)
    got = {(r.hour, r.event_type): (r.n, r.value) for r in state.hourly(state.events(spark, tables[n], 2)).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - v[1]) < 0.01 for k, v in want.items())


@pytest.mark.parametrize("n", [1, 12])
def test_latest_in_any_order(spark, tables, rest, n):
    want = {}
    for r in rest:
        best, k = want.get(r.user_id, (None, 0))
        want[r.user_id] = (max([x for x in (best, r) if x is not None], key=lambda x: (x.ts, x.event_id)), k + 1)
    got = state.drained(state.latest(state.events(spark, tables[n], 4)), ["user_id"], "test-latest").collect()
    assert {r.user_id: (r.event_id, r.event_type, r.value, r.n, r.closed) for r in got} == {u: (e.event_id, e.event_type, e.value, k, e.value <= 1) for u, (e, k) in want.items()}


@pytest.mark.parametrize("n", [1, 12])
def test_alerts_fire_once(spark, tables, rest, n):
    want = {}
    for r in sorted(rest, key=lambda x: (x.ts, x.event_id)):
        if r.value > 60:
            first, k = want.get(r.user_id, (r.event_id, 0))
            want[r.user_id] = (first, k + 1)
    rows = state.written(state.first_alerts(state.events(spark, tables[n], 3), 60.0), "test-alerts").collect()
    last = {u: max((r for r in rows if r.user_id == u), key=lambda r: r.batch) for u in {r.user_id for r in rows}}
    assert {u: (r.event_id, r.n) for u, r in last.items()} == want and want
    assert all(sum(r.fired for r in rows if r.user_id == u) == 1 for u in last)


def test_an_older_event_does_not_open_a_closed_position_again(spark, tmp_path):
    """Batches: open at 5, closed at 9, then one of 7, which is older, then one of 11; the state of a closed key is its mark alone."""
    at = lambda h: dt.datetime(2024, 1, 1, h)
    path = f"{tmp_path}/in"
    seen = []
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame([], schema).write.parquet(path)
    for i, (hour, value) in enumerate(((5, 10.0), (9, 0.5), (7, 30.0), (11, 40.0))):
        spark.createDataFrame([(i, at(hour), 1, "x", value)], schema).coalesce(1).write.mode("append").parquet(path)
        with state._conf(spark, state.ROCKS):
            q = state.latest(spark.readStream.schema(schema).parquet(path)).writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            q.awaitTermination()
    assert [(r.event_id, r.n, r.closed) for r in seen] == [(0, 1, False), (1, 2, True), (1, 3, True), (3, 4, False)]


def test_frames_of_every_kind(spark):
    rows = [
        '{"kind": "position", "body": {"symbol": "A", "contract": {"symbol": ""}, "quantity": 4, "average_cost": 2.0, "unrealized_pnl": 2}}',
        '{"kind": "position", "body": {"contract": {"symbol": "B"}, "quantity": 0, "market_value": 9}}', '{"kind": "quote", "body": {"symbol": "C", "latest_price": 3, "change": 3}}',
        None, "", "nonsense", "[1]", '{"kind": "quote"}', '{"kind": null, "body": {}}', '{"kind": "quote", "body": {"symbol": "C", "volume": "x"}}', '{"kind": "asset", "body": {}}',
    ]
    got = [tuple(r) for r in state.parsed(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i long, frame string").repartition(1)).orderBy("i").select("symbol", "qty", "price", "amount", "pct", "reason").collect()]
    assert got[:3] == [("A", 4.0, 2.0, 8.0, 25.0, None), ("B", 0.0, 0.0, 9.0, 0.0, None), ("C", 0.0, 3.0, 0.0, 0.0, None)]
    assert [r[-1] for r in got[3:]] == ["not_json", "not_json", "not_json", "not_json", "bad_body", "no_kind", "bad_body", "no_symbol"]
