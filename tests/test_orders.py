"""Budgeted fills, contributions and exponential means against loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cross_section as xs
from tidemark.operators import indicators, trading


def filled(trades, budget):
    """{code: fill} one after another."""
    out = {c: d for c, d, _, forced in trades if forced}
    left = max(0.0, budget - sum(abs(d) for d in out.values()))
    free = [t for t in trades if not t[3]]
    buys, sells = [t for t in free if t[1] > 0], [t for t in free if t[1] <= 0]
    net, b, s = sum(t[1] for t in free), sum(t[1] for t in buys), -sum(t[1] for t in sells)
    bought = net + min(s, max(0.0, (left - net) / 2)) if net >= 0 else min(b, max(0.0, (left + net) / 2))
    for side, room in ((sorted(buys, key=lambda t: (-t[1], t[2] is None, -(t[2] or 0), t[0])), bought), (sorted(sells, key=lambda t: (t[1], t[2] is not None, t[2] or 0, t[0])), bought - net)):
        for c, d, _, _ in side:
            take = min(abs(d), max(0.0, room))
            room -= take
            out[c] = take if d > 0 else -take
    return out


@pytest.mark.parametrize("budget", [0.0, 0.2, 0.7, 5.0])
def test_budgeted_equals_the_loop(spark, budget):
    rng = random.Random(int(budget * 10))
    plans = {p: [(c, rng.choice((0.05, -0.05, 0.1, -0.08, 0.0, rng.uniform(-0.2, 0.2))), rng.choice((None, 1.0, 2.0, rng.random())), rng.random() < 0.15) for c in range(rng.choice((1, 8, 25)))] for p in range(25)}
    rows = [(p, *t) for p, ts in plans.items() for t in ts]
    df = spark.createDataFrame(rows, "plan long, code long, delta double, score double, forced boolean")
    got = {(r.plan, r.code): r.fill for r in trading.budgeted(df, ["plan"], budget).collect()}
    want = {(p, c): x for p, ts in plans.items() for c, x in filled(ts, budget).items()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for p, ts in plans.items():
        free = [t for t in ts if not t[3]]
        assert abs(sum(got[p, t[0]] for t in free) - sum(t[1] for t in free)) < 1e-9
    assert trading.budgeted(df.limit(0), ["plan"], budget).count() == 0


def test_contributions(spark):
    rows = [(1, c, float(c), float(c % 3), None if c == 2 else 1.0) for c in range(6)]
    df = spark.createDataFrame(rows, "d long, code long, a double, b double, e double")
    got = {r.code: r for r in xs.contributions(df, {"a": (0.5, 1), "b": (0.3, -1), "e": (0.2, 1)}, ["d"]).collect()}
    assert [x.factor for x in got[5].contributions] == ["a", "b"] and got[5].contributions[1].value < 0
    assert abs(got[5].score - sum(x.value for x in got[5].contributions) / 0.8) < 1e-12  # e does not vary and is left out


def test_exponential_means(spark):
    rng = random.Random(2)
    px = [rng.uniform(5, 9) if i % 7 else None for i in range(80)]
    df = spark.createDataFrame([(c, i, x) for c in (1, 2) for i, x in enumerate(px)], "code long, ord long, px double").repartition(3)
    found = indicators.macd(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    e1 = e2 = s = None
    want = {}
    for i, (o, p) in enumerate((o, p) for o, p in enumerate(px) if p is not None):
        e1 = p if e1 is None else e1 + 2 / 13 * (p - e1)
        e2 = p if e2 is None else e2 + 2 / 27 * (p - e2)
        m = e1 - e2
        if i >= 25:
            s = m if s is None else s + 2 / 10 * (m - s)
        want[o] = (m, m if s is None else s)
    assert {r.ord: (r.macd, r.signal) for r in found.where("code = 2").collect()} == want


def test_few_bars_and_flat_prices_have_defined_levels(spark):
    flat = [(1, i, 5.0, 5.0, 5.0, 1.0) for i in range(40)]
    few = [(2, i, 5.0, 4.0, 4.5, 1.0) for i in range(14)]
    df = spark.createDataFrame(flat + few, "code long, ord long, high double, low double, close double, vol double")
    assert indicators.confirmed_levels(df).count() == 0
    wave = [(3, i, 10.0 + (i % 10), 9.0 + (i % 10), 9.5 + (i % 10), 1.0) for i in range(60)]
    out = indicators.confirmed_levels(spark.createDataFrame(wave, df.schema)).orderBy("side", "place").collect()
    assert out and all((r.side == "support") == (r.level < 18.5) for r in out)
    assert max(r.strength for r in out) >= 2 and out[0].lo <= out[0].level <= out[0].hi
    assert indicators.level_zones(df.select("code", F.col("close").alias("px"), F.lit("x").alias("tag")).limit(0)).count() == 0


def test_a_universe_is_checked(spark):
    make = lambda rows: spark.createDataFrame(rows, "d long, code string")
    good = make([(1, "a"), (1, "b"), (2, "a")])
    assert xs.checked_universe(good) is good
    for rows in ([], [(1, None)], [(None, "a")], [(1, "a"), (1, "a")]):
        with pytest.raises(ValueError):
            xs.checked_universe(make(rows))


def test_alerts_fire_once_in_order_of_time(spark):
    from tidemark.operators import alerts

    rng = random.Random(4)
    rules = [(i, rng.choice("ab"), rng.choice((">=", "<=", ">=", "??")), rng.choice((None, float(rng.randrange(20)))), rng.randrange(30), rng.choice((None, None, rng.randrange(40)))) for i in range(120)] + [(500, "a", ">=", 1.0, None, None), (501, None, ">=", 1.0, 0, None)]
    quotes = [(i, rng.choice("ab"), rng.randrange(40), rng.choice((None, float("nan"), float(rng.randrange(20)), float(rng.randrange(20))))) for i in range(150)]
    want = {}
    for r, symbol, op, x, made, gone in rules:
        hits = [(at, q) for q, s, at, p in quotes if s == symbol and made is not None and at > made and (gone is None or at < gone) and None not in (x, p) and p == p and ((op == ">=" and p >= x) or (op == "<=" and p <= x))]
        want[r] = (min(hits)[1], "triggered") if hits else (None, "active" if gone is None else "deleted")
    df = alerts.fired(spark.createDataFrame(rules, "rule_id long, symbol string, op string, x double, created long, deleted long").repartition(3), spark.createDataFrame(quotes, "quote_id long, symbol string, at long, price double"))
    assert {r.rule_id: (r.quote_id, r.status) for r in df.collect()} == want
