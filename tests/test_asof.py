"""As-of, interval and bitemporal lookups against their definitions, with and without hot keys."""

import datetime as dt
import random

import pytest

from tidemark.operators import asof

DAY0 = dt.date(2020, 1, 1)


def day(n):
    return None if n is None else DAY0 + dt.timedelta(days=n)


def spans_of(rng, n, keys):
    out = []
    for _ in range(n):
        a = rng.randrange(0, 300)
        b = None if rng.random() < 0.1 else a + rng.choice((0, 1, 5, 40, 250, -3))
        out.append((rng.choice(keys), day(a) if rng.random() > 0.02 else None, day(b), f"s{rng.randrange(9)}"))
    return out


def holding(spans, key, at):
    live = [(a, b or dt.date.max, x) for k, a, b, x in spans if key is not None and k == key and a is not None and at is not None and a <= at and (b is None or (b >= at and b >= a))]
    return max(live)[2] if live else None


@pytest.mark.parametrize("hot_rows", [10**6, 25])
def test_overlapping_spans(spark, hot_rows):
    rng = random.Random(hot_rows)
    keys = ["hot"] * 12 + ["b", "c", None]
    spans = spans_of(rng, 400, keys) + [("d", day(0), day(365), "ST"), ("d", day(31), day(40), "NEW"), ("e", day(5), None, "open"), ("e", day(5), day(9), "short"), ("e", day(7), day(7), "one")]
    points = [(i, rng.choice([*keys, "d", "e", "none"]), day(rng.randrange(-5, 420)) if rng.random() > 0.02 else None) for i in range(600)] + [(1000, "d", day(151)), (1001, "d", day(35))]
    s = spark.createDataFrame(spans, "k string, a date, b date, label string")
    p = spark.createDataFrame(points, "i long, k string, at date")
    got = {r.i: r.label for r in asof.interval_lookup(p, s, "k", "at", "a", "b", "label", hot_rows=hot_rows, buckets=7).collect()}
    assert got == {i: holding(spans, k, at) for i, k, at in points}
    assert got[1000] == "ST" and got[1001] == "NEW"
    pieces = asof.disjoint(s, "k", "a", "b", "label", hot_rows, 7).collect()
    for key in ("hot", "d", "e"):
        own = sorted((r.a, r.b or dt.date.max) for r in pieces if r.k == key)
        assert all(x[1] < y[0] for x, y in zip(own, own[1:], strict=False))
    assert asof.interval_lookup(p.limit(0), s, "k", "at", "a", "b", "label").count() == 0
    assert asof.interval_lookup(p, s.limit(0), "k", "at", "a", "b", "label").where("label is not null").count() == 0


@pytest.mark.parametrize("strict", [False, True])
def test_a_hot_key_is_spread_and_gives_the_same(spark, strict):
    rng = random.Random(7)
    key = lambda: 1 if rng.random() < 0.9 else rng.choice((2, 3, None))
    left = [(i, key(), rng.randrange(300) if rng.random() > 0.02 else None) for i in range(900)]
    right = [(key(), rng.randrange(300) if rng.random() > 0.02 else None, rng.choice((None, rng.randrange(99)))) for _ in range(300)]
    x, y = spark.createDataFrame(left, "i long, k long, t long"), spark.createDataFrame(right, "k long, t long, v long")
    plain, spread = ({r.i: r.asof_v for r in asof.backward_asof(x, y, "k", "t", "t", "v", strict, hot_rows=h, buckets=9).collect()} for h in (10**6, 100))
    want = {}
    for i, k, t in left:
        seen = [(u, v) for j, u, v in right if k is not None and j == k and None not in (t, u, v) and (u < t if strict else u <= t)]
        want[i] = max(seen)[1] if seen else None
    assert plain == spread == want
    cut = asof.cut_hot(x, "k", "t", 100, 9)
    sizes = cut.add(x.where("k = 1 and t is not null"), "k", "t").groupBy("_b").count().collect()
    assert len(sizes) == 9 and max(r["count"] for r in sizes) < 250


def test_many_dates_asked_without_pairs(spark):
    rng = random.Random(1)
    facts = [(rng.choice((1, 1, 1, 2)), rng.randrange(3), day(rng.randrange(0, 90000)) if rng.random() > 0.02 else None, rng.randrange(2), rng.choice((None, float(rng.randrange(50))))) for _ in range(300)]
    f = spark.createDataFrame(facts, "code long, period long, ann_date date, flag int, value double")
    dates = spark.range(100_000).selectExpr("date_add(date'2019-12-01', cast(id as int)) as as_of")
    found = asof.bitemporal_latest(f, dates)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    sampled = [day(n) for n in range(0, 90000, 4001)]
    got = {(r.as_of, r.code, r.period): (r.ann_date, r.value) for r in found.where("pmod(datediff(as_of, date'2020-01-01'), 4001) = 0").collect() if r.as_of in sampled}
    want = {}
    for at in sampled:
        for key in {x[:2] for x in facts}:
            own = [x for x in facts if x[:2] == key and x[2] is not None and x[2] <= at and x[4] is not None]
            first = [(x[2], x[4]) for x in own if x[3] == 0]
            again = [(x[2], x[4]) for x in own if x[3] != 0]
            if own:
                want[(at, *key)] = max(first) if first else min(again)
    assert got == want
    assert asof.bitemporal_latest(f, dates.limit(0)).count() == 0
