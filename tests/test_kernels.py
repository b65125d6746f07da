"""What SQL cannot hold: kernels against definitions, invariants and round trips."""

import math

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import options
from tidemark.operators import backtest as bt
from tidemark.operators import cross_section as xs
from tidemark.operators import indicators, retrieval
from tidemark.plans import backtests
from tidemark.session import scratch_path
from tidemark.sources.versions import Versions, audited, fingerprint, latest_by

SF = "/root/testdata/sf0.001"


def test_put_call_parity_and_implied_volatility():
    s, k, t, v = np.array([100.0, 90, 120]), np.array([100.0, 100, 100]), np.array([0.5, 1, 2]), np.array([0.2, 0.35, 0.5])
    c, p = options.greeks(s, k, t, 0.03, v, True), options.greeks(s, k, t, 0.03, v, False)
    assert np.allclose(c["price"] - p["price"], s - k * np.exp(-0.03 * t))
    assert np.allclose(c["delta"] - p["delta"], 1) and np.allclose(c["gamma"], p["gamma"])
    h = 1e-4
    up, down = (options.greeks(s, k, t + d, 0.03, v, False)["price"] for d in (h, -h))
    assert np.allclose(p["theta"], -(up - down) / (2 * h) / 365, atol=1e-5)
    assert np.allclose(options.implied(p["price"], s, k, t, 0.03, False), v, atol=1e-3)


def test_chunks():
    text = "First sentence here, with a part. " * 60 + "\n\n" + "x" * 1300 + "\n\nshort"
    out = retrieval.split_text(text)
    assert all(30 <= len(c) <= 500 for c in out)
    assert "".join(text.split()).count("x" * 400) and sum(map(len, out)) >= 0.95 * len(text.replace("\n", ""))
    assert retrieval.split_text("") == [] and retrieval.split_text("tiny") == []


def test_level_zones(spark):
    rows = [(1, 100.0, "peak"), (1, 101.0, "peak"), (1, 100.5, "ma20"), (1, 110.0, "peak"), (1, 111.0, "trough"), (1, 150.0, "volume"), (2, 5.0, "range_low")]
    got = sorted((r.code, round(r.level, 3), r.lo, r.hi, r.touches, r.strength) for r in indicators.level_zones(spark.createDataFrame(rows, "code long, px double, tag string")).collect())
    assert got == [(1, 100.5, 100.0, 101.0, 3, 2), (1, 110.5, 110.0, 111.0, 2, 2), (1, 150.0, 150.0, 150.0, 1, 1), (2, 5.0, 5.0, 5.0, 1, 1)]


def test_neutralize_is_the_regression_residual(spark):
    rng = np.random.default_rng(0)
    n = 120
    pdf = pd.DataFrame({"d": 1, "code": range(n), "g": [f"g{i % 5}" for i in range(n)], "size": rng.normal(size=n), "x": rng.normal(size=n)})
    pdf.loc[3, "x"] = None
    out = xs.neutralize(spark.createDataFrame(pdf.astype({"x": object}).where(pdf.notna(), None), "d long, code long, g string, size double, x double"), "x", "size", "g", ["d"]).toPandas().set_index("code").x
    ok = pdf.x.notna()
    design = np.column_stack([pd.get_dummies(pdf.g[ok]).to_numpy(float), pdf["size"][ok]])
    want = pdf.x[ok] - design @ np.linalg.lstsq(design, pdf.x[ok], rcond=None)[0]
    assert np.allclose(out[want.index], want) and math.isnan(out[3]) if out[3] is not None else True


@pytest.mark.parametrize("seed", range(20))
def test_books_keep_their_limits(seed):
    rng = np.random.default_rng(seed)
    day = pd.DataFrame({"code": range(40), "sector": rng.integers(0, 5, 40).astype(str), "score": np.where(rng.random(40) < 0.15, np.nan, rng.integers(0, 9, 40)), "can_buy": rng.random(40) > 0.1, "can_sell": rng.random(40) > 0.1})
    held = {int(c): 1 / 12 for c in rng.choice(40, 12, replace=False)}
    stuck = set(day.code[~day.can_sell]) & held.keys()
    want = bt.targets(day, held, 15, 4, stuck)
    assert sum(want.values()) <= 1 + 1e-9 and all(want[c] == held[c] for c in stuck)
    assert all(day.can_buy[c] or c in held for c in want)
    free = day.loc[[c for c in want if c not in stuck]]
    assert not len(free) or free.sector.value_counts().max() <= 4
    new = bt.budgeted(held, want, 0.3)
    assert sum(abs(new.get(c, 0) - held.get(c, 0)) for c in new.keys() | held.keys()) <= 0.3 + 1e-6
    assert sum(new.values()) <= 1 + 1e-9


def test_top_capped_equals_greedy(spark):
    rng = np.random.default_rng(1)
    rows = [(d, c, f"s{rng.integers(0, 4)}", float(rng.integers(0, 6))) for d in range(15) for c in range(30)]
    got = {(r.d, r.code) for r in xs.top_capped(spark.createDataFrame(rows, "d long, code long, sector string, score double"), "score", "sector", ["d"], 10, 3).collect()}
    want = set()
    for d in range(15):
        used, n = {}, 0
        for _, c, s, _ in sorted((r for r in rows if r[0] == d), key=lambda r: (-r[3], r[1])):
            if n < 10 and used.get(s, 0) < 3:
                used[s], n = used.get(s, 0) + 1, n + 1
                want.add((d, c))
    assert got == want


def test_runs_and_gates(spark):
    sf = "/root/testdata/sf0.01"
    s = backtests.scored(spark, sf)
    out = bt.run(s, backtests.grid(spark, [backtests.base("a"), backtests.base("b", cost=0.01), backtests.base("p", seed=3)])).toPandas()
    a, b = out[out.run_id == "a"].sort_values("at"), out[out.run_id == "b"].sort_values("at")
    assert np.allclose(a.equity, (1 + a.net).cumprod()) and (a.turnover <= 0.6 + 1e-6).all()
    assert b.equity.iloc[-1] < a.equity.iloc[-1] and np.allclose(a.gross, b.gross)
    assert {r.gate for r in backtests.gates(spark, sf).collect()} == {"out_of_sample", "walk_forward", "permutation_p", "cost_doubled", "peak_ratio"}


def test_versions(spark):
    v = Versions(spark, scratch_path(spark, "test-versions"))
    assert v.current() is None
    a = spark.createDataFrame([(1, 1.0), (2, None)], "k long, x double")
    first, second = v.publish(a), v.publish(a.where("k = 1"), affected="2024-01-01")
    assert v.current() == second and v.read().count() == 1
    assert [(r.k, r.side) for r in v.changed(first, second).collect()] == [(2, "a")]
    v.rollback(first)
    assert v.current() == first and fingerprint(v.read()) == fingerprint(a.repartition(3)) != fingerprint(a.where("k = 1"))
    assert audited(a, spark.createDataFrame([(1, 1.5), (2, None), (3, 1.0)], "k long, x double"), ["k"], "x").count() == 2
    assert {r.x for r in latest_by(spark.createDataFrame([(1, 1.0), (1, 2.0)], "k long, x double"), ["k"], [__import__("pyspark.sql.functions", fromlist=["x"]).col("x").desc()]).collect()} == {2.0}


def test_runs_see_the_whole_universe(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(d, c, ["a", "b", "c"][0 if c < 80 else c % 3], float(rng.normal() + (c < 80) * 9), float(rng.normal() / 20), 1.0) for d in range(6) for c in range(100)]
    frame = spark.createDataFrame(rows, "d long, code long, sector string, reversal_20 double, fwd double, log_mv double")
    monkeypatch.setattr(backtests, "exposures", lambda *a: frame)
    monkeypatch.setattr(backtests.xs, "process", lambda e, *a: e)
    s = backtests.scored(spark, "")
    assert s.select("code").distinct().count() == 100
    got = bt.run(s, backtests.grid(spark, [backtests.base("base"), backtests.base("perm", seed=3)])).toPandas()
    day = bt.Window.partitionBy("at")
    at = bt.F.row_number().over(day.orderBy(bt.F.xxhash64(bt.F.lit(3).cast("long"), "at", "code"), "code"))
    perm = s.withColumn("score", bt.F.element_at(bt.F.array_sort(bt.F.collect_list(bt.F.struct("code", "score")).over(day)), at)["score"])
    for name, whole in (("base", s), ("perm", perm)):
        want = bt.simulate(whole.toPandas().assign(run_id=name, n=20, cap=8, budget=0.6, cost_rate=0.001))
        mine = got[got.run_id == name].sort_values("at").reset_index(drop=True)
        pd.testing.assert_frame_equal(mine, want.reset_index(drop=True), check_dtype=False)
        assert want.n_held.iloc[0] == 20


def test_walk_forward_takes_the_size_that_training_prefers(spark):
    rng = np.random.default_rng(7)
    rows = []
    for at in range(1, 85):
        for c in range(60):  # before month 61 the best ten alone gain, from then on the next twenty
            good = c < 10 if at <= 60 else 10 <= c < 30
            rows.append((at, c, f"s{c % 5}", float(60 - c), (0.05 if good else -0.03) + float(rng.normal() / 200), True, True))
    s = spark.createDataFrame(rows, "at long, code long, sector string, score double, fwd double, can_buy boolean, can_sell boolean")
    out = backtests.walk_forward(s, 84).toPandas()
    assert sorted(out["at"]) == list(range(61, 85)) and out.run_id.nunique() == 2
    assert set(out.n_held[out["at"] == 61]) == {10}
    assert backtests.PERMUTATIONS == 200 and backtests.walk_forward(s, 71).count() == 0


def test_scratch_keeps_what_it_is_told_to(spark):
    from pathlib import Path

    from tidemark.session import scratch, stored

    there = lambda df: Path(df._stored_path.removeprefix("file://")).exists()
    with scratch() as outer:
        with scratch() as inner:
            a, b = stored(spark.range(3), "scope-a"), inner.keep(stored(spark.range(4), "scope-b"))
        assert not there(a) and there(b) and b.count() == 4
        c = outer.keep(stored(b, "scope-c"))
    assert not there(b) and there(c) and c.count() == 4


def test_two_publishers_never_share_a_number(spark):
    from concurrent.futures import ThreadPoolExecutor

    root = scratch_path(spark, "test-publishers")
    spark.range(2).write.parquet(f"{root}/v-x")
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda i: Versions(spark, root)._append("v-x", None), range(12)))
    assert sorted(numbers) == list(range(1, 13))
    assert Versions(spark, root).current() == "v-x"


def test_factor_cache(spark):
    import datetime

    from tidemark.sources.cache import FactorCache

    day = lambda m, d: datetime.date(2024, m, d)
    rows = [("a", day(1, 5), 1, 1.0, "s1"), ("a", day(1, 5), 2, float("nan"), "s1"), ("a", day(1, 6), 1, 2.0, "s0"), ("b", day(2, 1), 1, 3.0, "s0")]
    schema = "factor string, d date, code long, value double, snapshot string"
    c = FactorCache(spark, scratch_path(spark, "test-cache"))
    assert c.read().count() == 0
    c.put(spark.createDataFrame(rows, schema))
    assert {(r.factor, r.code, r.value) for r in c.read().collect()} == {("a", 1, 1.0), ("a", 2, None), ("a", 1, 2.0), ("b", 1, 3.0)}
    assert c.read(["a"], since="2024-01-06").count() == 1 and c.read(until="2024-01-31").count() == 3
    valid = spark.createDataFrame([("s1",)], "snapshot string")
    asked = []

    def compute(days):
        asked.extend((r.factor, r.d) for r in days.collect())
        return days.selectExpr("factor", "d", "7L AS code", "9D AS value", "'s1' AS snapshot")

    wanted = spark.createDataFrame([("a", day(1, 5)), ("a", day(1, 6)), ("a", day(3, 1))], "factor string, d date")
    assert c.build(wanted, valid, compute) == 2 and sorted(asked) == [("a", day(1, 6)), ("a", day(3, 1))]
    assert c.build(wanted, valid, compute) == 0
    c.drop_orphans(valid)
    assert sorted(((r.factor, r.d, r.code) for r in c.read().collect())) == [("a", day(1, 5), 1), ("a", day(1, 5), 2), ("a", day(1, 6), 7), ("a", day(3, 1), 7)]


def test_portfolio_weights_by_hand(spark):
    from tidemark.plans import tools

    r = tools.nation_returns(spark, "/root/testdata/sf0.01").toPandas().pivot(index="ord", columns="name", values="r")
    cov, mean = r.cov().to_numpy(), r.mean().to_numpy()
    one, inverse = np.ones(len(mean)), np.linalg.pinv(cov)
    tangent = np.clip(inverse @ (mean - 0.02 / 52), 0, None)
    want = {"equal": one, "inverse_vol": 1 / np.sqrt(np.diag(cov)), "min_variance": inverse @ one, "max_sharpe": tangent if tangent.sum() > 0 else one}
    got = tools.portfolio_weights(spark, "/root/testdata/sf0.01").toPandas()
    for method, w in want.items():
        mine = got[got.method == method].set_index("name").weight[r.columns].to_numpy()
        assert np.allclose(mine, w / w.sum(), atol=2e-6) and abs(mine.sum() - 1) < 1e-4


def test_cells_find_what_comparing_all_finds(spark):
    from tidemark.plans import memory, tools

    sf = "/root/testdata/sf0.1"
    exact = {(r.query_id, r.vec_id) for r in tools.nearest_vectors(spark, sf).collect()}
    found = {(r.query_id, r.vec_id) for r in memory.nearest_by_cells(spark, sf).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    cells = retrieval.fit_cells(v)
    assert retrieval.in_cells(v, cells.centres, 1, "vec_id").count() == v.count()
    # All cells looked into, and cells split: nothing is missed.
    all_of_them = retrieval.nearest_in_cells(v.where("vec_id % 50 = 0"), v, retrieval.Cells(cells.centres, len(cells.centres)), piece=7)
    assert {(r.query_id, r.vec_id) for r in all_of_them.collect()} == exact
    assert retrieval.nearest_in_cells(v.limit(0), v, cells).count() == 0
    # Vectors in clusters: few cells do.
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(30, 16))
    rows = [(i, (middle[i % 30] * 3 + rng.normal(size=16)).tolist()) for i in range(1500)]
    near = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cells = retrieval.fit_cells(near)
    assert cells.probes <= len(cells.centres) // 4
    exact, found = ({(r.query_id, r.vec_id) for r in f.collect()} for f in (retrieval.nearest(near.where("vec_id % 50 = 0"), near), retrieval.nearest_in_cells(near.where("vec_id % 50 = 0"), near, cells)))
    assert len(exact & found) >= 0.9 * len(exact)


def test_latest_valid_date_of_a_name(spark):
    from tidemark.plans import memory

    names = {
        "rep_2019-01-05_rev_2021-03-04.pdf": "2021-03-04", "x_2021-02-31_2020-05-06.pdf": "2020-05-06", "600519_2023-12-31_q_20240328": "2024-03-28", "2019_2020_01_05": "2020-01-05", "a20190105b": "2019-01-05",
        "120190105": None, "201901055": None, "19990101": None, "2019-0105 x": "2019-01-05", "201901-05": "2019-01-05", "2019/01/05": None, "2019--01-05": None, "": None, "2024-02-29": "2024-02-29", "2023-02-29": None, "x": None,
    }
    df = spark.createDataFrame([*[(n,) for n in names], (None,)], "name string")
    pieces, date = memory.latest_date(df.name)
    got = {r.name: r.d and r.d.isoformat() for r in df.withColumn("_pieces", pieces).select("name", date.alias("d")).collect()}
    assert got == names | {None: None}


def test_cache_readers_keep_what_they_began_with(spark, monkeypatch):
    import datetime

    from tidemark.sources import cache

    rows = lambda v, months=(1, 2): spark.createDataFrame([("a", datetime.date(2024, m, 5), 1, v, "s1") for m in months], "factor string, d date, code long, value double, snapshot string")
    seen = lambda df: sorted((r.d.month, r.value) for r in df.collect())
    c = cache.FactorCache(spark, scratch_path(spark, "test-manifest"))
    first = c.put(rows(1.0))
    reader = c.read()
    c.put(rows(2.0, (2,)))
    assert seen(reader) == [(1, 1.0), (2, 1.0)] == seen(c.read(version=first)) and seen(c.read()) == [(1, 1.0), (2, 2.0)]
    # A writer that dies after its rows are down, and before the manifest is, changes nothing.
    with monkeypatch.context() as m:
        m.setattr(cache.Versions, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            c.put(rows(3.0))
    assert seen(c.read()) == [(1, 1.0), (2, 2.0)]
    # Within the grace time nothing goes; after it, the dead writer's rows alone, as the newest manifest names both other writes.
    assert c.prune(3600) == 0 and seen(reader) == [(1, 1.0), (2, 1.0)]
    assert c.prune(0) == 1 and seen(c.read()) == [(1, 1.0), (2, 2.0)]
    c.put(rows(4.0))
    assert c.prune(0) == 2 and seen(c.read()) == [(1, 4.0), (2, 4.0)] and len(c.versions.kept()) == 1
    c.drop_orphans(spark.createDataFrame([], "snapshot string"))
    assert c.read().count() == 0 and c.build(rows(0.0).select("factor", "d"), spark.createDataFrame([("s1",)], "snapshot string"), lambda days: rows(5.0)) == 2
    assert seen(c.read()) == [(1, 5.0), (2, 5.0)]


def test_versions_are_kept_for_a_while(spark):
    v = Versions(spark, scratch_path(spark, "test-retention"))
    assert v.prune(1, 0) == [] and v.kept() == []
    names = [v.publish(spark.range(i + 1)) for i in range(4)]
    assert v.prune(2, 3600) == [] and v.kept() == names[::-1]
    v.rollback(names[0])
    assert v.prune(2, 0) == [names[2], names[1]] and v.kept() == [names[0], names[3]] and v.read().count() == 1
    for missing in (names[1], "v-never"):
        with pytest.raises(ValueError):
            v.rollback(missing)
    assert v.current() == names[0]
