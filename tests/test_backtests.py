"""Runs against simulate() over whole universes, and what goes through their shuffles."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.plans import backtests

SCORES = "at long, code long, sector string, score double, fwd double, can_buy boolean, can_sell boolean"


def universe(seed, codes, dates, listed=0.8):
    rng = np.random.default_rng(seed)
    kinds = rng.choice(["a", "b", "c", "thin", None], codes, p=[0.4, 0.3, 0.2, 0.05, 0.05])
    rows = []
    for at in range(1, dates + 1):
        for c in range(codes):
            if rng.random() < listed:
                score = rng.choice([None, float("nan"), float(rng.integers(0, 12)), float(rng.normal())], p=[0.05, 0.05, 0.45, 0.45])
                rows.append((at, c * 7 - 100, kinds[c], score, rng.choice([None, float(rng.normal() / 20)], p=[0.1, 0.9]), bool(rng.random() > 0.2), bool(rng.random() > 0.2)))
    rows += [(dates + 1, c * 7 - 100, kinds[c], None, 0.01, True, True) for c in range(0, codes, 2)]
    return rows


def test_runs_equal_the_simulation_over_all_codes(spark):
    s = spark.createDataFrame(universe(3, 90, 14), SCORES).repartition(3)
    runs = [(f"r{i}", n, cap, 0.5, 0.001, seed, lo, hi) for i, (n, cap, seed, lo, hi) in enumerate([(10, 3, 0, 1, 99), (10, 3, 5, 1, 99), (40, 2, 6, 1, 99), (25, 90, 7, 3, 9), (1, 1, 8, 4, 4), (6, 0, 9, 1, 99), (300, 300, 10, 2, 15), (10, 3, 11, 50, 60)])]
    got = bt.run(s, backtests.grid(spark, runs)).toPandas()
    day = bt.Window.partitionBy("at")
    for run_id, n, cap, budget, cost, seed, lo, hi in runs:
        place = F.row_number().over(day.orderBy(F.xxhash64(F.lit(seed).cast("long"), "at", "code"), "code"))
        dealt = F.element_at(F.array_sort(F.collect_list(F.struct("code", "score")).over(day)), place)["score"]
        whole = (s.withColumn("score", dealt) if seed else s).where(F.col("at").between(lo, hi)).toPandas()
        mine = got[got.run_id == run_id].sort_values("at").reset_index(drop=True)
        if not len(whole):
            assert not len(mine)
            continue
        want = bt.simulate(whole.assign(run_id=run_id, n=n, cap=cap, budget=budget, cost_rate=cost))
        pd.testing.assert_frame_equal(mine, want.reset_index(drop=True), check_dtype=False)
    assert bt.run(s.limit(0), backtests.grid(spark, runs)).count() == 0


def written(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_permutations_do_not_multiply_what_is_shuffled(spark):
    rows, seeds = universe(4, 1500, 8, 1.0), 60
    s = backtests.stored(spark.createDataFrame(rows, SCORES), "test-scores")
    before = written(spark)
    assert bt.run(s, backtests.grid(spark, [backtests.base(f"p{i}", seed=i) for i in range(1, seeds + 1)])).count() == seeds * 9
    # A row for each score twice, those that runs can choose, and their codes: not a row for each score and run.
    assert 0 < written(spark) - before < 0.2 * seeds * len(rows)


@pytest.mark.parametrize("n, cap", [(5, 2), (20, 8), (3, 100), (60, 60)])
def test_reached_looks_at_as_many_places_as_it_takes(n, cap):
    rng = np.random.default_rng(n)
    m = 700
    sector, free = rng.integers(0, 4, m), rng.random(m) > 0.3
    place, tie = rng.permutation(m), np.sort(rng.integers(0, 90, m))
    in_order = place[np.lexsort((place, tie))]
    want, held = [], np.zeros(4, int)
    for x in in_order:
        if held[sector[x]] < cap and np.minimum(held, cap).sum() < n:
            want.append(x)
        held[sector[x]] += free[x]
    assert bt.reached(place, tie, sector, free, n, cap).tolist() == want
