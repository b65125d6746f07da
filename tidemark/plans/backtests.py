"""Simulated runs and robustness gates on the supplier panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import cross_section as xs
from ..operators.panel import frame
from ..session import few, stored
from .market import ALL, exposures, process_sql, the_panel

COLUMNS = "run_id string, n int, cap int, budget double, cost_rate double, seed long, from_at long, to_at long"


def scored(spark, sf_dir: str) -> DataFrame:
    """Month ends with a processed score, and the return to the next."""
    e = xs.process(exposures(spark, sf_dir).where(F.col("reversal_20").isNotNull()), "reversal_20", "log_mv", "sector", ["d"])
    at = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("d")).cast("long")
    dates = e.select("d").distinct().select("d", at.alias("at"))  # a row per month
    blocked = F.pmod(F.xxhash64("code", "d"), F.lit(20))
    s = e.join(few(dates), "d").select("at", "code", "sector", F.col("reversal_20").alias("score"), "fwd", (blocked != 0).alias("can_buy"), (blocked != 1).alias("can_sell"))
    return stored(s, "bt-scores")


def grid(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows, COLUMNS)


def base(run_id: str, n=20, cost=0.001, seed=0, lo=1, hi=10**6):
    return (run_id, n, 8, 0.6, cost, seed, lo, hi)


def backtest(spark, sf_dir: str) -> DataFrame:
    return bt.run(scored(spark, sf_dir), grid(spark, [base("base")]))


def backtest_summary(spark, sf_dir: str) -> DataFrame:
    runs = [base(f"n{n}-c{c}", n, c) for n in (10, 20, 40) for c in (0.0, 0.001, 0.002)]
    return bt.summary(bt.run(scored(spark, sf_dir), grid(spark, runs)))


#: Holdings tried per training window and next to the base run.
SIZES = (10, 15, 20, 25, 30)
PERMUTATIONS = 200
#: A fold trains on so many months and is tested on so many after them; the test windows follow one another.
TRAIN, TEST = 60, 12
#: Least share of the in-sample Sharpe that results out of sample must reach.
KEPT = 0.6


def walk_forward(scores: DataFrame, last: int) -> DataFrame:
    """The test windows' dates, each run with the size that had the best Sharpe in its training window (the smaller of equals)."""
    starts = range(TRAIN + 1, last - TEST + 2, TEST)
    train = [base(f"train-{a}-{n}", n, lo=a - TRAIN, hi=a - 1) for a in starts for n in SIZES]
    sr = {r.run_id: r.sharpe for r in bt.summary(bt.run(scores, grid(scores.sparkSession, train))).select("run_id", "sharpe").collect()}  # a row per run
    best = {a: max((v, -n) for n in SIZES if (v := sr.get(f"train-{a}-{n}")) is not None) for a in starts if any(sr.get(f"train-{a}-{n}") is not None for n in SIZES)}
    # A window without a choice leaves no result at all: what cannot be computed does not pass.
    chosen = [base(f"fold-{a}", -best[a][1], lo=a, hi=a + TEST - 1) for a in starts] if len(best) == len(starts) else []
    return bt.run(scores, grid(scores.sparkSession, chosen))


def gates(spark, sf_dir: str) -> DataFrame:
    """Out-of-sample, walk-forward, permutation, doubled cost and parameter peak: every gate is reported, none stops the others.

    Walk-forward: the pooled test windows' Sharpe against KEPT times that of the in-sample run; without a window, or
    with fewer dates than one fold takes, the statistic is 0 and the gate fails.  Folds span all dates, as the
    in-sample ones are too few for five training years.
    """
    s = scored(spark, sf_dir)
    last = s.agg(F.max("at")).first()[0] or 1
    cut = max(1, last * 2 // 3)
    runs = [base("base"), base("in", hi=cut), base("out", lo=cut + 1), base("cost2", cost=0.002)]
    runs += [base(f"perm-{i}", seed=i) for i in range(1, PERMUTATIONS + 1)] + [base(f"grid-{n}", n) for n in SIZES if n != 20]
    sr = {r.run_id: r.sharpe or 0.0 for r in bt.summary(bt.run(s, grid(spark, runs))).select("run_id", "sharpe").collect()}  # a row per run
    pooled = walk_forward(s, last).agg(F.try_divide(F.avg("net"), F.stddev_samp("net")) * 12**0.5).first()[0]
    perm = [v for k, v in sr.items() if k.startswith("perm-")]
    p = (1 + sum(v >= sr["base"] for v in perm)) / (len(perm) + 1)
    near = [v for k, v in sr.items() if k.startswith("grid-")]
    peak = sr["base"] / (sum(near) / len(near)) if near and sum(near) > 0 else float("inf")
    rows = [
        ("out_of_sample", sr.get("out", 0.0), sr.get("out", 0.0) >= KEPT * sr.get("in", 0.0)), ("walk_forward", pooled or 0.0, pooled is not None and "in" in sr and pooled >= KEPT * sr["in"]), ("permutation_p", p, p < 0.05),
        ("cost_doubled", sr["cost2"], sr["cost2"] > 0), ("peak_ratio", min(peak, 1e9), peak < 1.3),
    ]
    return spark.createDataFrame([(k, float(round(v, 6)), bool(ok)) for k, v, ok in rows], "gate string, statistic double, passed boolean")


#: Greatest move in a day, either way, that an order's band may span.
LIMIT = 0.1


def rebalance_plan(spark, sf_dir: str) -> DataFrame:
    """The best 20 of the last month end against those of the one before: action by code, and the price band of its order.

    The band is half the mean true range of 20 periods either way, within the day's limits.
    """
    e = xs.process(exposures(spark, sf_dir).where(F.col("reversal_20").isNotNull()), "reversal_20", "log_mv", "sector", ["d"])
    top = xs.top_capped(e.withColumn("score", F.round("reversal_20", 9)), "score", "sector", ["d"], 20, 8)
    ends = e.groupBy("d").agg(F.lit(1)).select("d", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("d").desc())).alias("back"))  # a row per month
    top = top.join(few(ends), "d")
    now = top.where("back = 1").select("code", F.lit(0.05).alias("target"))
    old = top.where("back = 2").select("code", F.lit(0.05).alias("held"))
    p = the_panel(spark, sf_dir).withColumn("atr", F.avg(F.try_divide(F.col("high") - F.col("low"), F.col("px"))).over(frame(-19)))
    quote = p.join(few(ends.where("back = 1")), "d").select("code", "px", F.least(0.5 * F.col("atr"), F.lit(LIMIT)).alias("half"))
    j = now.join(old, "code", "full").fillna(0.0, ["target", "held"]).join(quote, "code", "left")
    action = F.when(F.col("held") == 0, "buy").when(F.col("target") == 0, "sell").otherwise("hold")
    return j.select("code", action.alias("action"), "target", "held", F.round(F.col("px") * (1 - F.col("half")), 6).alias("low"), F.round(F.col("px") * (1 + F.col("half")), 6).alias("high"))


QUERIES = {"backtest": backtest, "backtest_summary": backtest_summary, "robustness_gates": gates, "rebalance_plan": rebalance_plan}
SQL = {
    "rebalance_plan": f"""{ALL.replace('expo AS (', 'expo0 AS (')}, expo AS (SELECT * FROM expo0 WHERE reversal_20 IS NOT NULL), {process_sql('reversal_20')},
        c AS (SELECT d, code, sector, round(v, 9) AS score, dense_rank() OVER (ORDER BY d DESC) AS back FROM std),
        g AS (SELECT *, row_number() OVER (PARTITION BY d, sector ORDER BY score DESC, code) AS g FROM c),
        t AS (SELECT code, back FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, code) AS rank FROM g WHERE g <= 8) WHERE rank <= 20 AND back <= 2),
        j AS (SELECT code, max(CASE WHEN back = 1 THEN 0.05::DOUBLE ELSE 0 END) AS target, max(CASE WHEN back = 2 THEN 0.05::DOUBLE ELSE 0 END) AS held FROM t GROUP BY code),
        q AS (SELECT code, px, least(0.5 * atr, 0.1::DOUBLE) AS half FROM (SELECT code, d, px, avg((high - low) / px) OVER (PARTITION BY code ORDER BY ord ROWS 19 PRECEDING) AS atr FROM panel) WHERE d = (SELECT max(d) FROM std))
        SELECT code, CASE WHEN held = 0 THEN 'buy' WHEN target = 0 THEN 'sell' ELSE 'hold' END AS action, target, held, round(px * (1 - half), 6) AS low, round(px * (1 + half), 6) AS high
        FROM j LEFT JOIN q USING (code)""",
}
