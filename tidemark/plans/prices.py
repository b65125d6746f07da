"""Adjusted and seeded bars, index and flow series, macro indicators, marked portfolios and price levels, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators.asof import backward_asof
from ..operators.panel import bars, frame
from ..session import stored, table
from .market import ALL, ATTRIBUTES, PANEL, attributes, exposures, month_ends, the_panel
from .pit import SQL as PIT
from .pit import value_factors

#: First day of the batch that is added to a stored history.
BATCH = "1997-01-01"


def seeded_batch(spark, sf_dir: str) -> DataFrame:
    """A batch of dense bars on top of a stored history: close and adjustment factor are carried forward on their own, each from its last known value before the batch.

    The factor (made up: one percent more every 50 periods) is known in every third period only, so that the two seeds lie in different rows.  The adjusted price is null in
    suspended periods.
    """
    p = the_panel(spark, sf_dir).select("code", "ord", "d", "close", "suspended")
    p = p.withColumn("known", F.when(~F.col("suspended") & (F.col("ord") % 3 == 0), 1 + 0.01 * F.floor(F.col("ord") / 50)))
    before = p.where(F.col("d") < F.lit(BATCH).cast("date")).groupBy("code")
    seed = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("ord", c)))[c].alias(f"seed_{c}")
    batch = p.where(F.col("d") >= F.lit(BATCH).cast("date")).join(before.agg(seed("close"), seed("known")), "code", "left")
    so_far = Window.partitionBy("code").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col(f"seed_{c}"))
    b = batch.withColumn("filled", carried("close")).withColumn("factor", carried("known"))
    return b.select("code", "d", "suspended", F.round("filled", 9).alias("filled"), F.round("factor", 6).alias("factor"), F.round(F.when(~F.col("suspended"), F.col("close") * F.col("factor")), 9).alias("adjusted"))


def index_series(spark, sf_dir: str, panel: DataFrame | None = None) -> DataFrame:
    """Per period: the volume-weighted index close, total value, value held (returned lines; a code without any holds 0), and price over a tenth of a year's amount."""
    p = (the_panel(spark, sf_dir) if panel is None else panel).join(attributes(spark, sf_dir).select("code", "shares"), "code")
    g = p.groupBy("ord", "d", "month_end").agg(
        F.try_divide(F.sum("amount"), F.sum("vol")).alias("close"), F.sum(F.col("px") * F.col("shares")).alias("mv"), F.sum(F.coalesce(F.col("returned") * F.col("px"), F.lit(0.0))).alias("held"), F.sum("amount").alias("amount"),
    )
    year = Window.partitionBy(F.lit(0)).orderBy("ord").rowsBetween(-51, 0)  # a row per period
    return g.withColumn("pe", F.when(F.count("*").over(year) == 52, F.try_divide(F.col("mv"), 0.1 * F.sum("amount").over(year))))


def index_bars(spark, sf_dir: str) -> DataFrame:
    s = index_series(spark, sf_dir)
    return s.select("ord", "d", *[F.round(c, n).alias(c) for c, n in (("close", 4), ("mv", 1), ("held", 1), ("pe", 4))])


def growth_by_month(spark, sf_dir: str) -> DataFrame:
    """k (year * 12 + month), month, and the yearly growth in percent of order totals: of urgent ones, of high ones, of all."""
    o = table(spark, sf_dir, "orders").groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("month")).agg(
        *[F.round(F.sum(F.when(cond, F.col("o_totalprice")).otherwise(0.0)), 2).alias(n) for n, cond in (("m1", F.col("o_orderpriority").startswith("1")), ("m2", F.col("o_orderpriority").startswith("2")), ("all", F.lit(True)))]
    )
    o = o.withColumn("k", (F.year("month") * 12 + F.month("month")).cast("long"))
    year_ago = Window.partitionBy(F.lit(0)).orderBy("k").rangeBetween(-12, -12)  # a row per month
    return o.select("k", "month", *[(100 * (F.try_divide(F.col(n), F.first(n).over(year_ago)) - 1)).alias(n) for n in ("m1", "m2", "all")])


INDICATORS = ("erp", "m1_m2_gap", "growth_change", "flow_60", "trend_200")


def macro_indicators(spark, sf_dir: str) -> DataFrame:
    """Five monthly series side by side by calendar month, each null where it is not known.

    erp: the index's earnings yield less the mean discount, in percent; m1_m2_gap: growth of urgent less that of high orders; growth_change: growth of all orders less that three
    calendar months before; flow_60: value held less that 60 periods before, over total value; trend_200: index close over its mean of 200 periods.
    """
    one = Window.partitionBy(F.lit(0)).orderBy("ord")  # a row per period
    long = one.rowsBetween(-199, 0)
    s = index_series(spark, sf_dir).withColumn("flow", F.when(F.col("mv") > 0, (F.col("held") - F.lag("held", 60).over(one)) / F.col("mv")))
    s = s.withColumn("trend", F.when(F.count("close").over(long) == 200, F.try_divide(F.col("close"), F.avg("close").over(long)))).where("month_end").withColumn("month", F.last_day("d"))
    rate = table(spark, sf_dir, "lineitem").groupBy(F.last_day(F.col("l_shipdate").cast("date")).alias("month")).agg((100 * F.avg("l_discount")).alias("rate"))
    ends = s.join(rate, "month", "left").select("month", (F.try_divide(F.lit(100.0), F.col("pe")) - F.col("rate")).alias("erp"), F.col("flow").alias("flow_60"), F.col("trend").alias("trend_200"))
    g = growth_by_month(spark, sf_dir)
    before = Window.partitionBy(F.lit(0)).orderBy("k").rangeBetween(-3, -3)
    g = g.select("month", (F.col("m1") - F.col("m2")).alias("m1_m2_gap"), (F.col("all") - F.first("all").over(before)).alias("growth_change"))
    both = ends.join(g, "month", "full")
    return both.select("month", *[F.round(c, 6).alias(c) for c in INDICATORS])


def held_shares(spark, sf_dir: str, panel: DataFrame | None = None) -> DataFrame:
    """code, ord, d, px, shares held through each period: at month ends 1,000 of money in each of the 20 largest by amount, every other code then 0; between them the last holding.

    What is not named at a rebalance is sold: 0 is filled in before the last value is carried forward.
    """
    p = (the_panel(spark, sf_dir) if panel is None else panel).select("code", "ord", "d", "px", "low", "amount", "month_end")
    rank = F.row_number().over(Window.partitionBy("ord").orderBy(F.col("amount").desc(), "code"))
    named = F.when(F.col("month_end"), F.when((rank <= 20) & (F.col("px") > 0), 1000 / F.col("px")).otherwise(0.0))
    so_far = Window.partitionBy("code").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("named", named)
    return p.select("code", "ord", "d", "px", "low", F.coalesce(F.last("named", ignorenulls=True).over(so_far), F.lit(0.0)).alias("shares"))


def mark_to_market(spark, sf_dir: str) -> DataFrame:
    """Value of the holdings of every period at its price, and at the next period's first known (here: lowest) price."""
    h = held_shares(spark, sf_dir)
    nxt = F.lead("low").over(Window.partitionBy("code").orderBy("ord"))
    g = h.withColumn("next", F.coalesce(nxt, F.col("px"))).groupBy("ord", "d").agg(F.count_if(F.col("shares") > 0).alias("n_held"), F.sum(F.col("shares") * F.col("px")).alias("value"), F.sum(F.col("shares") * F.col("next")).alias("at_next"))
    return g.select("ord", "d", "n_held", F.round("value", 3).alias("value"), F.round("at_next", 3).alias("at_next"))


def relative_performance(spark, sf_dir: str) -> DataFrame:
    """The holdings' returns against the index's, dates with both alone (none is filled in): active return, tracking error, information ratio, drawdown and Calmar ratio."""
    by_code = Window.partitionBy("code").orderBy("ord")
    p = stored(the_panel(spark, sf_dir), "performance-panel")
    h = held_shares(spark, sf_dir, p).withColumn("s0", F.lag("shares").over(by_code)).withColumn("p0", F.lag("px").over(by_code))
    mine = h.groupBy("ord").agg(F.try_divide(F.sum(F.col("s0") * F.col("px")), F.sum(F.when(F.col("px").isNotNull(), F.col("s0") * F.col("p0")))).alias("f")).where("f is not null").select("ord", (F.col("f") - 1).alias("r"))
    one = Window.partitionBy(F.lit(0)).orderBy("ord")  # a row per period
    index = index_series(spark, sf_dir, p).select("ord", (F.try_divide(F.col("close"), F.lag("close").over(one)) - 1).alias("b")).where("b is not null")
    j = mine.join(index, "ord").withColumn("a", F.col("r") - F.col("b")).withColumn("value", F.exp(F.sum(F.ln(1 + F.col("r"))).over(one.rowsBetween(Window.unboundedPreceding, 0))))
    j = j.withColumn("dd", 1 - F.try_divide(F.col("value"), F.greatest(F.max("value").over(one.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))))
    g = j.agg(F.count("*").alias("n"), (52 * F.avg("r")).alias("annual_return"), (52 * F.avg("a")).alias("active_return"), (F.stddev_samp("a") * 52**0.5).alias("tracking_error"), F.max("dd").alias("max_drawdown"))
    r6 = lambda c, name: F.round(c, 6).alias(name)
    return g.select("n", *[r6(F.col(c), c) for c in ("annual_return", "active_return", "tracking_error", "max_drawdown")], r6(F.try_divide(F.col("active_return"), F.col("tracking_error")), "information_ratio"), r6(F.try_divide(F.col("annual_return"), F.col("max_drawdown")), "calmar"))


#: Periods back that a price level may come from.
LEVEL_BACK = 120


def price_levels(spark, sf_dir: str) -> DataFrame:
    """Support and resistance from four kinds of evidence over the last 120 traded periods: swing extremes, full volume buckets, moving averages, range extremes.

    Prices within 1.5 % of a zone's running mean join it; its strength is the number of methods that name it.
    """
    p = the_panel(spark, sf_dir).where(~F.col("suspended")).select("code", "ord", "px", "vol", "suspended")
    last = F.row_number().over(Window.partitionBy("code").orderBy(F.col("ord").desc()))
    p = stored(p.withColumn("back", last).where(F.col("back") <= LEVEL_BACK), "level-bars")
    swings = ind.extrema(p).select("code", "px", F.col("kind").alias("tag"))
    edges = p.groupBy("code").agg(F.min("px").alias("lo"), F.max("px").alias("hi"))
    full = ind.volume_profile(p).where("dense").join(edges, "code").where("hi > lo")
    nodes = full.select("code", (F.col("lo") + (F.col("bucket") + 0.5) * ((F.col("hi") - F.col("lo")) / 40)).alias("px"), F.lit("volume").alias("tag"))
    means = p.groupBy("code").agg(F.count("*").alias("n"), *[F.avg(F.when(F.col("back") <= k, F.col("px"))).alias(f"ma{k}") for k in (20, 60, 120)])
    means = means.select("code", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"ma{k}").alias("px")) for k in (20, 60, 120)])).alias("m"), "n").where("n >= m.k").select("code", "m.px", F.concat(F.lit("ma"), F.col("m.k")).alias("tag"))
    ends = edges.select("code", F.explode(F.array(F.struct(F.col("lo").alias("px"), F.lit("range_low").alias("tag")), F.struct(F.col("hi").alias("px"), F.lit("range_high").alias("tag")))).alias("e")).select("code", "e.*")
    named = swings.unionByName(nodes).unionByName(means).unionByName(ends)
    now = p.where("back = 1").select("code", F.col("px").alias("now"))
    z = ind.level_zones(named.withColumn("px", F.round("px", 9))).join(now, "code")
    side = F.when(F.col("level") < F.col("now"), "support").when(F.col("level") > F.col("now"), "resistance").otherwise("at")
    return z.select("code", F.round("level", 6).alias("level"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "touches", "strength", side.alias("side"))


def price_zones(spark, sf_dir: str) -> DataFrame:
    """Supports and resistances by evidence from highs, lows and typical prices."""
    return ind.confirmed_levels(bars(table(spark, sf_dir, "lineitem")).where("close is not null").withColumnRenamed("d", "ord"), LEVEL_BACK)


def factor_exposure(spark, sf_dir: str) -> DataFrame:
    """Each supplier's reversal at asked days: of the day's cross-section, or of the last one before that has it, with its rank there."""
    e = exposures(spark, sf_dir).where(F.col("reversal_20").isNotNull()).select("code", "d", F.round("reversal_20", 9).alias("v"))
    e = e.withColumn("rank", F.round(F.percent_rank().over(Window.partitionBy("d").orderBy("v")), 6))
    asked = attributes(spark, sf_dir).select("code", F.explode(F.array(*[F.lit(d).cast("date") for d in ("1996-06-15", "1998-12-31", "2003-01-01")])).alias("as_of"))
    found = backward_asof(asked, e.select("code", "d", F.struct("d", "v", "rank").alias("x")), "code", "as_of", "d", "x")
    return found.select("code", "as_of", F.col("asof_x.d").alias("used"), F.round("asof_x.v", 6).alias("value"), F.col("asof_x.rank").alias("rank"))


def fundamentals_snapshot(spark, sf_dir: str) -> DataFrame:
    """The last month end's value factors beside industry and size."""
    v = value_factors(spark, sf_dir)
    last = v.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy(F.col("d").desc()))).where("k = 1").drop("k")
    m = month_ends(the_panel(spark, sf_dir)).join(attributes(spark, sf_dir), "code").select("code", "d", "industry", "sector", F.round(F.col("px") * F.col("shares"), 4).alias("mv"))
    return last.join(m, ["code", "d"])


def listing_union(spark, sf_dir: str) -> DataFrame:
    """Listed, paused and delisted suppliers together, each once (in this order of preference), so that no one that has gone is lost."""
    p = the_panel(spark, sf_dir)
    last = p.groupBy("code").agg(F.max(F.when(~F.col("suspended"), F.col("ord"))).alias("last"))
    end = F.max("last").over(Window.partitionBy(F.lit(0)))
    t = last.withColumn("end", end)  # a row per code
    every = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.lit(3).alias("order"), F.lit("never").alias("state"))
    parts = [t.where("last > end - 4").select("code", F.lit(0).alias("order"), F.lit("listed").alias("state")), t.where("last > end - 26").select("code", F.lit(1).alias("order"), F.lit("paused").alias("state")), t.select("code", F.lit(2).alias("order"), F.lit("delisted").alias("state")), every]
    all_of_them = parts[0]
    for one in parts[1:]:
        all_of_them = all_of_them.unionByName(one)
    return all_of_them.groupBy("code").agg(F.min_by("state", "order").alias("state"), F.count("*").alias("n_sources"))


QUERIES = {
    "seeded_batch": seeded_batch,
    "index_bars": index_bars,
    "macro_indicators": macro_indicators,
    "mark_to_market": mark_to_market,
    "relative_performance": relative_performance,
    "price_levels": price_levels,
    "price_zones": price_zones,
    "factor_exposure": factor_exposure,
    "fundamentals_snapshot": fundamentals_snapshot,
    "listing_union": listing_union,
}

INDEX = """
ix0 AS (SELECT ord, d, sum(amount) / sum(vol) AS close, sum(px * shares) AS mv, sum(coalesce(returned * px, 0)) AS held, sum(amount) AS amount FROM panel JOIN attr USING (code) GROUP BY ord, d),
ix AS (SELECT *, CASE WHEN count(*) OVER y = 52 THEN mv / (0.1::DOUBLE * sum(amount) OVER y) END AS pe FROM ix0 WINDOW y AS (ORDER BY ord ROWS 51 PRECEDING))"""
HELD = """
nm AS (SELECT code, ord, d, px, low, CASE WHEN d IN (SELECT max(d) FROM cal GROUP BY date_trunc('month', d))
    THEN CASE WHEN row_number() OVER (PARTITION BY ord ORDER BY amount DESC, code) <= 20 AND px > 0 THEN 1000 / px ELSE 0.0 END END AS named FROM panel),
h AS (SELECT *, coalesce(last_value(named IGNORE NULLS) OVER (PARTITION BY code ORDER BY ord ROWS UNBOUNDED PRECEDING), 0.0) AS shares FROM nm)"""

SQL = {
    "seeded_batch": f"""WITH {PANEL}, k AS (SELECT code, ord, d, close, suspended, CASE WHEN NOT suspended AND ord % 3 = 0 THEN 1 + 0.01::DOUBLE * (ord // 50) END AS known FROM panel),
        s AS (SELECT code, max_by(close, ord) FILTER (WHERE close IS NOT NULL) AS c0, max_by(known, ord) FILTER (WHERE known IS NOT NULL) AS k0 FROM k WHERE d < DATE '{BATCH}' GROUP BY code),
        b AS (SELECT k.*, coalesce(last_value(close IGNORE NULLS) OVER w, c0) AS filled, coalesce(last_value(known IGNORE NULLS) OVER w, k0) AS factor
          FROM k LEFT JOIN s USING (code) WHERE d >= DATE '{BATCH}' WINDOW w AS (PARTITION BY code ORDER BY ord ROWS UNBOUNDED PRECEDING))
        SELECT code, d, suspended, round(filled, 9) AS filled, round(factor, 6) AS factor, round(CASE WHEN NOT suspended THEN close * factor END, 9) AS adjusted FROM b""",
    "index_bars": f"WITH {PANEL}, {ATTRIBUTES}, {INDEX} SELECT ord, d, round(close, 4) AS close, round(mv, 1) AS mv, round(held, 1) AS held, round(pe, 4) AS pe FROM ix",
    "macro_indicators": f"""WITH {PANEL}, {ATTRIBUTES}, {INDEX},
        s AS (SELECT *, CASE WHEN mv > 0 THEN (held - lag(held, 60) OVER (ORDER BY ord)) / mv END AS flow, CASE WHEN count(close) OVER t = 200 THEN close / avg(close) OVER t END AS trend FROM ix WINDOW t AS (ORDER BY ord ROWS 199 PRECEDING)),
        rt AS (SELECT last_day(l_shipdate::DATE) AS month, 100 * avg(l_discount) AS rate FROM lineitem GROUP BY 1),
        e AS (SELECT last_day(d) AS month, 100.0 / pe - rate AS erp, flow, trend FROM s LEFT JOIN rt ON rt.month = last_day(d) WHERE d IN (SELECT max(d) FROM cal GROUP BY date_trunc('month', d))),
        o AS (SELECT last_day(o_orderdate::DATE) AS month, round(sum(CASE WHEN o_orderpriority[1] = '1' THEN o_totalprice ELSE 0 END), 2) AS m1, round(sum(CASE WHEN o_orderpriority[1] = '2' THEN o_totalprice ELSE 0 END), 2) AS m2, round(sum(o_totalprice), 2) AS al FROM orders GROUP BY 1),
        g AS (SELECT a.month, year(a.month) * 12 + month(a.month) AS k, 100 * (a.m1 / nullif(b.m1, 0) - 1) AS m1, 100 * (a.m2 / nullif(b.m2, 0) - 1) AS m2, 100 * (a.al / nullif(b.al, 0) - 1) AS al FROM o a LEFT JOIN o b ON b.month = last_day((a.month - INTERVAL 12 MONTH)::DATE)),
        q AS (SELECT x.month, x.m1 - x.m2 AS gap, x.al - y.al AS change FROM g x LEFT JOIN g y ON y.k = x.k - 3)
        SELECT coalesce(e.month, q.month) AS month, round(erp, 6) AS erp, round(gap, 6) AS m1_m2_gap, round(change, 6) AS growth_change, round(flow, 6) AS flow_60, round(trend, 6) AS trend_200 FROM e FULL JOIN q ON e.month = q.month""",
    "mark_to_market": f"""WITH {PANEL}, {HELD}, x AS (SELECT *, coalesce(lead(low) OVER (PARTITION BY code ORDER BY ord), px) AS nxt FROM h)
        SELECT ord, d, count(*) FILTER (WHERE shares > 0) AS n_held, round(sum(shares * px), 3) AS value, round(sum(shares * nxt), 3) AS at_next FROM x GROUP BY ord, d""",
    "relative_performance": f"""WITH {PANEL}, {ATTRIBUTES}, {INDEX}, {HELD},
        l AS (SELECT ord, px, lag(shares) OVER (PARTITION BY code ORDER BY ord) AS s0, lag(px) OVER (PARTITION BY code ORDER BY ord) AS p0 FROM h),
        m AS (SELECT ord, sum(s0 * px) / nullif(sum(CASE WHEN px IS NOT NULL THEN s0 * p0 END), 0) - 1 AS r FROM l GROUP BY ord),
        b AS (SELECT ord, close / lag(close) OVER (ORDER BY ord) - 1 AS b FROM ix),
        j AS (SELECT ord, r, r - b AS a, exp(sum(ln(1 + r)) OVER (ORDER BY ord)) AS value FROM m JOIN b USING (ord) WHERE r IS NOT NULL AND b IS NOT NULL),
        k AS (SELECT *, 1 - value / greatest(max(value) OVER (ORDER BY ord), 1.0) AS dd FROM j),
        g AS (SELECT count(*) AS n, 52 * avg(r) AS ar, 52 * avg(a) AS aa, stddev_samp(a) * sqrt(52) AS te, max(dd) AS dd FROM k)
        SELECT n, round(ar, 6) AS annual_return, round(aa, 6) AS active_return, round(te, 6) AS tracking_error, round(dd, 6) AS max_drawdown, round(aa / nullif(te, 0), 6) AS information_ratio, round(ar / nullif(dd, 0), 6) AS calmar FROM g""",
    "price_levels": f"""WITH RECURSIVE {PANEL}, p AS (SELECT * FROM (SELECT code, ord, px, vol, row_number() OVER (PARTITION BY code ORDER BY ord DESC) AS back FROM panel WHERE NOT suspended) WHERE back <= {LEVEL_BACK}),
        w AS (SELECT code, px, CASE WHEN count(px) OVER c = 11 AND px = max(px) OVER c THEN 'peak' WHEN count(px) OVER c = 11 AND px = min(px) OVER c THEN 'trough' END AS tag FROM p WINDOW c AS (PARTITION BY code ORDER BY ord ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
        ed AS (SELECT code, min(px) AS lo, max(px) AS hi, count(*) AS n FROM p GROUP BY code),
        v AS (SELECT code, lo, hi, CASE WHEN hi > lo THEN least(39, floor((px - lo) / ((hi - lo) / 40))) ELSE 0 END::INT AS bucket, sum(vol) AS vol FROM p JOIN ed USING (code) GROUP BY ALL),
        cand AS (SELECT code, px, tag FROM w WHERE tag IS NOT NULL
          UNION ALL SELECT code, lo + (bucket + 0.5::DOUBLE) * ((hi - lo) / 40), 'volume' FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY vol DESC, bucket) AS k FROM v) WHERE k <= 8 AND hi > lo
          UNION ALL SELECT code, avg(px), 'ma' || k FROM p JOIN ed USING (code), (VALUES (20), (60), (120)) m(k) WHERE back <= k AND n >= k GROUP BY code, k
          UNION ALL SELECT code, lo, 'range_low' FROM ed UNION ALL SELECT code, hi, 'range_high' FROM ed),
        o AS (SELECT code, px, tag, row_number() OVER (PARTITION BY code ORDER BY px, tag) AS i FROM (SELECT code, round(px, 9) AS px, tag FROM cand)),
        r(code, i, z, total, n, px, tag) AS (
          SELECT code, i, 1, px, 1, px, tag FROM o WHERE i = 1
          UNION ALL SELECT o.code, o.i, CASE WHEN abs(o.px - total / n) / greatest(o.px, 1e-9) <= 0.015 THEN z ELSE z + 1 END,
            CASE WHEN abs(o.px - total / n) / greatest(o.px, 1e-9) <= 0.015 THEN total + o.px ELSE o.px END, CASE WHEN abs(o.px - total / n) / greatest(o.px, 1e-9) <= 0.015 THEN n + 1 ELSE 1 END, o.px, o.tag
          FROM r JOIN o ON o.code = r.code AND o.i = r.i + 1),
        g AS (SELECT code, z, avg(px) AS level, min(px) AS lo, max(px) AS hi, count(*) AS touches, count(DISTINCT tag) AS strength FROM r GROUP BY code, z)
        SELECT g.code, round(level, 6) AS level, round(lo, 6) AS lo, round(hi, 6) AS hi, touches, strength, CASE WHEN level < p.px THEN 'support' WHEN level > p.px THEN 'resistance' ELSE 'at' END AS side FROM g JOIN p ON p.code = g.code AND back = 1""",
    "price_zones": f"""WITH RECURSIVE {PANEL}, q AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS back FROM bars),
        p AS (SELECT *, count(*) OVER (PARTITION BY code) AS n FROM q WHERE back <= {LEVEL_BACK} QUALIFY n >= 15),
        ed AS (SELECT code, min(low) AS lo, max(high) AS hi, max(n) AS n, max(close) FILTER (WHERE back = 1) AS now FROM p GROUP BY code),
        w AS (SELECT code, low, high, low = min(low) OVER c AND count(*) OVER c = 11 AS t, high = max(high) OVER c AND count(*) OVER c = 11 AS u FROM p WINDOW c AS (PARTITION BY code ORDER BY d ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
        v AS (SELECT code, lo, hi, least(39, floor(((high + low + close) / 3 - lo) / ((hi - lo) / 40)))::INT AS bucket, sum(vol) AS vol FROM p JOIN ed USING (code) WHERE hi > lo GROUP BY ALL),
        cand AS (SELECT code, low AS px, 'trough' AS tag FROM w WHERE t UNION ALL SELECT code, high, 'peak' FROM w WHERE u
          UNION ALL SELECT code, lo + (bucket + 0.5::DOUBLE) * ((hi - lo) / 40), 'volume' FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY vol DESC, bucket) AS k FROM v) WHERE k <= 8
          UNION ALL SELECT code, avg(close), 'ma' || k FROM p, (VALUES (20), (60), (120)) m(k) WHERE back <= k AND n >= k GROUP BY code, k
          UNION ALL SELECT code, lo, 'range_low' FROM ed UNION ALL SELECT code, hi, 'range_high' FROM ed),
        o AS (SELECT code, px, tag, row_number() OVER (PARTITION BY code ORDER BY px, tag) AS i FROM (SELECT code, round(px, 9) AS px, tag FROM cand)),
        r(code, i, z, total, n, px, tag) AS (
          SELECT code, i, 1, px, 1, px, tag FROM o WHERE i = 1
          UNION ALL SELECT o.code, o.i, CASE WHEN abs(o.px - total / n) / greatest(o.px, 1e-9) <= 0.015 THEN z ELSE z + 1 END,
            CASE WHEN abs(o.px - total / n) / greatest(o.px, 1e-9) <= 0.015 THEN total + o.px ELSE o.px END, CASE WHEN abs(o.px - total / n) / greatest(o.px, 1e-9) <= 0.015 THEN n + 1 ELSE 1 END, o.px, o.tag
          FROM r JOIN o ON o.code = r.code AND o.i = r.i + 1),
        g AS (SELECT code, round(avg(px), 6) AS level, round(min(px), 6) AS lo, round(max(px), 6) AS hi, count(*) AS touches, count(DISTINCT tag) AS strength, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM r GROUP BY code, z),
        s AS (SELECT g.*, CASE WHEN level < round(now, 6) THEN 'support' ELSE 'resistance' END AS side, row_number() OVER (PARTITION BY g.code, level < round(now, 6) ORDER BY abs(level - round(now, 6)), level) AS k FROM g JOIN ed USING (code) WHERE level <> round(now, 6)),
        t AS (SELECT *, row_number() OVER (PARTITION BY code, side ORDER BY strength DESC, k) AS best FROM s WHERE k <= 6)
        SELECT code, side, row_number() OVER (PARTITION BY code, side ORDER BY k) AS place, level, lo, hi, strength, touches, tags FROM t WHERE best <= 3""",
    "factor_exposure": f"""{ALL}, e AS (SELECT code, d, v, round(percent_rank() OVER (PARTITION BY d ORDER BY v), 6) AS rank FROM (SELECT code, d, round(reversal_20, 9) AS v FROM expo WHERE reversal_20 IS NOT NULL)),
        a AS (SELECT code, as_of FROM attr, (VALUES (DATE '1996-06-15'), (DATE '1998-12-31'), (DATE '2003-01-01')) t(as_of))
        SELECT a.code, as_of, e.d AS used, round(v, 6) AS value, rank FROM a ASOF LEFT JOIN e ON a.code = e.code AND a.as_of >= e.d""",
    "fundamentals_snapshot": f"""WITH {PANEL}, {ATTRIBUTES}, v AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS k FROM ({PIT['value_factors']}))
        SELECT v.* EXCLUDE (k), industry, sector, round(px * shares, 4) AS mv FROM v JOIN panel USING (code, d) JOIN attr USING (code) WHERE k = 1""",
    "listing_union": f"""WITH {PANEL}, l AS (SELECT code, max(CASE WHEN NOT suspended THEN ord END) AS last FROM panel GROUP BY code), t AS (SELECT *, max(last) OVER () AS e FROM l)
        SELECT s_suppkey AS code, CASE WHEN last > e - 4 THEN 'listed' WHEN last > e - 26 THEN 'paused' WHEN code IS NOT NULL THEN 'delisted' ELSE 'never' END AS state,
          (1 + CASE WHEN code IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN last > e - 26 THEN 1 ELSE 0 END + CASE WHEN last > e - 4 THEN 1 ELSE 0 END)::BIGINT AS n_sources FROM supplier LEFT JOIN t ON s_suppkey = code""",
}
