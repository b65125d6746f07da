"""Queries over the supplier panel: calendars, factors, cross-sections, evaluation; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cross_section as xs
from ..operators import factors as fac
from ..operators import panel as pan
from ..session import table


def lines(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def the_panel(spark, sf_dir: str) -> DataFrame:
    return pan.panel(lines(spark, sf_dir))


PANEL = """
bars AS (
  SELECT l_suppkey AS code, date_trunc('week', l_shipdate)::DATE AS d, round(sum(l_extendedprice), 2) / sum(l_quantity) AS close,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         sum(l_quantity) AS vol, round(sum(l_extendedprice), 2) AS amount, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS returned
  FROM lineitem GROUP BY ALL),
cal AS (
  SELECT d, row_number() OVER (ORDER BY d) AS ord, lag(d) OVER (ORDER BY d) AS prev_d, lead(d) OVER (ORDER BY d) AS next_d
  FROM (SELECT DISTINCT d FROM bars)),
listing AS (SELECT code, min(ord) AS a, max(ord) AS b FROM bars JOIN cal USING (d) GROUP BY code),
panel AS (
  SELECT l.code, c.ord, c.d, b.close, b.high, b.low, coalesce(b.vol, 0.0) AS vol, coalesce(b.amount, 0.0) AS amount, coalesce(b.returned, 0.0) AS returned,
         b.close IS NULL AS suspended,
         last_value(b.close IGNORE NULLS) OVER (PARTITION BY l.code ORDER BY c.ord ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS px
  FROM listing l JOIN cal c ON c.ord BETWEEN l.a AND l.b LEFT JOIN bars b ON b.code = l.code AND b.d = c.d)"""

RETURNS = """
ret AS (
  SELECT *, ln(px / lag(px) OVER w) AS lr, close / lag(close) OVER w - 1 AS rr, ln(close / lag(close) OVER w) AS rlr,
         lag(px, 20) OVER w AS px20, lag(px, 120) OVER w AS px120,
         CASE WHEN vol > 0 THEN vol / 1000 END AS tr
  FROM panel WINDOW w AS (PARTITION BY code ORDER BY ord))"""

FACTORS = """
fac AS (
  SELECT code, d, ord,
    CASE WHEN count(close) OVER (PARTITION BY code ORDER BY ord ROWS 20 PRECEDING) >= 13 THEN -(px / px20 - 1) END AS reversal_20,
    CASE WHEN count(close) OVER (PARTITION BY code ORDER BY ord ROWS BETWEEN 120 PRECEDING AND 20 PRECEDING) >= 61 THEN px20 / px120 - 1 END AS momentum_120_20,
    CASE WHEN count(close) OVER (PARTITION BY code ORDER BY ord ROWS 60 PRECEDING) >= 37 THEN stddev_samp(lr) OVER (PARTITION BY code ORDER BY ord ROWS 59 PRECEDING) END AS volatility_60,
    CASE WHEN count(tr) OVER w20 >= 12 THEN avg(tr) OVER w20 END AS turnover_20,
    CASE WHEN count(CASE WHEN amount > 0 THEN abs(rlr) / amount END) OVER w20 >= 12 THEN 1e9 * avg(CASE WHEN amount > 0 THEN abs(rlr) / amount END) OVER w20 END AS amihud_20,
    CASE WHEN count(rr) OVER w20 >= 12 THEN max(rr) OVER w20 END AS max_ret_20
  FROM ret WINDOW w20 AS (PARTITION BY code ORDER BY ord ROWS 19 PRECEDING))"""


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def trading_calendar(spark, sf_dir: str) -> DataFrame:
    return pan.calendar(pan.bars(lines(spark, sf_dir)))


def dense_panel(spark, sf_dir: str) -> DataFrame:
    return the_panel(spark, sf_dir).select("code", "ord", "d", "close", "vol", "amount", "suspended", "px")


DIGITS = {"amihud_20": 2, "turnover_20": 9}
FACTOR_NAMES = ["reversal_20", "momentum_120_20", "volatility_60", "turnover_20", "amihud_20", "max_ret_20"]


def price_factors(spark, sf_dir: str) -> DataFrame:
    f = fac.price_factors(the_panel(spark, sf_dir))
    return f.select("code", "d", *[F.round(n, DIGITS.get(n, 6)).alias(n) for n in FACTOR_NAMES])


def holding_change(spark, sf_dir: str) -> DataFrame:
    return fac.holding_change(the_panel(spark, sf_dir), "1996-01-01").select("code", "d", *r6("hold_chg_20"))


def market_beta(spark, sf_dir: str) -> DataFrame:
    return fac.beta(the_panel(spark, sf_dir)).select("code", "d", *r6("beta_250"))


def attributes(spark, sf_dir: str) -> DataFrame:
    """code, shares, industry (nation), sector (region) of each supplier."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("code"), (F.abs("s_acctbal") + 1000).alias("shares"), F.col("n_name").alias("industry"), F.col("r_name").alias("sector"))


ATTRIBUTES = """
attr AS (SELECT s_suppkey AS code, abs(s_acctbal) + 1000 AS shares, n_name AS industry, r_name AS sector
         FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def month_ends(df: DataFrame) -> DataFrame:
    """Rows of the last period of each month, as the panel's calendar marks them."""
    return df.where("month_end").drop("month_end")


MONTH = "(SELECT max(d) FROM cal GROUP BY date_trunc('month', d))"


def size_and_industry(spark, sf_dir: str) -> DataFrame:
    p = month_ends(the_panel(spark, sf_dir)).join(attributes(spark, sf_dir), "code")
    mv = F.col("px") * F.col("shares")
    return fac.collapse_rare(p, "industry", "d").select("code", "d", F.round(F.ln(F.when(mv > 0, mv)), 6).alias("log_mv"), "industry")


def exposures(spark, sf_dir: str) -> DataFrame:
    """Month-end cross-sections of the factors with log_mv, sector and the return to the next month end."""
    f = month_ends(fac.price_factors(the_panel(spark, sf_dir), ("px", "month_end")))
    nxt = F.lead("px").over(Window.partitionBy("code").orderBy("d"))
    f = f.withColumn("fwd", F.try_divide(nxt, F.col("px")) - 1)
    out = f.join(attributes(spark, sf_dir), "code")
    return out.withColumn("log_mv", F.ln(F.col("px") * F.col("shares")))


EXPO = f"""
expo AS (
  SELECT f.*, p.px, lead(p.px) OVER (PARTITION BY code ORDER BY d) / p.px - 1 AS fwd, a.shares, a.industry, a.sector, ln(p.px * a.shares) AS log_mv
  FROM fac f JOIN panel p USING (code, d) JOIN attr a USING (code) WHERE d IN {MONTH})"""


def process_sql(x: str, clip: bool = True) -> str:
    return f"""
m1 AS (SELECT d, median({x}) AS m FROM expo GROUP BY d),
m2 AS (SELECT d, any_value(m) AS m, median(abs({x} - m)) * 1.4826 * 3.0 AS s FROM expo JOIN m1 USING (d) GROUP BY d),
win AS (SELECT e.*, CASE WHEN {clip} AND s > 0 AND {x} IS NOT NULL THEN greatest(least({x}, m + s), m - s) ELSE {x} END AS w FROM expo e JOIN m2 USING (d)),
dem AS (
  SELECT *, CASE WHEN ok THEN w - avg(CASE WHEN ok THEN w END) OVER g END AS y, CASE WHEN ok THEN log_mv - avg(CASE WHEN ok THEN log_mv END) OVER g END AS z
  FROM (SELECT *, w IS NOT NULL AND log_mv IS NOT NULL AS ok FROM win) WINDOW g AS (PARTITION BY d, sector)),
neu AS (
  SELECT *, CASE WHEN n >= 30 AND zz > 1e-9 THEN y - zy / zz * z ELSE w END AS u
  FROM (SELECT *, sum(z * z) OVER (PARTITION BY d) AS zz, sum(z * y) OVER (PARTITION BY d) AS zy, count(CASE WHEN ok THEN w END) OVER (PARTITION BY d) AS n FROM dem)),
std AS (
  SELECT *, coalesce(CASE WHEN stddev_samp(u) OVER (PARTITION BY d) > 1e-12 THEN (u - avg(u) OVER (PARTITION BY d)) / stddev_samp(u) OVER (PARTITION BY d) END, 0.0) AS v FROM neu)"""


ALL = f"WITH {PANEL}, {RETURNS}, {FACTORS}, {ATTRIBUTES}, {EXPO}"


def winsorized(spark, sf_dir: str) -> DataFrame:
    return xs.winsorize_mad(exposures(spark, sf_dir), "amihud_20", ["d"]).select("code", "d", F.round("amihud_20", 2).alias("amihud_20"))


def neutralized(spark, sf_dir: str) -> DataFrame:
    e = exposures(spark, sf_dir)
    return xs.neutralize(e, "volatility_60", "log_mv", "sector", ["d"]).select("code", "d", *r6("volatility_60"))


def processed(spark, sf_dir: str) -> DataFrame:
    return xs.process(exposures(spark, sf_dir), "reversal_20", "log_mv", "sector", ["d"]).select("code", "d", *r6("reversal_20"))


WEIGHTS = {"reversal_20": (0.5, 1), "volatility_60": (0.3, -1), "momentum_120_20": (0.2, 1), "max_ret_20": (0.1, -1)}


def combined(spark, sf_dir: str) -> DataFrame:
    e = exposures(spark, sf_dir)
    long = e.select("d", "code", F.explode(F.create_map(*[x for n in WEIGHTS for x in (F.lit(n), F.col(n))])).alias("factor", "raw"))
    z = xs.zscore(long.withColumn("z", F.col("raw")), "z", ["d", "factor"])
    return xs.combine(z, WEIGHTS).select("d", "code", F.round("score", 6).alias("score"), "n_factors")


def ic(spark, sf_dir: str) -> DataFrame:
    return xs.ic_series(exposures(spark, sf_dir), "reversal_20", "fwd", ["d"]).select("d", "n", *r6("ic", "rank_ic"))


def icir(spark, sf_dir: str) -> DataFrame:
    return xs.newey_west(xs.ic_series(exposures(spark, sf_dir), "reversal_20", "fwd", ["d"]), "ic", "d").select("n", *r6("mean", "ir", "t", "nw_t"))


def layer_returns(spark, sf_dir: str) -> DataFrame:
    return xs.layers(exposures(spark, sf_dir), "reversal_20", "fwd", ["d"]).select("d", "layer", F.round("mean_y", 6).alias("mean_y"), "n")


def layer_summary(spark, sf_dir: str) -> DataFrame:
    """Compounded log return of each layer and its rank correlation with the layer number, beside the long-short spread."""
    by = xs.layers(exposures(spark, sf_dir), "reversal_20", "fwd", ["d"], 5).groupBy("layer").agg(F.ln(F.product(1 + F.col("mean_y"))).alias("total"))
    w = Window.partitionBy(F.lit(0))
    ranked = by.withColumn("r", F.rank().over(w.orderBy("total")).cast("double"))
    return ranked.select("layer", F.round("total", 6).alias("total"), F.round(pan.correlation("layer", "r", w), 6).alias("monotonicity"), F.round(F.max(F.when(F.col("layer") == 0, F.col("total"))).over(w) - F.max(F.when(F.col("layer") == 4, F.col("total"))).over(w), 6).alias("low_minus_high"))


def picks(spark, sf_dir: str) -> DataFrame:
    """The flagship: reversal on a dense panel, processed, the best 10 of each month end, 3 of a sector at most."""
    z = xs.process(exposures(spark, sf_dir).where(F.col("reversal_20").isNotNull()), "reversal_20", "log_mv", "sector", ["d"])
    z = z.withColumn("score", F.round("reversal_20", 6))
    return xs.top_capped(z, "score", "sector", ["d"], 10, 3).select("d", "code", "sector", "score", F.col("rank").cast("long").alias("rank"))


def turnover(spark, sf_dir: str) -> DataFrame:
    """Turnover of the monthly equal-weighted top 20, drift-adjusted."""
    e = exposures(spark, sf_dir)
    ordinal = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("d")).cast("long")
    dates = e.where(F.col("reversal_20").isNotNull()).select("d").distinct().select("d", ordinal.alias("at"))
    e = e.withColumn("s", F.round("reversal_20", 9)).withColumn("one", F.lit(1))
    top = xs.top_capped(e, "s", "one", ["d"], 20, 20).join(F.broadcast(dates), "d")
    w = F.lit(1.0) / F.count("*").over(Window.partitionBy("at"))
    held = top.select("at", "code", w.alias("w"), F.coalesce("fwd", F.lit(0.0)).alias("r"))
    return xs.drift_turnover(held).select("at", F.round("turnover", 6).alias("turnover"))


QUERIES = {
    "trading_calendar": trading_calendar,
    "dense_panel": dense_panel,
    "price_factors": price_factors,
    "holding_change": holding_change,
    "market_beta": market_beta,
    "size_and_industry": size_and_industry,
    "winsorize_mad": winsorized,
    "neutralize": neutralized,
    "process_factor": processed,
    "combine_factors": combined,
    "ic_series": ic,
    "icir_newey_west": icir,
    "layer_returns": layer_returns,
    "layer_summary": layer_summary,
    "momentum_picks": picks,
    "drift_turnover": turnover,
}

LONG = ", ".join(f"('{n}', {n})" for n in WEIGHTS)
SQL = {
    "trading_calendar": f"""WITH {PANEL} SELECT *, next_d IS NULL OR date_trunc('month', next_d) <> date_trunc('month', d) AS month_end,
        next_d IS NULL OR year(next_d) <> year(d) AS year_end FROM cal""",
    "dense_panel": f"WITH {PANEL} SELECT code, ord, d, close, vol, amount, suspended, px FROM panel",
    "price_factors": f"WITH {PANEL}, {RETURNS}, {FACTORS} SELECT code, d, {', '.join(f'round({n}, {DIGITS.get(n, 6)}) AS {n}' for n in FACTOR_NAMES)} FROM fac",
    "holding_change": f"""WITH {PANEL}, h AS (
        SELECT *, last_value(ratio IGNORE NULLS) OVER (PARTITION BY code ORDER BY ord ROWS 30 PRECEDING) AS held
        FROM (SELECT *, CASE WHEN vol > 0 THEN returned / vol END AS ratio FROM panel WHERE d >= DATE '1996-01-01'))
        SELECT code, d, round(CASE WHEN count(ratio) OVER (PARTITION BY code ORDER BY ord ROWS 20 PRECEDING) >= 13
                              THEN held - lag(held, 20) OVER (PARTITION BY code ORDER BY ord) END, 6) AS hold_chg_20 FROM h""",
    "market_beta": f"""WITH {PANEL}, {RETURNS}, mk AS (
        SELECT ord, ln(i / lag(i) OVER (ORDER BY ord)) AS index_lr FROM (SELECT ord, sum(amount) / sum(vol) AS i FROM panel GROUP BY ord)),
        q AS (SELECT code, d, ord, CASE WHEN rlr IS NOT NULL THEN index_lr END AS x, CASE WHEN index_lr IS NOT NULL THEN rlr END AS y FROM ret LEFT JOIN mk USING (ord))
        SELECT code, d, round(CASE WHEN count(x) OVER w >= 150 THEN covar_samp(x, y) OVER w / var_samp(x) OVER w END, 6) AS beta_250
        FROM q WINDOW w AS (PARTITION BY code ORDER BY ord ROWS 249 PRECEDING)""",
    "size_and_industry": f"""WITH {PANEL}, {ATTRIBUTES}
        SELECT code, d, round(ln(px * shares), 6) AS log_mv, CASE WHEN count(*) OVER (PARTITION BY d, industry) < 5 THEN '__OTHER__' ELSE industry END AS industry
        FROM panel JOIN attr USING (code) WHERE d IN {MONTH}""",
    "winsorize_mad": f"{ALL}, {process_sql('amihud_20')} SELECT code, d, round(w, 2) AS amihud_20 FROM win",
    "neutralize": f"{ALL}, {process_sql('volatility_60', False)} SELECT code, d, round(u, 6) AS volatility_60 FROM neu",
    "process_factor": f"{ALL}, {process_sql('reversal_20')} SELECT code, d, round(v, 6) AS reversal_20 FROM std",
    "combine_factors": f"""{ALL}, lng AS (SELECT d, code, unnest([{', '.join(repr(n) for n in WEIGHTS)}]) AS factor, unnest([{', '.join(WEIGHTS)}]) AS raw FROM expo),
        z AS (SELECT *, CASE WHEN stddev_samp(raw) OVER w > 1e-12 THEN (raw - avg(raw) OVER w) / stddev_samp(raw) OVER w END AS z FROM lng WINDOW w AS (PARTITION BY d, factor)),
        wt(factor, weight, direction) AS (VALUES {', '.join(f"('{k}', {a}::DOUBLE, {b})" for k, (a, b) in WEIGHTS.items())}),
        cov AS (SELECT d, factor FROM lng GROUP BY ALL HAVING count(raw) > 0 AND count(raw) / count(*) >= 0.6),
        us AS (SELECT d, factor, weight, direction FROM cov JOIN wt USING (factor))
        SELECT d, code, round(CASE WHEN sum(weight) > 0 THEN sum(weight * direction * z) / sum(weight) END, 6) AS score, count(weight) AS n_factors
        FROM z LEFT JOIN us USING (d, factor) GROUP BY d, code""",
    "ic_series": f"""{ALL}, pr AS (SELECT d, reversal_20 AS x, fwd AS y,
          rank() OVER (PARTITION BY d ORDER BY reversal_20) + (count(*) OVER (PARTITION BY d, reversal_20) - 1) / 2.0 AS rx,
          rank() OVER (PARTITION BY d ORDER BY fwd) + (count(*) OVER (PARTITION BY d, fwd) - 1) / 2.0 AS ry
          FROM expo WHERE reversal_20 IS NOT NULL AND fwd IS NOT NULL)
        SELECT d, count(*) AS n, round(corr(x, y), 6) AS ic, round(corr(rx, ry), 6) AS rank_ic FROM pr GROUP BY d
        HAVING count(*) >= 5 AND stddev_samp(x) > 1e-12 AND stddev_samp(y) > 1e-12""",
    "icir_newey_west": f"""{ALL}, s AS (SELECT row_number() OVER (ORDER BY d) AS i, ic AS v FROM (
          SELECT d, corr(reversal_20, fwd) AS ic FROM expo WHERE reversal_20 IS NOT NULL AND fwd IS NOT NULL GROUP BY d
          HAVING count(*) >= 5 AND stddev_samp(reversal_20) > 1e-12 AND stddev_samp(fwd) > 1e-12)),
        a AS (SELECT count(*) AS n, avg(v) AS m, stddev_samp(v) AS sd, floor(4 * pow(greatest(count(*), 1) / 100.0, 2.0 / 9)) AS lags FROM s),
        g AS (SELECT sum((x.v - m) * (y.v - m) * CASE WHEN x.i = y.i THEN 1 ELSE 2 * (1 - (x.i - y.i) / (lags + 1)) END) AS total
              FROM s x JOIN s y ON x.i >= y.i CROSS JOIN a WHERE x.i - y.i <= lags)
        SELECT n, round(m, 6) AS mean, round(m / sd, 6) AS ir, round(m * sqrt(n) / sd, 6) AS t,
               round(CASE WHEN total > 0 THEN m / sqrt(total / n / n) END, 6) AS nw_t FROM a, g""",
    "layer_returns": f"""{ALL}, l AS (SELECT d, fwd, ((row_number() OVER (PARTITION BY d ORDER BY reversal_20, code) - 1) * 10 // count(*) OVER (PARTITION BY d))::INT AS layer
          FROM expo WHERE reversal_20 IS NOT NULL AND fwd IS NOT NULL)
        SELECT d, layer, round(avg(fwd), 6) AS mean_y, count(*) AS n FROM l GROUP BY d, layer""",
    "layer_summary": f"""{ALL}, l AS (SELECT d, fwd, ((row_number() OVER (PARTITION BY d ORDER BY reversal_20, code) - 1) * 5 // count(*) OVER (PARTITION BY d))::INT AS layer
          FROM expo WHERE reversal_20 IS NOT NULL AND fwd IS NOT NULL),
        t AS (SELECT layer, ln(product(1 + m)) AS total FROM (SELECT d, layer, avg(fwd) AS m FROM l GROUP BY d, layer) GROUP BY layer),
        r AS (SELECT *, rank() OVER (ORDER BY total)::DOUBLE AS r FROM t)
        SELECT layer, round(total, 6) AS total, round((SELECT corr(layer, r) FROM r), 6) AS monotonicity,
               round((SELECT total FROM t WHERE layer = 0) - (SELECT total FROM t WHERE layer = 4), 6) AS low_minus_high FROM r""",
    "momentum_picks": f"""{ALL.replace('expo AS (', 'expo0 AS (')}, expo AS (SELECT * FROM expo0 WHERE reversal_20 IS NOT NULL), {process_sql('reversal_20')},
        c AS (SELECT d, code, sector, round(v, 6) AS score FROM std),
        g AS (SELECT *, row_number() OVER (PARTITION BY d, sector ORDER BY score DESC, code) AS g FROM c)
        SELECT d, code, sector, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, code) AS rank FROM g WHERE g <= 3) WHERE rank <= 10""",
    "drift_turnover": f"""{ALL}, t AS (SELECT d, code, coalesce(fwd, 0) AS r, row_number() OVER (PARTITION BY d ORDER BY round(reversal_20, 9) DESC, code) AS k,
            dense_rank() OVER (ORDER BY d) AS at_ FROM expo WHERE reversal_20 IS NOT NULL),
        h AS (SELECT at_ AS a, code, r, 1.0::DOUBLE / count(*) OVER (PARTITION BY at_) AS w FROM t WHERE k <= 20),
        o AS (SELECT a + 1 AS a, code, w * (1 + r) / (1 + sum(w * r) OVER (PARTITION BY a)) AS w0 FROM h)
        SELECT coalesce(h.a, o.a) AS "at", round(sum(abs(coalesce(w, 0) - coalesce(w0, 0))), 6) AS turnover
        FROM h FULL JOIN o ON h.a = o.a AND h.code = o.code
        WHERE coalesce(h.a, o.a) > (SELECT min(a) FROM h) AND coalesce(h.a, o.a) <= (SELECT max(a) FROM h) GROUP BY 1""",
}
