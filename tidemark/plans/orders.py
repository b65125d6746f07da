"""Order plans: what to trade after each month end, why and within which band; and plans within a turnover budget.  With their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cross_section as xs
from ..operators import factors as fac
from ..operators import trading
from ..operators.panel import frame
from ..session import few, stored
from .market import ALL, WEIGHTS, attributes, month_ends, the_panel

#: Codes of a portfolio, those of a sector at most, and the turnover that a plan may use.
HELD, OF_SECTOR, BUDGET = 20, 8, 0.3


def changes(spark, sf_dir: str) -> DataFrame:
    """Per month end and code in the old or the new portfolio: current and target weight, score, contributions, and what the next period's market allows.

    Each month end's target is the best 20 by the weighted factors, 8 of a sector at most, in equal parts; current is the one before.
    """
    p = stored(the_panel(spark, sf_dir), "orders-panel")
    line = Window.partitionBy("code").orderBy("ord")
    m = p.withColumn("before", F.lag("px").over(line)).withColumn("board", F.when(F.col("code") % 3 == 0, "growth").otherwise("main")).withColumn("special", F.col("code") % 7 == 0)
    m = trading.price_limits(m, "before", "board", "special").withColumn("delisted", (F.col("ord") == F.max("ord").over(Window.partitionBy("code"))) & (F.col("code") % 5 == 0)).withColumn("open", F.col("low"))
    m = trading.tradable(m).withColumn("spread", F.avg(F.when(~F.col("suspended") & (F.col("vol") > 0), F.try_divide(F.col("high") - F.col("low"), F.col("before")))).over(frame(-19)))
    nxt = {f"next_{c}": F.lead(c).over(line) for c in ("reason", "can_buy", "can_sell", "limit_down", "limit_up")}
    market = month_ends(m.withColumns(nxt)).select("code", "d", "px", "spread", *nxt)
    f = month_ends(fac.price_factors(p, ("px", "month_end"))).join(attributes(spark, sf_dir).select("code", "sector"), "code")
    scored = stored(xs.contributions(f, WEIGHTS, ["d"]).withColumn("score", F.round("score", 9)).select("d", "code", "sector", "score", "contributions"), "orders-scores")
    dates = scored.where("score is not null").select("d").distinct()
    dates = dates.select("d", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("d")).alias("at"))  # a row per month end
    top = stored(xs.top_capped(scored, "score", "sector", ["d"], HELD, OF_SECTOR).select("d", "code").join(few(dates), "d").select("at", "code"), "orders-top")
    each = F.lit(1.0 / HELD)
    both = top.select("at", "code", each.alias("target")).join(top.select((F.col("at") + 1).alias("at"), "code", each.alias("current")), ["at", "code"], "full").fillna(0.0, ["target", "current"])
    both = both.join(few(dates), "at").where("at > 1").drop("at")
    return both.join(scored.drop("sector"), ["d", "code"], "left").join(market, ["d", "code"], "left")


def order_plan(spark, sf_dir: str) -> DataFrame:
    """Orders of each month end: action, weights, price band of the next period, urgency, and the three factors that speak most for or against.

    A purchase that the next period does not allow is excluded, with the reason; a sale that it does not allow is blocked, and waits.
    """
    c = changes(spark, sf_dir)
    action = F.when(F.col("current") == 0, "BUY").when(F.col("target") == 0, "SELL").otherwise("ADJUST")
    c = c.withColumn("action", action)
    shut = (F.col("action") == "BUY") & ~F.col("next_can_buy")
    stuck = (F.col("action") != "BUY") & ~F.col("next_can_sell")
    urgency = F.when(shut, "excluded").when(stuck, "blocked").otherwise("normal")
    low, high = trading.order_band(F.col("px"), F.col("spread"), F.col("next_limit_down"), F.col("next_limit_up"))
    known = F.col("next_reason").isNotNull() & ~F.coalesce(shut, F.lit(False))
    why = F.array_join(F.transform("contributions", lambda x: F.concat(x["factor"], F.when(x["value"] < 0, "-").otherwise("+"))), ",")
    best = F.get("contributions", 0)["value"]
    return c.select(
        "d", "code", "action", "current", "target", F.when(known, low).alias("low"), F.when(known, high).alias("high"), urgency.alias("urgency"),
        F.when(shut | stuck, F.col("next_reason")).alias("reason"), F.coalesce(why, F.lit("")).alias("factors"), F.round(best, 4).alias("first_contribution"),
    )


def budgeted_fill(spark, sf_dir: str) -> DataFrame:
    """The changes of each month end within a turnover of 0.3: those of every thirteenth code are forced."""
    c = changes(spark, sf_dir).select("d", "code", (F.col("target") - F.col("current") * F.when(F.col("code") % 3 == 0, 0.5).otherwise(1.0)).alias("delta"), "score", (F.col("code") % 13 == 0).alias("forced"))
    done = trading.budgeted(c, ["d"], BUDGET)
    return done.select("d", "code", F.round("delta", 6).alias("delta"), "forced", F.round("fill", 6).alias("fill"))


QUERIES = {"order_plan": order_plan, "budgeted_fill": budgeted_fill}

_Z = ", ".join(f"CASE WHEN stddev_samp({n}) OVER w > 1e-12 THEN {a}::DOUBLE * {b} * ({n} - avg({n}) OVER w) / stddev_samp({n}) OVER w END AS c_{n}" for n, (a, b) in WEIGHTS.items())
_SUM = " + ".join(f"coalesce(c_{n}, 0)" for n in WEIGHTS)
_WEIGHT = " + ".join(f"CASE WHEN c_{n} IS NULL THEN 0 ELSE {a}::DOUBLE END" for n, (a, _) in WEIGHTS.items())
CHANGES = f"""{ALL}, mk AS (SELECT *, lag(px) OVER (PARTITION BY code ORDER BY ord) AS before, CASE WHEN code % 7 = 0 THEN 0.05 WHEN code % 3 = 0 THEN 0.2 ELSE 0.1 END::DOUBLE AS rate, ord = max(ord) OVER (PARTITION BY code) AND code % 5 = 0 AS delisted FROM panel),
lm AS (SELECT *, round((before * (1 + rate))::DECIMAL(20, 6), 2)::DOUBLE AS up, round((before * (1 - rate))::DECIMAL(20, 6), 2)::DOUBLE AS down FROM mk),
rs AS (SELECT *, CASE WHEN delisted THEN 'delisted' WHEN suspended THEN 'suspended' WHEN up IS NULL OR low IS NULL THEN 'limit_unknown' WHEN low >= up - 1e-6 THEN 'limit_up_seal' WHEN low <= down + 1e-6 THEN 'limit_down_seal' ELSE 'ok' END AS reason,
  avg(CASE WHEN NOT suspended AND vol > 0 THEN (high - low) / before END) OVER (PARTITION BY code ORDER BY ord ROWS 19 PRECEDING) AS spread FROM lm),
nx AS (SELECT code, d, px, spread, lead(reason) OVER v AS reason, lead(down) OVER v AS down, lead(up) OVER v AS up FROM rs WINDOW v AS (PARTITION BY code ORDER BY ord)),
zc AS (SELECT d, code, sector, {_Z} FROM expo WINDOW w AS (PARTITION BY d)),
sc AS (SELECT *, round(CASE WHEN {_WEIGHT} > 0 THEN ({_SUM}) / ({_WEIGHT}) END, 9) AS score FROM zc),
dt AS (SELECT d, row_number() OVER (ORDER BY d) AS a FROM (SELECT DISTINCT d FROM sc WHERE score IS NOT NULL)),
gr AS (SELECT *, row_number() OVER (PARTITION BY d, sector ORDER BY score DESC, code) AS g FROM sc WHERE score IS NOT NULL),
tp AS (SELECT a, code FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, code) AS k FROM gr WHERE g <= {OF_SECTOR}) JOIN dt USING (d) WHERE k <= {HELD}),
ch AS (SELECT d, code, target, cur, reason, down, up, px, spread, score, {', '.join(f'c_{n}' for n in WEIGHTS)} FROM (
    SELECT a, code, max(t) AS target, max(c) AS cur FROM (SELECT a, code, 0.05::DOUBLE AS t, 0.0::DOUBLE AS c FROM tp UNION ALL SELECT a + 1, code, 0.0, 0.05::DOUBLE FROM tp) GROUP BY a, code)
  JOIN dt USING (a) LEFT JOIN sc USING (d, code) LEFT JOIN nx USING (d, code) WHERE a > 1)"""
_PARTS = ", ".join(f"{{'size': -abs(c_{n}), 'factor': '{n}', 'value': c_{n}}}" for n in WEIGHTS)
SQL = {
    "order_plan": f"""{CHANGES},
        ac AS (SELECT *, CASE WHEN cur = 0 THEN 'BUY' WHEN target = 0 THEN 'SELL' ELSE 'ADJUST' END AS action, list_sort(list_filter([{_PARTS}], lambda x: x.value IS NOT NULL))[1:3] AS parts FROM ch),
        ug AS (SELECT *, CASE WHEN action = 'BUY' AND reason NOT IN ('ok', 'limit_down_seal') THEN 'excluded' WHEN action <> 'BUY' AND reason NOT IN ('ok', 'limit_up_seal') THEN 'blocked' ELSE 'normal' END AS urgency FROM ac)
        SELECT d, code, action, cur AS current, target,
          CASE WHEN reason IS NOT NULL AND urgency <> 'excluded' AND px > 0 AND spread IS NOT NULL THEN round(greatest(px * (1 - 0.5::DOUBLE * spread), down)::DECIMAL(20, 6), 2)::DOUBLE END AS low,
          CASE WHEN reason IS NOT NULL AND urgency <> 'excluded' AND px > 0 AND spread IS NOT NULL THEN round(least(px * (1 + 0.5::DOUBLE * spread), up)::DECIMAL(20, 6), 2)::DOUBLE END AS high,
          urgency, CASE WHEN urgency <> 'normal' THEN reason END AS reason, coalesce(array_to_string(list_transform(parts, lambda x: x.factor || CASE WHEN x.value < 0 THEN '-' ELSE '+' END), ','), '') AS factors, round(parts[1].value, 4) AS first_contribution FROM ug""",
    "budgeted_fill": f"""{CHANGES},
        t AS (SELECT d, code, target - cur * CASE WHEN code % 3 = 0 THEN 0.5::DOUBLE ELSE 1 END AS delta, score, code % 13 = 0 AS forced FROM ch),
        s AS (SELECT d, greatest(0, {BUDGET}::DOUBLE - coalesce(sum(abs(delta)) FILTER (WHERE forced), 0)) AS room, coalesce(sum(delta) FILTER (WHERE NOT forced), 0) AS net,
          coalesce(sum(delta) FILTER (WHERE NOT forced AND delta > 0), 0) AS buys, coalesce(-sum(delta) FILTER (WHERE NOT forced AND delta < 0), 0) AS sells FROM t GROUP BY d),
        b AS (SELECT d, CASE WHEN net >= 0 THEN net + least(sells, greatest(0, (room - net) / 2)) ELSE least(buys, greatest(0, (room + net) / 2)) END AS bought, net FROM s),
        o AS (SELECT t.*, bought, bought - net AS sold,
            CASE WHEN delta > 0 THEN sum(abs(delta)) OVER (PARTITION BY d, forced, delta > 0 ORDER BY abs(delta) DESC, score DESC NULLS LAST, code ROWS UNBOUNDED PRECEDING)
              ELSE sum(abs(delta)) OVER (PARTITION BY d, forced, delta > 0 ORDER BY abs(delta) DESC, score ASC NULLS FIRST, code ROWS UNBOUNDED PRECEDING) END - abs(delta) AS prior FROM t JOIN b USING (d))
        SELECT d, code, round(delta, 6) AS delta, forced, round(CASE WHEN forced THEN delta WHEN delta > 0 THEN least(greatest(bought - prior, 0), delta) ELSE -least(greatest(sold - prior, 0), -delta) END, 6) AS fill FROM o""",
}
