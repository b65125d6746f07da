"""Universe, tradability, price limits and costs: column expressions, first reason wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cost rates of a trade, shares of its amount; impact is capped.
COMMISSION, STAMP, TRANSFER, IMPACT, IMPACT_CAP = 0.00025, 0.0005, 0.00001, 0.5, 0.003


def tick(x: Column) -> Column:
    """Half-up to 0.01 in decimal arithmetic."""
    return F.round(x.cast("decimal(20,6)"), 2).cast("double")


def price_limits(df: DataFrame, before: str, board: str, special: str) -> DataFrame:
    """limit_up, limit_down by board and status; unknown without a previous close."""
    rate = F.when(F.col(special), 0.05).when(F.col(board) == "growth", 0.2).otherwise(0.1)
    return df.withColumn("limit_up", tick(F.col(before) * (1 + rate))).withColumn("limit_down", tick(F.col(before) * (1 - rate)))


def tradable(df: DataFrame) -> DataFrame:
    """can_buy, can_sell, reason; in order: delisted, suspended, limit_unknown, sealed up, sealed down, ok.

    df: delisted, suspended, open, limit_up, limit_down.
    """
    up, down = F.col("open") >= F.col("limit_up") - 1e-6, F.col("open") <= F.col("limit_down") + 1e-6
    reason = F.when(F.col("delisted"), "delisted").when(F.col("suspended"), "suspended").when(F.col("limit_up").isNull() | F.col("open").isNull(), "limit_unknown").when(up, "limit_up_seal").when(down, "limit_down_seal").otherwise("ok")
    d = df.withColumn("reason", reason)
    return d.withColumn("can_buy", F.col("reason").isin("ok", "limit_down_seal")).withColumn("can_sell", F.col("reason").isin("ok", "limit_up_seal"))


def universe(df: DataFrame, by: str, code: str, checks: list[tuple[str, Column]], liquidity: str, drop: float = 0.2) -> DataFrame:
    """First failed check of each row, in order; survivors lose the least liquid floor(n * drop) of their date."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
    d = df.withColumn("reason", reason)
    w = Window.partitionBy(by, F.col("reason").isNull())
    rank = F.row_number().over(w.orderBy(F.col(liquidity).asc_nulls_first(), code))
    low = F.col("reason").isNull() & (rank <= F.floor(F.count("*").over(w) * drop))
    return d.withColumn("low", low).withColumn("reason", F.when(F.col("low"), "illiquid").otherwise(F.coalesce("reason", F.lit("kept")))).drop("low")


def charged(trades: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """Costs of trades (side, amount, adv20, range20): the impact is capped before it is multiplied; unknown inputs cost the cap."""
    amount = F.col("amount")
    rate = F.coalesce(F.least(F.lit(IMPACT) * F.try_divide(amount, F.when(F.col("adv20") > 0, F.col("adv20"))) * F.col("range20"), F.lit(IMPACT_CAP)), F.lit(IMPACT_CAP))
    t = trades.withColumn("commission", amount * COMMISSION).withColumn("stamp_duty", F.when(F.col("side") == "sell", amount * STAMP).otherwise(0.0)).withColumn("transfer_fee", amount * TRANSFER).withColumn("impact", amount * rate * multiplier)
    return t.withColumn("total_cost", F.col("commission") + F.col("stamp_duty") + F.col("transfer_fee") + F.col("impact"))


def budgeted(trades: DataFrame, by: list[str], budget: float) -> DataFrame:
    """trades (by, code, delta, score, forced) with `fill`: what is done of each change of weight within a turnover budget.

    Forced trades are done in full and use the budget first.  The net of the others is done in full too, as it is what the
    position is to be; the rest of the budget goes to buys and sells in pairs.  On each side trades are filled by
    size, the last perhaps in part; equal ones buy the greater score first and sell the lesser one first, an unknown score being
    least, then go by code.  Sums and running sums of one partition: nothing is gone through in a loop.
    """
    free = F.when(~F.col("forced"), F.col("delta"))
    every = Window.partitionBy(*by)
    total = lambda x: F.coalesce(F.sum(x).over(every), F.lit(0.0))
    t = trades.withColumn("_net", total(free)).withColumn("_buys", total(F.when(free > 0, free))).withColumn("_sells", total(F.when(free < 0, -free)))
    t = t.withColumn("_left", F.greatest(F.lit(0.0), budget - total(F.when(F.col("forced"), F.abs("delta")))))
    zero = F.lit(0.0)
    net, left = F.col("_net"), F.col("_left")
    bought = F.when(net >= 0, net + F.least(F.col("_sells"), F.greatest(zero, (left - net) / 2))).otherwise(F.least(F.col("_buys"), F.greatest(zero, (left + net) / 2)))
    sold = bought - net
    buy, known = F.col("delta") > 0, F.col("score").isNotNull()
    line = Window.partitionBy(*by, "forced", buy).orderBy(F.abs("delta").desc(), F.when(buy, ~known).otherwise(known), F.when(buy, -F.col("score")).otherwise(F.col("score")), "code")
    before = F.coalesce(F.sum(F.abs("delta")).over(line.rowsBetween(Window.unboundedPreceding, -1)), zero)
    done = F.least(F.greatest(F.when(buy, bought).otherwise(sold) - before, zero), F.abs("delta"))
    fill = F.when(F.col("forced"), F.col("delta")).otherwise(F.when(buy, done).otherwise(-done))
    return t.withColumn("fill", fill).drop("_net", "_buys", "_sells", "_left")


def order_band(close: Column, spread: Column, down: Column, up: Column, k: float = 0.5) -> tuple[Column, Column]:
    """(low, high): the close less and plus k times the mean spread, within the limits where these are known, to 0.01; null without a positive close and a spread."""
    ok = (close > 0) & spread.isNotNull()
    return F.when(ok, tick(F.greatest(close * (1 - k * spread), down))), F.when(ok, tick(F.least(close * (1 + k * spread), up)))
