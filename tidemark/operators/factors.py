"""Price, flow and risk factors over a dense panel: window expressions only, one sort per code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import covered, filled, frame




def lagged(x, n: int):
    return F.lag(x, n).over(Window.partitionBy("code").orderBy("ord"))


def with_returns(panel: DataFrame) -> DataFrame:
    """lr: log return of filled prices; rr, rlr: simple and log return where both periods really traded."""
    real = F.when(~F.col("suspended"), F.col("close"))
    before = lagged(real, 1)
    return panel.withColumn("lr", F.ln(F.try_divide(F.col("px"), lagged("px", 1)))).withColumn("rr", F.try_divide(real, before) - 1).withColumn("rlr", F.ln(F.try_divide(real, before)))


def price_factors(panel: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """reversal_20, momentum_120_20, volatility_60, turnover_20, amihud_20, max_ret_20, beside the columns to keep; null without enough observations."""
    p = with_returns(panel)
    turnover = F.when(F.col("vol") > 0, F.col("vol") / 1000)
    illiquid = F.when(F.col("amount") > 0, F.abs("rlr") / F.col("amount"))
    return p.select(
        "code", "d", "ord", *keep,
        covered("close", -(F.try_divide(F.col("px"), lagged("px", 20)) - 1), -20).alias("reversal_20"),
        covered("close", F.try_divide(lagged("px", 20), lagged("px", 120)) - 1, -120, -20).alias("momentum_120_20"),
        covered("close", F.stddev_samp("lr").over(frame(-59)), -60).alias("volatility_60"),
        covered(turnover, F.avg(turnover).over(frame(-19)), -19).alias("turnover_20"),
        covered(illiquid, 1e9 * F.avg(illiquid).over(frame(-19)), -19).alias("amihud_20"),
        covered("rr", F.max("rr").over(frame(-19)), -19).alias("max_ret_20"),
    )


def holding_change(panel: DataFrame, available_from: str | None = None) -> DataFrame:
    """hold_chg_20: change of a filled holding ratio over 20 periods, with 60 % of 21 observations."""
    ratio = F.when(F.col("vol") > 0, F.col("returned") / F.col("vol"))
    p = panel.withColumn("ratio", ratio)
    if available_from:
        p = p.where(F.col("d") >= F.lit(available_from).cast("date"))
    p = p.withColumn("held", filled("ratio"))
    return p.select("code", "d", covered("ratio", F.col("held") - lagged("held", 20), -20).alias("hold_chg_20"))


def market(panel: DataFrame) -> DataFrame:
    """ord, index_lr: log return of the volume-weighted market price."""
    w = Window.partitionBy(F.lit(0)).orderBy("ord")  # one row per period
    index = panel.groupBy("ord").agg(F.try_divide(F.sum("amount"), F.sum("vol")).alias("index"))
    return index.select("ord", F.ln(F.try_divide(F.col("index"), F.lag("index").over(w))).alias("index_lr"))


def beta(panel: DataFrame, periods: int = 250, least: int = 150) -> DataFrame:
    """beta_250: covariance over variance of paired log returns, unfilled, with at least `least` pairs."""
    p = with_returns(panel).join(market(panel), "ord", "left")
    both = F.col("rlr").isNotNull() & F.col("index_lr").isNotNull()
    p = p.withColumn("x", F.when(both, F.col("index_lr"))).withColumn("y", F.when(both, F.col("rlr")))
    w = frame(-(periods - 1))
    value = F.try_divide(F.covar_samp("x", "y").over(w), F.var_samp("x").over(w))
    return p.select("code", "d", F.when(F.count("x").over(w) >= least, value).alias("beta_250"))


def collapse_rare(frame_: DataFrame, label: str, by: str, least: int = 5, other: str = "__OTHER__") -> DataFrame:
    """Labels with fewer than `least` members of a date become `other`."""
    n = F.count("*").over(Window.partitionBy(by, label))
    return frame_.withColumn(label, F.when(n < least, other).otherwise(F.col(label)))
