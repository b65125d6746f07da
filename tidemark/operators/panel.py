"""Calendars and calendar-dense panels: one row per listed code and trading period.

The calendar is small (one row per period) and its ordinals replace date arithmetic: a lookback of n
periods is a row frame once the panel is dense.  Densifying explodes each code's own listing interval,
so no product of codes and dates is built that is then filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """Null for NaN and infinities: missing is never zero and never NaN."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def correlation(x: str, y: str, over=None) -> Column:
    """Pearson correlation of the rows that have both; null, where F.corr() stops, if one of them does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    of = lambda f, *c: f(*[F.when(both, F.col(k)) for k in c]) if over is None else f(*[F.when(both, F.col(k)) for k in c]).over(over)
    return F.try_divide(of(F.covar_pop, x, y), of(F.stddev_pop, x) * of(F.stddev_pop, y))


def bars(lines: DataFrame) -> DataFrame:
    """Weekly bars per supplier from trade lines: close (volume-weighted), high, low, vol, amount, and the part returned."""
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    return lines.select(
        F.col("l_suppkey").alias("code"), F.date_trunc("week", "l_shipdate").cast("date").alias("d"),
        price.alias("p"), "l_quantity", "l_extendedprice", F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0).alias("r"),
    ).groupBy("code", "d").agg(
        F.max("p").alias("high"), F.min("p").alias("low"),
        F.sum("l_quantity").alias("vol"), F.round(F.sum("l_extendedprice"), 2).alias("amount"), F.sum("r").alias("returned"),
    ).withColumn("close", F.try_divide(F.col("amount"), F.col("vol")))


def calendar(dates: DataFrame, d: str = "d") -> DataFrame:
    """d, ord (from 1), prev_d, next_d, month_end, year_end; a row per trading period."""
    w = Window.partitionBy(F.lit(0)).orderBy(d)  # the calendar alone: thousands of rows at most
    following = F.lead(d).over(w)
    return dates.select(d).distinct().select(
        d,
        F.row_number().over(w).cast("long").alias("ord"),
        F.lag(d).over(w).alias("prev_d"),
        following.alias("next_d"),
        (following.isNull() | (F.trunc(following, "month") != F.trunc(d, "month"))).alias("month_end"),
        (following.isNull() | (F.year(following) != F.year(d))).alias("year_end"),
    )


def listing(panel_bars: DataFrame, cal: DataFrame) -> DataFrame:
    """code, first and last ordinal with a bar."""
    return panel_bars.join(cal.select("d", "ord"), "d").groupBy("code").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


def densify(panel_bars: DataFrame, cal: DataFrame) -> DataFrame:
    """A row for every period of each code's listing, with the calendar's month_end; periods without a bar are suspended, with vol and amount 0."""
    grid = listing(panel_bars, cal).select("code", F.explode(F.sequence("first_ord", "last_ord")).alias("ord"))
    dense = grid.join(cal.select("ord", "d", "month_end"), "ord").join(panel_bars, ["code", "d"], "left")
    return dense.withColumn("suspended", F.col("close").isNull()).fillna(0.0, ["vol", "amount", "returned"])


def filled(x: str | Column, code: str = "code", order: str = "ord", back: int = 30) -> Column:
    """The last value known within `back` rows: a bounded forward fill."""
    return F.last(x, ignorenulls=True).over(Window.partitionBy(code).orderBy(order).rowsBetween(-back, 0))


def frame(first: int, last: int = 0, code: str = "code", order: str = "ord"):
    return Window.partitionBy(code).orderBy(order).rowsBetween(first, last)


def covered(raw: str | Column, value: Column, first: int, last: int = 0, share: float = 0.6) -> Column:
    """value where at least share of the frame's periods have a raw observation, else null."""
    need = -(-(last - first + 1) * int(share * 100) // 100)
    return F.when(F.count(raw).over(frame(first, last)) >= need, value)


def panel(lines: DataFrame) -> DataFrame:
    """The dense panel with px, the filled close.  Calendar, listings and rows all come of the bars, whose exchange Spark reuses; measured, that is cheaper than storing them."""
    b = bars(lines)
    return densify(b, calendar(b)).withColumn("px", filled("close"))
