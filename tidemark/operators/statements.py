"""Cumulative statements: single quarters, trailing twelve months, growth and surprise.

Periods are looked up by their key q (year * 4 + quarter), never by position: a range frame of one key gives
null where a quarter is missing and not a neighbour, and all lookups of a code share one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def earlier(x: str | Column, offset: int) -> Column:
    """x of the period exactly `offset` quarters before, null if there is none."""
    return F.first(x).over(Window.partitionBy("code").orderBy("q").rangeBetween(-offset, -offset))


def single_quarter(st: DataFrame, x: str) -> DataFrame:
    """x_q: the quarter alone; the first of a year is itself, others need their predecessor."""
    return st.withColumn(f"{x}_q", F.when(F.col("q") % 4 == 0, F.col(x)).otherwise(F.col(x) - earlier(x, 1)))


def ttm(st: DataFrame, x: str) -> DataFrame:
    """x_ttm: an annual value as it is; else latest + last full year - same period last year; any missing gives null."""
    part = F.col("q") % 4
    full = F.when(part == 0, earlier(x, 1)).when(part == 1, earlier(x, 2)).when(part == 2, earlier(x, 3))
    return st.withColumn(f"{x}_ttm", F.when(part == 3, F.col(x)).otherwise(F.col(x) + full - earlier(x, 4)))


def yoy(st: DataFrame, x: str) -> DataFrame:
    """x_yoy: growth of the single quarter on the year before, whose base must be over 1 % of the new value's size."""
    a = st.withColumn("_b", earlier(x, 4))
    return a.withColumn(f"{x}_yoy", F.when((F.col("_b") > 0) & (F.col("_b") > 0.01 * F.abs(F.col(x))), F.col(x) / F.col("_b") - 1)).drop("_b")


def sue(st: DataFrame, x: str, n: int = 8) -> DataFrame:
    """x_sue: latest year-on-year change over the deviation of the last n, all of which are needed."""
    w = Window.partitionBy("code").orderBy("q").rangeBetween(-(n - 1), 0)
    d = st.withColumn("_d", F.col(x) - earlier(x, 4))
    sd = F.stddev_samp("_d").over(w)
    enough = (F.count("_d").over(w) == n) & (sd > 1e-9 * F.avg(F.abs("_d")).over(w))
    return d.withColumn(f"{x}_sue", F.when(enough, F.col("_d") / sd)).drop("_d")
