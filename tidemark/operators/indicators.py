"""Technical indicators and risk figures per code over a dense panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import frame


def rsi(panel: DataFrame, n: int = 14) -> DataFrame:
    """rsi: simple means of the last n gains and losses; 100 without losses."""
    d = F.col("px") - F.lag("px").over(Window.partitionBy("code").orderBy("ord"))
    p = panel.withColumn("_d", d)
    w = frame(-(n - 1))
    gain, loss = F.avg(F.greatest("_d", F.lit(0.0))).over(w), F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(w)
    value = F.when(loss <= 1e-12, 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(gain, loss)))
    return p.withColumn("rsi", F.when(F.count("_d").over(w) == n, value)).drop("_d")


def bands(panel: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """sma, upper, lower, and the deviation of px from sma in percent."""
    w = frame(-(n - 1))
    full = F.count("px").over(w) == n
    mean, sd = F.avg("px").over(w), F.stddev_samp("px").over(w)
    return panel.withColumn("sma", F.when(full, mean)).withColumn("upper", F.when(full, mean + k * sd)).withColumn("lower", F.when(full, mean - k * sd)).withColumn("deviation", F.when(full, 100 * (F.try_divide(F.col("px"), mean) - 1)))


def macd(panel: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """code, ord, macd, signal: exponential means seeded with the first price; the signal starts at bar `slow`.

    The recursion is an aggregate over a code's prices in order, which are as many as the calendar has periods.
    """
    held = "struct<e1:double,e2:double,s:double,n:int,out:array<struct<ord:bigint,macd:double,signal:double>>>"

    def step(a, x):
        p = x["px"]
        e1 = F.coalesce(a["e1"] + 2 / (fast + 1) * (p - a["e1"]), p)
        e2 = F.coalesce(a["e2"] + 2 / (slow + 1) * (p - a["e2"]), p)
        m = e1 - e2
        s = F.when(a["n"] >= slow - 1, F.coalesce(a["s"] + 2 / (signal + 1) * (m - a["s"]), m))
        row = F.struct(x["ord"].cast("bigint").alias("ord"), m.alias("macd"), F.coalesce(s, m).alias("signal"))
        return F.struct(e1.alias("e1"), e2.alias("e2"), s.alias("s"), (a["n"] + 1).alias("n"), F.concat(a["out"], F.array(row)).alias("out"))

    none = F.lit(None).cast("double")
    start = F.struct(none.alias("e1"), none.alias("e2"), none.alias("s"), F.lit(0).alias("n"), F.array().cast("array<struct<ord:bigint,macd:double,signal:double>>").alias("out")).cast(held)
    prices = panel.where(F.col("px").isNotNull()).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("ord", "px"))).alias("l"))
    return prices.select("code", F.explode(F.aggregate("l", start, step, lambda a: a["out"])).alias("r")).select("code", "r.*")


def extrema(panel: DataFrame, reach: int = 5) -> DataFrame:
    """Bars that are the highest or lowest of a full centred frame: code, ord, kind, px."""
    w = frame(-reach, reach)
    full = F.count("px").over(w) == 2 * reach + 1
    kind = F.when(full & (F.col("px") == F.max("px").over(w)), "peak").when(full & (F.col("px") == F.min("px").over(w)), "trough")
    return panel.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("code", "ord", "kind", "px")


def volume_profile(panel: DataFrame, buckets: int = 40, top: float = 0.2) -> DataFrame:
    """Volume by equal-width price bucket of each code, and whether it is among the fullest share of buckets."""
    real = panel.where(~F.col("suspended"))
    edges = real.groupBy("code").agg(F.min("px").alias("_lo"), F.max("px").alias("_hi"))
    at = F.least(F.lit(buckets - 1), F.floor(F.try_divide(F.col("px") - F.col("_lo"), (F.col("_hi") - F.col("_lo")) / buckets)))
    v = real.join(edges, "code").withColumn("bucket", F.coalesce(at, F.lit(0)).cast("int")).groupBy("code", "bucket").agg(F.sum("vol").alias("vol"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("code").orderBy(F.col("vol").desc(), "bucket"))
    return v.withColumn("dense", rank <= int(buckets * top))


def zones(levels: Column, tolerance: float = 0.015) -> Column:
    """Zones of an array of levels (px, tag, ...) in order: a price joins while within tolerance of the last zone's running mean.

    An array of (total, lo, hi, touches, tags): the level is total over touches.  The order decides, so this is an aggregate over the array.
    """
    kind = "array<struct<total:double,lo:double,hi:double,touches:bigint,tags:array<string>>>"

    def step(found, x):
        last = F.get(found, F.size(found) - 1)
        joins = F.coalesce(F.abs(x["px"] - last["total"] / last["touches"]) / F.greatest(x["px"], F.lit(1e-9)) <= tolerance, F.lit(False))
        own = F.struct(x["px"].alias("total"), x["px"].alias("lo"), x["px"].alias("hi"), F.lit(1).cast("bigint").alias("touches"), F.array(x["tag"]).alias("tags"))
        more = F.struct((last["total"] + x["px"]).alias("total"), last["lo"].alias("lo"), x["px"].alias("hi"), (last["touches"] + 1).alias("touches"), F.concat(last["tags"], F.array(x["tag"])).alias("tags"))
        return F.when(joins, F.concat(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(found, F.array(own)))

    return F.aggregate(levels, F.array().cast(kind), step)


def level_zones(levels: DataFrame, tolerance: float = 0.015) -> DataFrame:
    """code, level (a zone's mean), lo, hi, touches, strength of levels (code, px, tag: the method that names it); strength counts a zone's distinct tags.

    A code has a few dozen levels.
    """
    named = levels.where(F.col("px").isNotNull()).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("px", "tag"))).alias("l"))
    z = named.select("code", F.explode(zones(F.col("l"), tolerance)).alias("z"))
    return z.select("code", (F.col("z.total") / F.col("z.touches")).alias("level"), "z.lo", "z.hi", "z.touches", F.size(F.array_distinct("z.tags")).cast("bigint").alias("strength"))


def confirmed_levels(bars: DataFrame, back: int = 120, reach: int = 5, buckets: int = 40, tolerance: float = 0.015, near: int = 6, top: int = 3) -> DataFrame:
    """Supports and resistances that several kinds of evidence name: code, side, place (1: nearest), level, lo, hi, strength, touches, tags.

    bars: code, ord, high, low, close, vol; only traded ones, of which the last `back` of a code count.  Evidence: lows (highs) that are the
    least (greatest) of the bars around them; buckets of the typical price, (high + low + close) / 3, with the most volume; means of the last 20, 60
    and 120 closes; the range's ends.  Of the `near` zones nearest to the last close on a side, the `top` strongest stay.
    A code with fewer than 2 * reach + 5 bars has none.

    The bars are read once: swings are window frames over a code's bars, all else two aggregates.
    """
    by = Window.partitionBy("code").orderBy("ord")
    w = bars.withColumn("_back", F.row_number().over(Window.partitionBy("code").orderBy(F.col("ord").desc()))).where(F.col("_back") <= back)
    around, all_of_them = by.rowsBetween(-reach, reach), Window.partitionBy("code")
    full = F.count("*").over(around) == 2 * reach + 1
    w = w.select(
        "code", "ord", "close", "vol", "_back", F.min("low").over(all_of_them).alias("_lo"), F.max("high").over(all_of_them).alias("_hi"), F.count("*").over(all_of_them).alias("_n"), ((F.col("high") + F.col("low") + F.col("close")) / 3).alias("_typical"),
        F.when(full & (F.col("low") == F.min("low").over(around)), F.col("low")).alias("_trough"), F.when(full & (F.col("high") == F.max("high").over(around)), F.col("high")).alias("_peak"),
    ).where(F.col("_n") >= 2 * reach + 5)
    wide = (F.col("_hi") - F.col("_lo")) / buckets
    w = w.withColumn("_bucket", F.least(F.lit(buckets - 1), F.floor(F.try_divide(F.col("_typical") - F.col("_lo"), wide))).cast("int"))
    level = lambda px, tag: F.struct(px.alias("px"), F.lit(tag).alias("tag"))
    # A row for each bucket first, so that the volumes and the rest come of one pass.
    some = lambda c, tag: F.collect_list(F.when(F.col(c).isNotNull(), level(F.col(c), tag)))
    part = w.groupBy("code", "_bucket").agg(
        F.sum("vol").alias("vol"), F.first("_lo").alias("lo"), F.first("_hi").alias("hi"), F.first("_n").alias("n"), some("_trough", "trough").alias("troughs"), some("_peak", "peak").alias("peaks"),
        *[F.sum(F.when(F.col("_back") <= k, F.col("close"))).alias(f"s{k}") for k in (20, 60, 120)], F.max(F.when(F.col("_back") == 1, F.col("close"))).alias("now"),
    )
    g = part.groupBy("code").agg(
        F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("n").alias("n"), F.flatten(F.collect_list("troughs")).alias("troughs"), F.flatten(F.collect_list("peaks")).alias("peaks"),
        *[F.sum(f"s{k}").alias(f"s{k}") for k in (20, 60, 120)], F.max("now").alias("now"), F.array_sort(F.collect_list(F.when(F.col("_bucket").isNotNull(), F.struct((-F.col("vol")).alias("v"), F.col("_bucket").alias("b"))))).alias("v"),
    )
    dense = F.when(F.col("hi") > F.col("lo"), F.transform(F.slice("v", 1, max(1, buckets // 5)), lambda x: level(F.col("lo") + (x["b"] + 0.5) * ((F.col("hi") - F.col("lo")) / buckets), "volume"))).otherwise(F.slice("troughs", 1, 0))
    means = F.filter(F.array(*[level(F.when(F.col("n") >= k, F.col(f"s{k}") / k), f"ma{k}") for k in (20, 60, 120)]), lambda x: x["px"].isNotNull())
    ends = F.array(level(F.col("lo"), "range_low"), level(F.col("hi"), "range_high"))
    rounded = F.transform(F.concat("troughs", "peaks", dense, means, ends), lambda x: F.struct(F.round(x["px"], 9).alias("px"), x["tag"].alias("tag")))
    z = g.select("code", "now", F.explode(zones(F.array_sort(rounded), tolerance)).alias("z"))
    z = z.select("code", F.round("now", 6).alias("now"), F.round(F.col("z.total") / F.col("z.touches"), 6).alias("level"), F.round("z.lo", 6).alias("lo"), F.round("z.hi", 6).alias("hi"), "z.touches", F.array_sort(F.array_distinct("z.tags")).alias("tags"))
    side = F.when(F.col("level") < F.col("now"), "support").when(F.col("level") > F.col("now"), "resistance")
    z = z.withColumn("side", side).where("side is not null").withColumn("strength", F.size("tags").cast("bigint")).withColumn("_far", F.abs(F.col("level") - F.col("now")))
    each = Window.partitionBy("code", "side")
    z = z.withColumn("_k", F.row_number().over(each.orderBy("_far", "level"))).where(F.col("_k") <= near)
    z = z.withColumn("_s", F.row_number().over(each.orderBy(F.col("strength").desc(), "_k"))).where(F.col("_s") <= top)
    place = F.row_number().over(each.orderBy("_k")).cast("bigint")
    return z.select("code", "side", place.alias("place"), "level", "lo", "hi", "strength", "touches", F.array_join("tags", ",").alias("tags"))


def risk_metrics(panel: DataFrame, per_year: int = 52, confidence: float = 0.95) -> DataFrame:
    """Per code: n, annual_return, annual_vol, sharpe, sortino, max_drawdown, var, cvar of simple returns.

    VaR is the observation at int((1 - c) n) of the sorted returns; CVaR the mean of those before it, or of the first.
    """
    w = Window.partitionBy("code").orderBy("ord")
    p = panel.withColumn("r", F.try_divide(F.col("px"), F.lag("px").over(w)) - 1).withColumn("dd", 1 - F.try_divide(F.col("px"), F.max("px").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    p = p.where(F.col("r").isNotNull())
    n, rank = F.count("*").over(Window.partitionBy("code")), F.row_number().over(Window.partitionBy("code").orderBy("r", "ord"))
    p = p.withColumn("k", rank - 1).withColumn("idx", F.floor((1 - confidence + 1e-9) * n))
    root = per_year**0.5
    down = F.stddev_samp(F.when(F.col("r") < 0, F.col("r")))
    return p.groupBy("code").agg(
        F.count("*").alias("n"), (F.avg("r") * per_year).alias("annual_return"), (F.stddev_samp("r") * root).alias("annual_vol"),
        F.try_divide(F.avg("r") * per_year, F.stddev_samp("r") * root).alias("sharpe"), F.try_divide(F.avg("r") * per_year, down * root).alias("sortino"),
        F.max("dd").alias("max_drawdown"), F.max(F.when(F.col("k") == F.col("idx"), F.col("r"))).alias("var"),
        F.avg(F.when(F.col("k") < F.greatest("idx", F.lit(1)), F.col("r"))).alias("cvar"),
    )
