"""Cross-sectional processing and evaluation, all dates at once: every step is keyed by date and factor."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import correlation


def winsorize_mad(df: DataFrame, x: str, by: list[str], n: float = 3.0) -> DataFrame:
    """x clipped to median +- n * 1.4826 * MAD of its group; unchanged where that is 0 or unknown."""
    w = Window.partitionBy(*by)
    a = df.withColumn("_m", F.median(x).over(w))
    a = a.withColumn("_s", F.median(F.abs(F.col(x) - F.col("_m"))).over(w) * 1.4826 * n)
    low, high = F.col("_m") - F.col("_s"), F.col("_m") + F.col("_s")
    return a.withColumn(x, F.when((F.col("_s") > 0) & F.col(x).isNotNull(), F.greatest(F.least(F.col(x), high), low)).otherwise(F.col(x))).drop("_m", "_s")


def zscore(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """(x - mean) / sample deviation; a constant group has none."""
    w = Window.partitionBy(*by)
    sd = F.stddev_samp(x).over(w)
    return df.withColumn(x, F.when(sd > 1e-12, (F.col(x) - F.avg(x).over(w)) / sd))


def neutralize(df: DataFrame, x: str, size: str, group: str, by: list[str], least: int = 30) -> DataFrame:
    """Residual of x on a constant, size and dummies of group, by date.

    With one continuous regressor this is the regression of x on size after both are demeaned within
    groups, so windows suffice; under `least` valid rows, or with size constant within groups, x is unchanged.
    """
    valid = F.col(x).isNotNull() & F.col(size).isNotNull() & F.col(group).isNotNull()
    a = df.withColumn("_v", valid)
    inner, outer = Window.partitionBy(*by, group), Window.partitionBy(*by)
    only = lambda c: F.when(F.col("_v"), F.col(c))
    a = a.withColumn("_y", only(x) - F.avg(only(x)).over(inner)).withColumn("_z", only(size) - F.avg(only(size)).over(inner))
    a = a.withColumn("_zz", F.sum(F.col("_z") * F.col("_z")).over(outer)).withColumn("_zy", F.sum(F.col("_z") * F.col("_y")).over(outer)).withColumn("_n", F.count(only(x)).over(outer))
    fits = (F.col("_n") >= least) & (F.col("_zz") > 1e-9)
    return a.withColumn(x, F.when(fits, F.when(F.col("_v"), F.col("_y") - F.col("_zy") / F.col("_zz") * F.col("_z"))).otherwise(F.col(x))).drop("_v", "_y", "_z", "_zz", "_zy", "_n")


def process(df: DataFrame, x: str, size: str, group: str, by: list[str]) -> DataFrame:
    """Winsorise, neutralise, standardise, then fill what is still unknown with 0: the order is fixed."""
    out = zscore(neutralize(winsorize_mad(df, x, by), x, size, group, by), x, by)
    return out.withColumn(x, F.coalesce(F.col(x), F.lit(0.0)))


def checked_universe(universe: DataFrame, by: str = "d", code: str = "code") -> DataFrame:
    """The universe if it can be used: an error if it is empty, has a null code or date, or a code twice on one date, which regressions would weigh twice."""
    n = universe.groupBy(by, code).agg(F.count("*").alias("n")).agg(F.count("*").alias("n"), F.count_if(F.col(code).isNull() | F.col(by).isNull()).alias("nulls"), F.count_if(F.col("n") > 1).alias("twice")).first()
    if not n.n or n.nulls or n.twice:
        raise ValueError(f"the universe is empty, or has {n.nulls} rows without code or date, or {n.twice} codes more than once")
    return universe


def combine(long: DataFrame, weights: dict[str, tuple[float, int]], min_coverage: float = 0.6) -> DataFrame:
    """Weighted sum of direction * z over the factors of a date that cover enough of it (on raw values).

    long: d, code, factor, raw, z.  A factor with no or too little coverage on a date is left out of both
    numerator and denominator; with none left the score is null.
    """
    spark = long.sparkSession
    w = spark.createDataFrame([(k, float(a), b) for k, (a, b) in weights.items()], "factor string, weight double, direction int")
    cover = long.groupBy("d", "factor").agg((F.count("raw") / F.count("*")).alias("coverage"))
    usable = cover.where((F.col("coverage") > 0) & (F.col("coverage") >= min_coverage)).join(F.broadcast(w), "factor")
    scored = long.join(usable, ["d", "factor"], "left")
    return scored.groupBy("d", "code").agg(F.try_divide(F.sum(F.col("weight") * F.col("direction") * F.col("z")), F.sum("weight")).alias("score"), F.count("weight").cast("long").alias("n_factors"))


def contributions(df: DataFrame, weights: dict[str, tuple[float, int]], by: list[str], top: int = 3) -> DataFrame:
    """df with `score` and `contributions`: of each row's factors, standardised within `by`, the signed parts weight * direction * z.

    score is their sum over the weights of the factors that the row has; contributions are the `top` greatest by magnitude, then by name, as an
    array of (factor, value).  Factors stay side by side, so a row is never taken apart.
    """
    z = df
    for n in weights:
        z = zscore(z.withColumn(f"_{n}", F.col(n)), f"_{n}", by)
    parts = F.filter(F.array(*[F.struct((-F.abs(w * d * F.col(f"_{n}"))).alias("size"), F.lit(n).alias("factor"), (w * d * F.col(f"_{n}")).alias("value"), F.lit(float(w)).alias("weight")) for n, (w, d) in weights.items()]), lambda x: x["value"].isNotNull())
    total = lambda c: F.aggregate("_parts", F.lit(0.0), lambda a, x: a + x[c])
    named = F.transform(F.slice(F.array_sort("_parts"), 1, top), lambda x: F.struct(x["factor"].alias("factor"), x["value"].alias("value")))
    return z.withColumn("_parts", parts).withColumn("score", F.try_divide(total("value"), total("weight"))).withColumn("contributions", named).drop("_parts", *[f"_{n}" for n in weights])


def average_rank(x: str, by: list[str]) -> Column:
    """Rank with ties averaged, nulls apart."""
    w = Window.partitionBy(*by).orderBy(x)
    return F.when(F.col(x).isNotNull(), F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2.0)


def ic_series(df: DataFrame, x: str, y: str, by: list[str], least: int = 5) -> DataFrame:
    """Pearson and rank correlation of x with y per group of at least `least` pairs."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = pairs.withColumn("_rx", average_rank(x, by)).withColumn("_ry", average_rank(y, by))
    agg = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_samp(x).alias("_sx"), F.stddev_samp(y).alias("_sy"), correlation(x, y).alias("ic"), correlation("_rx", "_ry").alias("rank_ic"))
    return agg.where((F.col("n") >= least) & (F.col("_sx") > 1e-12) & (F.col("_sy") > 1e-12)).drop("_sx", "_sy")


def newey_west(series: DataFrame, x: str, order: str, max_lag: int | None = None) -> DataFrame:
    """One row: n, mean, ir, t (naive), nw_t with Bartlett weights; lag floor(4 (n/100)^(2/9)).

    series has one row per date; autocovariances are self-joins on its position, one per lag.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    s = series.where(F.col(x).isNotNull()).select(F.row_number().over(w).alias("i"), F.col(x).alias("v"))
    n, mean, sd = s.agg(F.count("*"), F.avg("v"), F.stddev_samp("v")).first()
    lags = max_lag if max_lag is not None else math.floor(4 * (max(n, 1) / 100) ** (2 / 9))
    c = s.withColumn("c", F.col("v") - F.avg("v").over(Window.partitionBy(F.lit(0))))
    terms = [F.sum(F.col("c") * F.col("c"))]
    for k in range(1, lags + 1):
        c = c.withColumn(f"c{k}", F.lag("c", k).over(Window.partitionBy(F.lit(0)).orderBy("i")))
        terms.append(2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("c") * F.col(f"c{k}")), F.lit(0.0)))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    out = c.agg(F.count("*").cast("long").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), (total / F.count("*")).alias("lrv"))
    return out.select("n", "mean", F.try_divide(F.col("mean"), F.col("sd")).alias("ir"), F.try_divide(F.col("mean") * F.sqrt(F.col("n").cast("double")), F.col("sd")).alias("t"), F.try_divide(F.col("mean"), F.sqrt(F.when(F.col("lrv") > 0, F.col("lrv")) / F.col("n"))).alias("nw_t"))


def layers(df: DataFrame, x: str, y: str, by: list[str], k: int = 10, code: str = "code") -> DataFrame:
    """Mean y of k equal layers by x: layer floor((rank - 1) k / n), which spreads remainders unlike NTILE."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = F.count("*").over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(x, code))
    return pairs.withColumn("layer", F.floor((rank - 1) * k / n).cast("int")).groupBy(*by, "layer").agg(F.avg(y).alias("mean_y"), F.count("*").alias("n"))


def top_capped(df: DataFrame, score: str, group: str, by: list[str], n: int, cap: int, code: str = "code") -> DataFrame:
    """Greedy top n with at most cap per group, in closed form: rank within group up to cap, then rank among those up to n."""
    order = [F.col(score).desc(), F.col(code)]
    inner = df.where(F.col(score).isNotNull()).withColumn("_g", F.row_number().over(Window.partitionBy(*by, group).orderBy(*order))).where(F.col("_g") <= cap)
    return inner.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n).drop("_g")


def drift_turnover(weights: DataFrame) -> DataFrame:
    """Turnover between dates after weights drift with returns.

    weights: at (ordinal of the rebalance), code, w, r (return until the next).  Old weights grow by
    (1 + r) / (1 + portfolio return); codes absent on one side count as weight 0,
    and so do all old ones after a total loss.
    """
    total = weights.groupBy("at").agg(F.sum(F.col("w") * F.col("r")).alias("pr"))
    old = weights.join(total, "at").select((F.col("at") + 1).alias("at"), "code", F.try_divide(F.col("w") * (1 + F.col("r")), 1 + F.col("pr")).alias("w0"))
    first = weights.agg(F.min("at")).first()[0]
    last = weights.agg(F.max("at")).first()[0]
    both = weights.select("at", "code", "w").join(old, ["at", "code"], "full").where((F.col("at") > F.lit(first)) & (F.col("at") <= F.lit(last)))
    return both.groupBy("at").agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)))).alias("turnover"))
