"""Composite scores, event calendars and the factor cache, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cross_section as xs
from ..operators import factors as fac
from ..session import few, scratch, scratch_path, stored, table
from ..sources import cache
from .market import ALL, ATTRIBUTES, FACTORS, MONTH, PANEL, RETURNS, attributes, exposures, month_ends, the_panel

#: Dimension: factor, value scored 0, value scored 100, weight in percent.
DIMENSIONS = {"momentum_120_20": (-1.0, 1.0, 30), "reversal_20": (-1.0, 1.0, 25), "volatility_60": (2.0, 0.0, 20), "turnover_20": (0.0, 0.1, 15), "max_ret_20": (10.0, 0.0, 10)}


def composite(spark, sf_dir: str) -> DataFrame:
    """Month ends: each dimension on a line from 0 to 100, clamped, 50 if unknown; their weighted mean and a rating."""
    f = month_ends(fac.price_factors(the_panel(spark, sf_dir), ("month_end",)))
    part = lambda x, lo, hi: F.coalesce(F.greatest(F.least((F.col(x) - lo) / (hi - lo) * 100, F.lit(100.0)), F.lit(0.0)), F.lit(50.0))
    total = None
    for x, (lo, hi, w) in DIMENSIONS.items():
        term = part(x, lo, hi) * w
        total = term if total is None else total + term
    s = total / sum(w for *_, w in DIMENSIONS.values())
    return f.select("code", "d", F.round(s, 6).alias("score"), F.when(s >= 60, "A").when(s >= 45, "B").otherwise("C").alias("rating"))


def announcements(spark, sf_dir: str) -> DataFrame:
    """Per supplier the five next shipments announced after mid 1998, soonest first."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") > F.lit("1998-06-30").cast("timestamp_ntz"))
    days = li.groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))
    rank = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("day"))
    return days.withColumn("rank", rank.cast("long")).where("rank <= 5")


def cached(spark, sf_dir: str, keep: bool = False):
    """(values, cache, valid snapshots): the cache of two factors at month ends: rows of before 1998 from an old snapshot, of 1999 from one no longer valid, some lost."""
    f = month_ends(fac.price_factors(the_panel(spark, sf_dir), ("month_end",)))
    long = f.select("code", "d", F.explode(F.create_map(F.lit("reversal_20"), F.col("reversal_20"), F.lit("max_ret_20"), F.col("max_ret_20"))).alias("factor", "value"))
    long = stored(long, "factor-values") if keep else long  # computed once
    snapshot = F.when(F.year("d") < 1998, "s1").when(F.year("d") == 1999, "gone").otherwise("s2")
    lost = (F.col("code") == 3) & (F.month("d") == 6)
    return long, long.where(~lost & (F.year("d") < 2000)).withColumn("snapshot", snapshot), spark.createDataFrame([("s1",), ("s2",)], "snapshot string")


def cache_hits(spark, sf_dir: str) -> DataFrame:
    long, kept, valid = cached(spark, sf_dir)
    return cache.hits(kept, valid, long.select("d", "code").distinct())


def cache_missing(spark, sf_dir: str) -> DataFrame:
    return cache.days_missing(*cached(spark, sf_dir))


def cache_build(spark, sf_dir: str) -> DataFrame:
    """The cache written as tables, its missing days computed and added, rows of the snapshot no longer valid dropped; read back for one factor and all, by a window of dates."""
    with scratch():
        long, kept, valid = cached(spark, sf_dir, keep=True)
        c = cache.FactorCache(spark, scratch_path(spark, "factor-cache"))
        c.put(kept)
        c.build(long.where(F.year("d") < 2001), valid, lambda days: long.join(few(days), ["factor", "d"]).withColumn("snapshot", F.lit("s2")))
    c.drop_orphans(valid)
    both = c.read(["reversal_20"], "1996-03-01", "2000-06-30").unionByName(c.read(["max_ret_20"], since="1999-01-01"))
    return both.withColumn("value", F.round("value", 6))


def cache_range(spark, sf_dir: str) -> DataFrame:
    """What each snapshot of the cache covers, valid or not: for looking around only."""
    _, kept, _ = cached(spark, sf_dir)
    return kept.groupBy("factor", "snapshot").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.countDistinct("d").alias("n_days"), F.count("*").alias("n"))


def parameter_grid(spark, sf_dir: str) -> DataFrame:
    """Every combination of the values that three fields of the data take (region, priority, return flag), as parameters of a run, with its hash: of the canonical JSON, keys in order, 12 digits; and the values of lines under it.

    The fields have a few values each; a list of each is made, and the lists are taken apart in turn.
    """
    values = lambda t, c: table(spark, sf_dir, t).agg(F.array_sort(F.collect_set(c)))
    lists = [("priority", "orders", "o_orderpriority"), ("region", "region", "r_name"), ("returned", "lineitem", "l_returnflag")]
    grid = spark.range(1)
    for name, t, c in lists:
        grid = grid.select("*", F.explode(F.array(*[F.lit(x) for x in values(t, c).first()[0]])).alias(name))  # a few values each
    grid = grid.select("priority", "region", "returned", F.substring(F.sha2(F.to_json(F.struct("priority", "region", "returned")), 256), 1, 12).alias("param_hash"))
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(attributes(spark, sf_dir), F.col("l_suppkey") == F.col("code"))
    found = j.groupBy(F.col("o_orderpriority").alias("priority"), F.col("sector").alias("region"), F.col("l_returnflag").alias("returned")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"), F.count("*").alias("n"))
    return grid.join(found, ["priority", "region", "returned"], "left").fillna(0, ["n"]).fillna(0.0, ["value"])


def industry_attribution(spark, sf_dir: str) -> DataFrame:
    """The equal-weighted best 20 of each month end by sector: weight against the universe's, and contribution to the return."""
    e = exposures(spark, sf_dir).where(F.col("reversal_20").isNotNull()).withColumn("s", F.round("reversal_20", 9))
    rank = F.row_number().over(Window.partitionBy("d").orderBy(F.col("s").desc(), "code"))
    e = e.withColumn("top", rank <= 20)
    day = Window.partitionBy("d")
    w = F.try_divide(F.when(F.col("top"), 1.0).otherwise(0.0), F.sum(F.col("top").cast("int")).over(day))
    g = e.withColumn("w", w).withColumn("u", 1.0 / F.count("*").over(day)).groupBy("d", "sector")
    return g.agg(F.round(F.sum("w"), 6).alias("weight"), F.round(F.sum("w") - F.sum("u"), 6).alias("exposure"), F.round(F.sum(F.col("w") * F.coalesce("fwd", F.lit(0.0))), 6).alias("contribution"))


def style_premium(spark, sf_dir: str) -> DataFrame:
    """The next return regressed on standardised size z and on z^2 at each month end; the mean of each slope with a Newey-West t.

    Two regressors and an intercept have a closed form in their moments: one aggregate per date, no task holds a date.
    """
    e = exposures(spark, sf_dir).where(F.col("fwd").isNotNull() & F.col("log_mv").isNotNull())
    day = Window.partitionBy("d")
    sd = F.stddev_samp("log_mv").over(day)
    e = e.withColumn("z", F.when(sd > 1e-12, (F.col("log_mv") - F.avg("log_mv").over(day)) / sd)).where(F.col("z").isNotNull()).withColumn("q", F.col("z") * F.col("z"))
    m = e.groupBy("d").agg(F.count("*").alias("n"), F.var_samp("z").alias("zz"), F.var_samp("q").alias("qq"), F.covar_samp("z", "q").alias("zq"), F.covar_samp("z", "fwd").alias("zy"), F.covar_samp("q", "fwd").alias("qy")).where("n >= 5")
    det = F.col("zz") * F.col("qq") - F.col("zq") * F.col("zq")
    m = m.where(det > 1e-12)
    slopes = m.select("d", ((F.col("qq") * F.col("zy") - F.col("zq") * F.col("qy")) / det).alias("z"), ((F.col("zz") * F.col("qy") - F.col("zq") * F.col("zy")) / det).alias("z2"))
    out = None
    for name in ("z", "z2"):
        one = xs.newey_west(slopes, name, "d").select(F.lit(name).alias("term"), "n", *[F.round(c, 6).alias(c) for c in ("mean", "ir", "t", "nw_t")])
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {"industry_attribution": industry_attribution, "style_premium": style_premium, "composite_score": composite, "announcements": announcements, "factor_cache_hits": cache_hits, "factor_cache_missing": cache_missing, "factor_cache_build": cache_build, "factor_cache_range": cache_range, "parameter_grid": parameter_grid}

_TERMS = " + ".join(f"coalesce(greatest(least(({x} - ({lo})::DOUBLE) / ({hi - lo})::DOUBLE * 100, 100), 0), 50) * {w}" for x, (lo, hi, w) in DIMENSIONS.items())
CACHE = f"""WITH {PANEL}, {RETURNS}, {FACTORS}, l AS (SELECT code, d, unnest(['reversal_20', 'max_ret_20']) AS factor FROM fac WHERE d IN {MONTH}),
  c AS (SELECT *, CASE WHEN year(d) < 1998 THEN 's1' WHEN year(d) = 1999 THEN 'gone' ELSE 's2' END AS snapshot FROM l WHERE NOT (code = 3 AND month(d) = 6) AND year(d) < 2000)"""
SQL = {
    "industry_attribution": f"""{ALL}, r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY round(reversal_20, 9) DESC, code) <= 20 AS top FROM expo WHERE reversal_20 IS NOT NULL),
        w AS (SELECT *, CASE WHEN top THEN 1.0::DOUBLE ELSE 0 END / count(CASE WHEN top THEN 1 END) OVER (PARTITION BY d) AS w, 1.0::DOUBLE / count(*) OVER (PARTITION BY d) AS u FROM r)
        SELECT d, sector, round(sum(w), 6) AS weight, round(sum(w) - sum(u), 6) AS exposure, round(sum(w * coalesce(fwd, 0)), 6) AS contribution FROM w GROUP BY ALL""",
    "style_premium": f"""{ALL}, e AS (SELECT d, fwd AS y, (log_mv - avg(log_mv) OVER w) / CASE WHEN stddev_samp(log_mv) OVER w > 1e-12 THEN stddev_samp(log_mv) OVER w END AS z
          FROM expo WHERE fwd IS NOT NULL AND log_mv IS NOT NULL WINDOW w AS (PARTITION BY d)),
        m AS (SELECT d, var_samp(z) AS zz, var_samp(z * z) AS qq, covar_samp(z, z * z) AS zq, covar_samp(z, y) AS zy, covar_samp(z * z, y) AS qy FROM e WHERE z IS NOT NULL GROUP BY d HAVING count(*) >= 5),
        k AS (SELECT d, unnest(['z', 'z2']) AS term, unnest([(qq * zy - zq * qy) / (zz * qq - zq * zq), (zz * qy - zq * zy) / (zz * qq - zq * zq)]) AS v FROM m WHERE zz * qq - zq * zq > 1e-12),
        s AS (SELECT term, v, row_number() OVER (PARTITION BY term ORDER BY d) AS i FROM k),
        a AS (SELECT term, count(*) AS n, avg(v) AS m, stddev_samp(v) AS sd, floor(4 * pow(greatest(count(*), 1) / 100.0, 2.0 / 9)) AS lags FROM s GROUP BY term),
        g AS (SELECT a.term, sum((x.v - m) * (y.v - m) * CASE WHEN x.i = y.i THEN 1 ELSE 2 * (1 - (x.i - y.i) / (lags + 1)) END) AS total
              FROM s x JOIN s y ON x.i >= y.i AND x.term = y.term JOIN a ON a.term = x.term WHERE x.i - y.i <= lags GROUP BY a.term)
        SELECT term, n, round(m, 6) AS mean, round(m / sd, 6) AS ir, round(m * sqrt(n) / sd, 6) AS t, round(CASE WHEN total > 0 THEN m / sqrt(total / n / n) END, 6) AS nw_t FROM a JOIN g USING (term)""",
    "composite_score": f"""WITH {PANEL}, {RETURNS}, {FACTORS}, s AS (SELECT code, d, ({_TERMS}) / 100 AS s FROM fac WHERE d IN {MONTH})
        SELECT code, d, round(s, 6) AS score, CASE WHEN s >= 60 THEN 'A' WHEN s >= 45 THEN 'B' ELSE 'C' END AS rating FROM s""",
    "announcements": """WITH g AS (SELECT l_suppkey, l_shipdate::DATE AS day, count(*) AS n, round(sum(l_extendedprice), 2) AS amount FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-06-30' GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY day) AS rank FROM g) WHERE rank <= 5""",
    "factor_cache_hits": f"""{CACHE}, u AS (SELECT DISTINCT d, code FROM l)
        SELECT factor, d, (SELECT count(*) FROM c x WHERE x.factor = k.factor AND x.d = k.d) AS n,
          NOT EXISTS (SELECT 1 FROM c x WHERE x.factor = k.factor AND x.d = k.d AND snapshot = 'gone')
          AND NOT EXISTS (SELECT 1 FROM u WHERE u.d = k.d AND u.code NOT IN (SELECT code FROM c x WHERE x.factor = k.factor AND x.d = k.d)) AS hit
        FROM (SELECT DISTINCT factor, d FROM c) k""",
    "factor_cache_missing": f"{CACHE} SELECT DISTINCT factor, d FROM l WHERE (factor, d) NOT IN (SELECT (factor, d) FROM c WHERE snapshot <> 'gone')",
    "factor_cache_build": f"""{CACHE.replace("unnest(['reversal_20', 'max_ret_20']) AS factor", "unnest(['reversal_20', 'max_ret_20']) AS factor, unnest([reversal_20, max_ret_20]) AS value")},
        done AS (SELECT DISTINCT factor, d FROM c WHERE snapshot <> 'gone'),
        a AS (SELECT factor, d, code, value, snapshot FROM c WHERE (factor, d) IN (SELECT (factor, d) FROM done)
          UNION ALL SELECT factor, d, code, value, 's2' FROM l WHERE year(d) < 2001 AND (factor, d) NOT IN (SELECT (factor, d) FROM done))
        SELECT factor, d, code, round(value, 6) AS value, snapshot FROM a
        WHERE factor = 'reversal_20' AND d BETWEEN DATE '1996-03-01' AND DATE '2000-06-30' OR factor = 'max_ret_20' AND d >= DATE '1999-01-01'""",
    "factor_cache_range": f"{CACHE} SELECT factor, snapshot, min(d) AS first, max(d) AS last, count(DISTINCT d) AS n_days, count(*) AS n FROM c GROUP BY ALL",
    "parameter_grid": f"""WITH {ATTRIBUTES}, g AS (SELECT priority, region, returned FROM (SELECT DISTINCT o_orderpriority AS priority FROM orders), (SELECT DISTINCT r_name AS region FROM region), (SELECT DISTINCT l_returnflag AS returned FROM lineitem)),
        f AS (SELECT o_orderpriority AS priority, sector AS region, l_returnflag AS returned, round(sum(l_extendedprice), 2) AS value, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN attr ON l_suppkey = code GROUP BY ALL)
        SELECT g.priority, g.region, g.returned, substr(sha256('{{"priority":"' || g.priority || '","region":"' || g.region || '","returned":"' || g.returned || '"}}'), 1, 12) AS param_hash, coalesce(value, 0) AS value, coalesce(n, 0)::BIGINT AS n
        FROM g LEFT JOIN f USING (priority, region, returned)""",
}
