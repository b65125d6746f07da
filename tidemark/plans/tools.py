"""Ad-hoc analysis: indicators, risk, options, documents, vectors, alerts, screens; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import options
from ..operators import indicators as ind
from ..operators import retrieval
from ..operators.panel import correlation
from ..session import table
from .market import ATTRIBUTES, PANEL, attributes, the_panel


def rounded(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in df.columns if c not in keys])


def technicals(spark, sf_dir: str) -> DataFrame:
    p = ind.bands(ind.rsi(the_panel(spark, sf_dir)))
    return rounded(p.select("code", "d", "rsi", "sma", "upper", "lower", "deviation"), ["code", "d"], 4)


def macd(spark, sf_dir: str) -> DataFrame:
    return rounded(ind.macd(the_panel(spark, sf_dir)), ["code", "ord"])


def risk(spark, sf_dir: str) -> DataFrame:
    return rounded(ind.risk_metrics(the_panel(spark, sf_dir)), ["code", "n"])


def local_extrema(spark, sf_dir: str) -> DataFrame:
    return ind.extrema(the_panel(spark, sf_dir))


def volume_profile(spark, sf_dir: str) -> DataFrame:
    return ind.volume_profile(the_panel(spark, sf_dir))


def nation_returns(spark, sf_dir: str) -> DataFrame:
    """Log returns of each nation's volume-weighted price: name, ord, r; as many names as nations."""
    p = the_panel(spark, sf_dir).join(attributes(spark, sf_dir).select("code", "industry"), "code")
    i = p.groupBy("industry", "ord").agg(F.try_divide(F.sum("amount"), F.sum("vol")).alias("px")).where(F.col("px").isNotNull())
    r = F.ln(F.try_divide(F.col("px"), F.lag("px").over(Window.partitionBy("industry").orderBy("ord"))))
    return i.select(F.col("industry").alias("name"), "ord", r.alias("r")).where(F.col("r").isNotNull())


def correlations(spark, sf_dir: str) -> DataFrame:
    """Correlation of every two nations' returns, and whether it is strong."""
    r = nation_returns(spark, sf_dir)
    other = r.select(F.col("name").alias("other"), "ord", F.col("r").alias("s"))
    c = r.join(other, "ord").where(F.col("name") < F.col("other")).groupBy("name", "other").agg(correlation("r", "s").alias("c"), F.count("*").alias("n"))
    return c.select("name", "other", "n", F.round("c", 6).alias("c"), (F.abs("c") >= 0.7).alias("strong"))


def portfolio_weights(spark, sf_dir: str) -> DataFrame:
    """Equal, inverse-volatility, minimum-variance and long-only maximum-Sharpe weights of the nations.

    Spark computes the covariances; the system of as many equations as nations is solved on the driver.
    """
    import numpy as np

    r = nation_returns(spark, sf_dir)
    other = r.select(F.col("name").alias("other"), "ord", F.col("r").alias("s"))
    rows = r.join(other, "ord").groupBy("name", "other").agg(F.covar_samp("r", "s").alias("c"), F.avg("r").alias("m")).collect()
    names = sorted({x.name for x in rows})
    at = {n: i for i, n in enumerate(names)}
    cov, mean = np.zeros((len(names), len(names))), np.zeros(len(names))
    for x in rows:
        cov[at[x.name], at[x.other]] = x.c or 0.0
        if x.name == x.other:
            mean[at[x.name]] = x.m
    cov = (cov + cov.T) / 2
    one, inverse = np.ones(len(names)), np.linalg.pinv(cov)
    tangent = np.clip(inverse @ (mean - 0.02 / 52), 0, None)
    vol = 1 / np.sqrt(np.maximum(np.diag(cov), 1e-12))
    w = {"equal": one, "inverse_vol": vol, "min_variance": inverse @ one, "max_sharpe": tangent if tangent.sum() > 0 else one}
    return spark.createDataFrame([(k, n, float(round(x, 6))) for k, v in w.items() for n, x in zip(names, v / v.sum(), strict=True)], "method string, name string, weight double")


def option_figures(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("spot"), (F.floor(F.col("p_retailprice") / 50) * 50 + 25).cast("double").alias("strike"), ((F.col("p_size") + 5) / 52.0).alias("years"), F.lit(0.03).alias("rate"), (0.15 + F.col("p_size") / 100.0).alias("vol"))
    call, put = options.priced(p, True), options.priced(p, False)
    return rounded(call.withColumn("kind", F.lit("call")).unionByName(put.withColumn("kind", F.lit("put"))), ["p_partkey", "kind"])


def option_chain(spark, sf_dir: str) -> DataFrame:
    """Rows of calls and puts to one row per expiry and strike, the 11 strikes nearest the money."""
    p = table(spark, sf_dir, "part")
    quote = p.select(F.col("p_brand").alias("expiry"), F.col("p_size").alias("strike"), F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put").alias("kind"), "p_retailprice")
    wide = quote.groupBy("expiry", "strike").pivot("kind", ["call", "put"]).agg(F.max("p_retailprice"))
    near = F.row_number().over(Window.partitionBy("expiry").orderBy(F.abs(F.col("strike") - 25), "strike"))
    return wide.withColumn("near", near).where("near <= 11").select("expiry", "strike", "call", "put")


def risk_gate(spark, sf_dir: str) -> DataFrame:
    """Orders through pre-trade rules: all the reasons against each, in the rules' order."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    day = Window.partitionBy("o_custkey", F.col("o_orderdate").cast("date"))
    j = j.withColumn("n_day", F.count("*").over(day)).withColumn("sum_day", F.sum("o_totalprice").over(day))
    rules = [
        ("unknown_account", F.col("c_custkey").isNull()), ("not_positive", F.col("o_totalprice") <= 0), ("order_size", F.col("o_totalprice") > 200000),
        ("no_funds", F.col("c_acctbal") < 0), ("daily_count", F.col("n_day") > 1), ("daily_amount", F.col("sum_day") > 250000), ("segment_barred", F.col("c_mktsegment") == "MACHINERY"),
    ]
    reasons = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules]), lambda x: x.isNotNull())
    return j.select("o_orderkey", reasons.alias("r")).select("o_orderkey", (F.size("r") == 0).alias("allowed"), F.array_join("r", ",").alias("reasons"))


def portfolio_summary(spark, sf_dir: str) -> DataFrame:
    """Per customer: cost, value at the current price, profit and its share of cost."""
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    price = F.coalesce("p_retailprice", F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")))
    g = j.groupBy("o_custkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("cost"), F.round(F.sum(F.col("l_quantity") * price), 2).alias("value"), F.countDistinct("l_partkey").alias("n_positions"))
    return g.select("o_custkey", "cost", "value", "n_positions", F.round(F.col("value") - F.col("cost"), 2).alias("pnl"), F.round(100 * F.try_divide(F.col("value") - F.col("cost"), F.col("cost")), 4).alias("pnl_pct"))


#: Alert conditions as users write them; anything that is not `variable operator number` never fires.
CONDITIONS = ["value >= 480.5", "value<5", "user_id == 17", "value != 100", "drop table x", "event_id > abc"]


def condition_holds(df: DataFrame, condition: str = "condition") -> DataFrame:
    """`fires` for each row's own condition: parsed, compared by one of six operators, never evaluated as code."""
    part = lambda i: F.regexp_extract(condition, r"^\s*([a-z_]+)\s*(>=|<=|==|!=|>|<)\s*(-?[0-9]+(?:\.[0-9]+)?)\s*$", i)
    left = F.when(part(1) == "value", F.col("value")).when(part(1) == "user_id", F.col("user_id").cast("double")).when(part(1) == "event_id", F.col("event_id").cast("double"))
    d = df.withColumn("_x", left).withColumn("_op", part(2)).withColumn("_n", part(3).try_cast("double"))
    x, n, op = F.col("_x"), F.col("_n"), F.col("_op")
    fires = F.when(op == ">=", x >= n).when(op == "<=", x <= n).when(op == ">", x > n).when(op == "<", x < n).when(op == "==", x == n).when(op == "!=", x != n)
    return d.withColumn("fires", F.coalesce(fires, F.lit(False))).drop("_x", "_op", "_n")


def alerts(spark, sf_dir: str) -> DataFrame:
    """Each user's first event that fires each condition."""
    e = table(spark, sf_dir, "events").withColumn("condition", F.explode(F.array(*map(F.lit, CONDITIONS))))
    hit = condition_holds(e).where("fires")
    return hit.groupBy("condition", "user_id").agg(F.min(F.struct("ts", "event_id")).alias("first"), F.count("*").alias("n")).select("condition", "user_id", F.col("first.event_id").alias("event_id"), "n")


def news(spark, sf_dir: str) -> DataFrame:
    """Documents as news: one per title, scored by source, language and length, the best 50."""
    d = table(spark, sf_dir, "documents").withColumn("title", F.split("text", "\n")[0])
    first = d.groupBy("title").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    score = F.when(F.col("source") == "src0", 3).otherwise(1) + F.when(F.col("lang") == "en", 2).otherwise(0) + F.when(F.col("n_chars") > 2000, 2).when(F.col("n_chars") > 500, 1).otherwise(0)
    return d.join(first, "doc_id").select("doc_id", "source", score.cast("long").alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(50)


def symbol_search(spark, sf_dir: str) -> DataFrame:
    """Customers for the term '12': key begins with it, holds it, or the name does."""
    c = table(spark, sf_dir, "customer").withColumn("key", F.col("c_custkey").cast("string"))
    tier = F.when(F.col("key").startswith("12"), 0).when(F.col("key").contains("12"), 1).when(F.col("c_name").contains("12"), 2)
    return c.withColumn("tier", tier).where(F.col("tier").isNotNull()).select("c_custkey", "c_name", F.col("tier").cast("long").alias("tier"))


def quotes(spark, sf_dir: str) -> DataFrame:
    """Price of each part by priority of source: latest open line, latest returned line, list price."""
    li = table(spark, sf_dir, "lineitem").withColumn("p", F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")))
    last = li.groupBy("l_partkey").agg(*[F.max(F.when(c, F.struct("l_shipdate", "p"))).alias(n) for n, c in (("a", F.col("l_linestatus") == "O"), ("b", F.col("l_returnflag") == "R"))])
    j = table(spark, sf_dir, "part").join(last, F.col("p_partkey") == F.col("l_partkey"), "left")
    return j.select("p_partkey", F.round(F.coalesce("a.p", "b.p", "p_retailprice"), 9).alias("price"), F.when(F.col("a").isNotNull(), "open").when(F.col("b").isNotNull(), "returned").otherwise("list").alias("source"))


def document_chunks(spark, sf_dir: str) -> DataFrame:
    return retrieval.chunks(table(spark, sf_dir, "documents"))


def personal_data(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    counts = retrieval.personal_counts(F.col("text"))
    return d.select("doc_id", *[c.cast("long").alias(k) for k, c in counts.items()], F.md5(retrieval.redacted(F.col("text"))).alias("redacted_md5"))


def nearest_vectors(spark, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(v.where(F.col("vec_id") % 50 == 0), v)


def event_stats(spark, sf_dir: str) -> DataFrame:
    """Memory-style statistics by type, with the events of users not seen in the last 5 days of the table called stale."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    end = e.agg(F.max("ts").alias("end"))
    j = e.join(last, "user_id").crossJoin(F.broadcast(end))  # end is one row
    stale = F.col("last") < F.col("end") - F.expr("INTERVAL 5 DAYS")
    return j.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.min("event_id").alias("first_id"), F.round(F.sum("value"), 2).alias("value"), F.sum("k").alias("k"), F.count_if(stale).alias("n_stale"))


def macro_position(spark, sf_dir: str) -> DataFrame:
    """Monthly order totals: growth on the year before by calendar month, its percentile in 60 months as {0, 1/2, 1}, and the position between 0.3 and 1."""
    o = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    k = o.withColumn("k", (F.year("m") * 12 + F.month("m")).cast("long"))
    one = Window.partitionBy(F.lit(0)).orderBy("k")  # a row per month
    g = k.withColumn("growth", F.try_divide(F.col("total"), F.first("total").over(one.rangeBetween(-12, -12))) - 1).where(F.col("growth").isNotNull())
    seen = F.collect_list("growth").over(one.rowsBetween(-59, 0))
    g = g.withColumn("pct", F.size(F.filter(seen, lambda x: x <= F.col("growth"))) / F.size(seen)).withColumn("n", F.size(seen))
    score = F.when(F.col("n") < 24, 0.5).when(F.col("pct") >= 0.7, 1.0).when(F.col("pct") <= 0.3, 0.0).otherwise(0.5)
    return g.select("m", F.round("growth", 6).alias("growth"), F.round("pct", 6).alias("pct"), score.alias("score"), F.round(0.3 + 0.7 * score, 6).alias("position"), (F.col("n") < 24).alias("short_window"))


QUERIES = {
    "technicals": technicals,
    "macd": macd,
    "risk_metrics": risk,
    "local_extrema": local_extrema,
    "volume_profile": volume_profile,
    "correlations": correlations,
    "portfolio_weights": portfolio_weights,
    "option_figures": option_figures,
    "option_chain": option_chain,
    "risk_gate": risk_gate,
    "portfolio_summary": portfolio_summary,
    "alert_conditions": alerts,
    "news_ranking": news,
    "symbol_search": symbol_search,
    "quote_fallback": quotes,
    "document_chunks": document_chunks,
    "personal_data": personal_data,
    "nearest_vectors": nearest_vectors,
    "event_stats": event_stats,
    "macro_position": macro_position,
}

_EMAIL, _CARD, _IP, _PHONE = (retrieval.PERSONAL[k] for k in ("email", "card", "ip", "phone"))
NATIONS = f"""WITH {PANEL}, {ATTRIBUTES}, ni AS (SELECT industry AS name, ord, sum(amount) / sum(vol) AS px FROM panel JOIN attr USING (code) GROUP BY ALL HAVING sum(vol) > 0),
  nr AS (SELECT name, ord, r FROM (SELECT name, ord, ln(px / lag(px) OVER (PARTITION BY name ORDER BY ord)) AS r FROM ni) WHERE r IS NOT NULL)"""

SQL = {
    "technicals": f"""WITH {PANEL}, x AS (SELECT *, px - lag(px) OVER (PARTITION BY code ORDER BY ord) AS dx FROM panel),
        y AS (SELECT code, d, px, count(dx) OVER a AS n14, avg(greatest(dx, 0)) OVER a AS g, avg(greatest(-dx, 0)) OVER a AS l, count(px) OVER b AS n20, avg(px) OVER b AS m, stddev_samp(px) OVER b AS s
          FROM (SELECT code, d, ord, px, dx FROM x) WINDOW a AS (PARTITION BY code ORDER BY ord ROWS 13 PRECEDING), b AS (PARTITION BY code ORDER BY ord ROWS 19 PRECEDING))
        SELECT code, d, round(CASE WHEN n14 = 14 THEN CASE WHEN l <= 1e-12 THEN 100 ELSE 100 - 100 / (1 + g / l) END END, 4) AS rsi, round(CASE WHEN n20 = 20 THEN m END, 4) AS sma,
          round(CASE WHEN n20 = 20 THEN m + 2 * s END, 4) AS upper, round(CASE WHEN n20 = 20 THEN m - 2 * s END, 4) AS lower, round(CASE WHEN n20 = 20 THEN 100 * (px / m - 1) END, 4) AS deviation FROM y""",
    "macd": f"""WITH RECURSIVE {PANEL}, p AS (SELECT code, ord, px, row_number() OVER (PARTITION BY code ORDER BY ord) AS i FROM panel WHERE px IS NOT NULL),
        r(code, i, ord, e1, e2, s) AS (
          SELECT code, i, ord, px, px, NULL::DOUBLE FROM p WHERE i = 1
          UNION ALL
          SELECT p.code, p.i, p.ord, r.e1 + 2 / 13.0::DOUBLE * (px - r.e1), r.e2 + 2 / 27.0::DOUBLE * (px - r.e2),
            CASE WHEN p.i < 26 THEN NULL WHEN r.s IS NULL THEN (r.e1 + 2 / 13.0::DOUBLE * (px - r.e1)) - (r.e2 + 2 / 27.0::DOUBLE * (px - r.e2))
            ELSE r.s + 0.2::DOUBLE * ((r.e1 + 2 / 13.0::DOUBLE * (px - r.e1)) - (r.e2 + 2 / 27.0::DOUBLE * (px - r.e2)) - r.s) END
          FROM r JOIN p ON p.code = r.code AND p.i = r.i + 1)
        SELECT code, ord, round(e1 - e2, 6) AS macd, round(coalesce(s, e1 - e2), 6) AS signal FROM r""",
    "risk_metrics": f"""WITH {PANEL}, x AS (SELECT code, ord, px / lag(px) OVER w - 1 AS r, 1 - px / max(px) OVER w AS dd FROM panel WINDOW w AS (PARTITION BY code ORDER BY ord)),
        y AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY r, ord) - 1 AS k, floor((1 - 0.95::DOUBLE + 1e-9) * count(*) OVER (PARTITION BY code)) AS idx FROM x WHERE r IS NOT NULL)
        SELECT code, count(*) AS n, round(avg(r) * 52, 6) AS annual_return, round(stddev_samp(r) * sqrt(52), 6) AS annual_vol, round(avg(r) * 52 / (stddev_samp(r) * sqrt(52)), 6) AS sharpe,
          round(avg(r) * 52 / (stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(52)), 6) AS sortino, round(max(dd), 6) AS max_drawdown, round(max(CASE WHEN k = idx THEN r END), 6) AS var,
          round(avg(CASE WHEN k < greatest(idx, 1) THEN r END), 6) AS cvar FROM y GROUP BY code""",
    "local_extrema": f"""WITH {PANEL} SELECT code, ord, kind, px FROM (SELECT code, ord, px, CASE WHEN count(px) OVER w = 11 AND px = max(px) OVER w THEN 'peak' WHEN count(px) OVER w = 11 AND px = min(px) OVER w THEN 'trough' END AS kind
        FROM panel WINDOW w AS (PARTITION BY code ORDER BY ord ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) WHERE kind IS NOT NULL""",
    "volume_profile": f"""WITH {PANEL}, e AS (SELECT code, min(px) AS lo, max(px) AS hi FROM panel WHERE NOT suspended GROUP BY code),
        v AS (SELECT code, CASE WHEN hi > lo THEN least(39, floor((px - lo) / ((hi - lo) / 40))) ELSE 0 END::INT AS bucket, sum(vol) AS vol, count(*) AS n FROM panel JOIN e USING (code) WHERE NOT suspended GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY code ORDER BY vol DESC, bucket) <= 8 AS dense FROM v""",
    "correlations": f"""{NATIONS} SELECT a.name, b.name AS other, count(*) AS n, round(corr(a.r, b.r), 6) AS c, abs(corr(a.r, b.r)) >= 0.7 AS strong FROM nr a JOIN nr b ON a.ord = b.ord AND a.name < b.name GROUP BY ALL""",
    "option_chain": """WITH q AS (SELECT p_brand AS expiry, p_size AS strike, max(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END) AS call, max(CASE WHEN p_partkey % 2 = 1 THEN p_retailprice END) AS put FROM part GROUP BY ALL)
        SELECT expiry, strike, call, put FROM (SELECT *, row_number() OVER (PARTITION BY expiry ORDER BY abs(strike - 25), strike) AS k FROM q) WHERE k <= 11""",
    "risk_gate": """WITH j AS (SELECT *, count(*) OVER w AS n_day, sum(o_totalprice) OVER w AS sum_day FROM orders LEFT JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY o_custkey, o_orderdate::DATE)),
        r AS (SELECT o_orderkey, list_filter([CASE WHEN c_custkey IS NULL THEN 'unknown_account' END, CASE WHEN o_totalprice <= 0 THEN 'not_positive' END, CASE WHEN o_totalprice > 200000 THEN 'order_size' END,
          CASE WHEN c_acctbal < 0 THEN 'no_funds' END, CASE WHEN n_day > 1 THEN 'daily_count' END, CASE WHEN sum_day > 250000 THEN 'daily_amount' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'segment_barred' END], lambda x: x IS NOT NULL) AS r FROM j)
        SELECT o_orderkey, len(r) = 0 AS allowed, array_to_string(r, ',') AS reasons FROM r""",
    "portfolio_summary": """WITH g AS (SELECT o_custkey, round(sum(l_extendedprice), 2) AS cost, round(sum(l_quantity * coalesce(p_retailprice, l_extendedprice / l_quantity)), 2) AS value, count(DISTINCT l_partkey) AS n_positions
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1)
        SELECT *, round(value - cost, 2) AS pnl, round(CASE WHEN cost <> 0 THEN 100 * ((value - cost) / cost) END, 4) AS pnl_pct FROM g""",
    "alert_conditions": """WITH h AS (SELECT 'value >= 480.5' AS condition, * FROM events WHERE value >= 480.5 UNION ALL SELECT 'value<5', * FROM events WHERE value < 5
          UNION ALL SELECT 'user_id == 17', * FROM events WHERE user_id = 17 UNION ALL SELECT 'value != 100', * FROM events WHERE value <> 100)
        SELECT condition, user_id, (min({'ts': ts, 'event_id': event_id})).event_id AS event_id, count(*) AS n FROM h GROUP BY 1, 2""",
    "news_ranking": """WITH d AS (SELECT *, string_split(text, chr(10))[1] AS title FROM documents), f AS (SELECT min(doc_id) AS doc_id FROM d GROUP BY title)
        SELECT doc_id, source, (CASE WHEN source = 'src0' THEN 3 ELSE 1 END + CASE WHEN lang = 'en' THEN 2 ELSE 0 END + CASE WHEN n_chars > 2000 THEN 2 WHEN n_chars > 500 THEN 1 ELSE 0 END)::BIGINT AS score
        FROM d JOIN f USING (doc_id) ORDER BY score DESC, doc_id LIMIT 50""",
    "symbol_search": """SELECT * FROM (SELECT c_custkey, c_name, CASE WHEN starts_with(c_custkey::VARCHAR, '12') THEN 0 WHEN contains(c_custkey::VARCHAR, '12') THEN 1 WHEN contains(c_name, '12') THEN 2 END::BIGINT AS tier FROM customer) WHERE tier IS NOT NULL""",
    "quote_fallback": """WITH l AS (SELECT l_partkey, max(CASE WHEN l_linestatus = 'O' THEN {'a': l_shipdate, 'p': l_extendedprice / l_quantity} END) AS a, max(CASE WHEN l_returnflag = 'R' THEN {'a': l_shipdate, 'p': l_extendedprice / l_quantity} END) AS b FROM lineitem GROUP BY 1)
        SELECT p_partkey, round(coalesce(a.p, b.p, p_retailprice), 9) AS price, CASE WHEN a IS NOT NULL THEN 'open' WHEN b IS NOT NULL THEN 'returned' ELSE 'list' END AS source FROM part LEFT JOIN l ON p_partkey = l_partkey""",
    "personal_data": f"""SELECT doc_id, len(regexp_extract_all(text, '{_EMAIL}'))::BIGINT AS email, len(regexp_extract_all(text, '{_CARD}'))::BIGINT AS card,
        len(regexp_extract_all(text, '{_IP}'))::BIGINT AS ip, len(regexp_extract_all(text, '{_PHONE}'))::BIGINT AS phone,
        md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{_EMAIL}', '[email]', 'g'), '{_CARD}', '[card]', 'g'), '{_IP}', '[ip]', 'g'), '{_PHONE}', '[phone]', 'g')) AS redacted_md5 FROM documents""",
    "nearest_vectors": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "event_stats": """WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), e AS (SELECT *, (props::JSON->>'k')::BIGINT AS k FROM events)
        SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, min(event_id) AS first_id, round(sum(value), 2) AS value, sum(k)::BIGINT AS k,
          count(*) FILTER (WHERE last < (SELECT max(ts) FROM events) - INTERVAL 5 DAY) AS n_stale FROM e JOIN l USING (user_id) GROUP BY 1""",
    "macro_position": """WITH o AS (SELECT date_trunc('month', o_orderdate)::DATE AS m, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1),
        g AS (SELECT a.m, a.total / b.total - 1 AS growth FROM o a JOIN o b ON b.m = a.m - INTERVAL 12 MONTH),
        s AS (SELECT *, list(growth) OVER (ORDER BY m ROWS 59 PRECEDING) AS seen FROM g),
        p AS (SELECT m, growth, len(list_filter(seen, lambda x: x <= growth)) / len(seen) AS pct, len(seen) AS n FROM s),
        q AS (SELECT *, CASE WHEN n < 24 THEN 0.5 WHEN pct >= 0.7 THEN 1 WHEN pct <= 0.3 THEN 0 ELSE 0.5 END::DOUBLE AS score FROM p)
        SELECT m, round(growth, 6) AS growth, round(pct, 6) AS pct, score, round(0.3 + 0.7 * score, 6) AS position, n < 24 AS short_window FROM q""",
}
