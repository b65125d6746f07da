"""Price histories by source, option expirations, paper accounts, returns between executions and permuted scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import alerts
from ..session import table
from .market import ALL, PANEL, exposures, the_panel

#: Days of a history, and those that a source must have of it to be used.
HISTORY, ENOUGH = 60, 5
CASH = 1_000_000.0


def price_history(spark, sf_dir: str) -> DataFrame:
    """The last 60 days of each supplier's price, from the first of three sources that has five days of it (new, accepted, returned lines), with simple returns."""
    source = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), source.alias("source"), F.col("l_shipdate").cast("date").alias("d"), "l_quantity", "l_extendedprice")
    # Few days of each source are left out of some suppliers', so that they fall back.
    day = li.where(~((F.col("code") % 4 == 1) & (F.col("source") == 1)) & ~((F.col("code") % 8 == 1) & (F.col("source") == 2))).groupBy("code", "source", "d").agg(F.try_divide(F.round(F.sum("l_extendedprice"), 2), F.sum("l_quantity")).alias("close")).where("close is not null")
    by = Window.partitionBy("code", "source")
    rows = day.withColumn("n", F.count("*").over(by)).withColumn("back", F.row_number().over(by.orderBy(F.col("d").desc()))).where((F.col("n") >= ENOUGH) & (F.col("back") <= HISTORY))
    rows = rows.withColumn("best", F.min("source").over(Window.partitionBy("code"))).where("source = best")
    r = F.try_divide(F.col("close"), F.lag("close").over(Window.partitionBy("code").orderBy("d"))) - 1
    return rows.select("code", "d", "source", F.round("close", 6).alias("close"), F.round(r, 6).alias("r"))


def option_expirations(spark, sf_dir: str) -> DataFrame:
    """The expirations of the options (brands of parts), in order, with the strikes, calls and puts of each."""
    p = table(spark, sf_dir, "part")
    call = F.col("p_partkey") % 2 == 0
    e = p.groupBy(F.col("p_brand").alias("expiry")).agg(F.countDistinct("p_size").alias("n_strikes"), F.count_if(call).alias("n_calls"), F.count_if(~call).alias("n_puts"))
    return e.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("expiry")).cast("long"))  # a row per expiry


def placed(df: DataFrame) -> DataFrame:
    """A table's rows with their place in it, a number that goes by file name, then by row."""
    files = sorted(df.inputFiles())
    row = F.col("_metadata.row_index")
    if len(files) < 2:
        return df.select("*", row.alias("place"))
    numbers = df.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), "_file string, _n long")  # a row per file
    found = df.select("*", F.input_file_name().alias("_file"), row.alias("_row")).join(F.broadcast(numbers), "_file", "left")
    return found.withColumn("place", F.shiftleft("_n", 40) + F.col("_row")).drop("_file", "_n", "_row")


def paper_account(spark, sf_dir: str) -> DataFrame:
    """Per customer: cash, market value, equity and unrealised profit of a paper account that bought the lines it accepted and sold those it returned.

    A purchase raises the average cost, a sale leaves it and is of no more than is held.  A part without a quote (every tenth) is valued at its average cost.
    Trades of one customer and part are few, and are gone through in order within their array; those alike in day, order and line number
    follow one another as they stand in the table: by file name, then by row.
    """
    li, o = placed(table(spark, sf_dir, "lineitem")), table(spark, sf_dir, "orders")
    price = F.coalesce(F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")), F.lit(0.0))
    t = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    # Parts are taken as a hundred symbols, so that there is something to sell.
    trade = F.struct(F.col("l_shipdate").alias("at"), "l_orderkey", "l_linenumber", "place", (F.col("l_returnflag") == "R").alias("sell"), F.col("l_quantity").alias("q"), price.alias("p"))
    t = t.groupBy("o_custkey", (F.col("l_partkey") % 100).alias("symbol")).agg(F.array_sort(F.collect_list(trade)).alias("l"))
    zero = F.lit(0.0)

    def step(a, x):
        sold = F.when(x["sell"], F.least(x["q"], a["qty"])).otherwise(zero)
        bought = F.when(x["sell"], zero).otherwise(x["q"])
        cost = a["cost"] + bought * x["p"] - sold * F.coalesce(F.try_divide(a["cost"], a["qty"]), zero)
        return F.struct((a["qty"] + bought - sold).alias("qty"), F.when(a["qty"] + bought - sold > 0, cost).otherwise(zero).alias("cost"), (a["cash"] - bought * x["p"] + sold * x["p"]).alias("cash"))

    held = t.select("o_custkey", "symbol", F.aggregate("l", F.struct(zero.alias("qty"), zero.alias("cost"), zero.alias("cash")), step).alias("a")).select("o_custkey", "symbol", "a.*")
    quotes = table(spark, sf_dir, "part").where("p_partkey < 100 and p_partkey % 10 <> 0").select(F.col("p_partkey").alias("symbol"), F.col("p_retailprice").alias("quote"))
    v = held.join(quotes, "symbol", "left").withColumn("value", F.when(F.col("qty") > 0, F.coalesce(F.col("quote") * F.col("qty"), F.col("cost"))).otherwise(0.0))
    exact = lambda x: F.sum(x.cast("decimal(20,8)"))  # noqa: E731  # in any order the same
    g = v.groupBy("o_custkey").agg((exact(F.col("cash")) + F.lit(CASH).cast("decimal(20,8)")).alias("cash"), exact(F.col("value")).alias("value"), exact(F.col("cost")).alias("cost"), F.count_if(F.col("qty") > 0).alias("n_positions"))
    cents = lambda x, name: F.round(x, 2).cast("double").alias(name)
    value = F.col("value")
    return g.select("o_custkey", cents(F.col("cash"), "cash"), cents(value, "market_value"), cents(F.col("cash") + value, "equity"), cents(value - F.col("cost"), "unrealised"), "n_positions")


def execution_returns(spark, sf_dir: str) -> DataFrame:
    """The return of each code from the period after a month end, where a plan is carried out, to the period after the next: from one opening (the low) to the other."""
    line = Window.partitionBy("code").orderBy("ord")
    p = the_panel(spark, sf_dir).withColumn("opens", F.coalesce(F.lead("low").over(line), F.lead("px").over(line))).where("month_end")
    return p.select("code", "d", F.round(F.try_divide(F.lead("opens").over(line), F.col("opens")) - 1, 6).alias("r"))


def permuted_scores(spark, sf_dir: str) -> DataFrame:
    """Each month end's scores dealt anew among its codes, by a digest of seed, date and code: the null of a permutation test."""
    e = exposures(spark, sf_dir).where(F.col("reversal_20").isNotNull()).select("d", "code", F.round("reversal_20", 6).alias("score"))
    day = Window.partitionBy("d")
    e = e.withColumn("k", F.row_number().over(day.orderBy("code"))).withColumn("m", F.row_number().over(day.orderBy(F.md5(F.concat_ws("|", F.lit("7"), F.col("d").cast("string"), F.col("code").cast("string"))), "code")))
    return e.select("d", "code", "k", "score").join(e.select("d", F.col("m").alias("k"), F.col("score").alias("permuted")), ["d", "k"]).select("d", "code", "score", "permuted")


def alert_rules(spark, sf_dir: str) -> DataFrame:
    """Alerts that users make, delete and leave (signups: a threshold on one of fifty symbols, a third deleted some days later), over quotes (views, clicks): which quote fired each, and what became of it."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value", (F.col("user_id") % 50).alias("symbol"))
    op = F.when(F.col("event_id") % 2 == 0, ">=").otherwise("<=")
    x = F.when(F.col("event_id") % 2 == 0, F.col("value") + 60).otherwise(F.col("value") / 20)
    deleted = F.when(F.col("event_id") % 3 == 0, F.timestamp_add("DAY", (F.col("event_id") % 10).cast("int"), "ts"))
    rules = e.where("event_type = 'signup'").select(F.col("event_id").alias("rule_id"), "symbol", op.alias("op"), x.alias("x"), F.col("ts").alias("created"), deleted.alias("deleted"))
    quotes = e.where("event_type IN ('view', 'click')").select(F.col("event_id").alias("quote_id"), "symbol", F.col("ts").alias("at"), F.col("value").alias("price"))
    return alerts.fired(rules, quotes).select("rule_id", "symbol", "op", "status", "quote_id")


QUERIES = {"alert_rules": alert_rules, "price_history": price_history, "option_expirations": option_expirations, "paper_account": paper_account, "execution_returns": execution_returns, "permuted_scores": permuted_scores}

SQL = {
    "alert_rules": """WITH e AS (SELECT *, user_id % 50 AS symbol FROM events),
        r AS (SELECT event_id AS rule_id, symbol, CASE WHEN event_id % 2 = 0 THEN '>=' ELSE '<=' END AS op, CASE WHEN event_id % 2 = 0 THEN value + 60 ELSE value / 20 END AS x, ts AS created,
          CASE WHEN event_id % 3 = 0 THEN ts + to_days((event_id % 10)::INT) END AS deleted FROM e WHERE event_type = 'signup'),
        h AS (SELECT rule_id, min({'t': ts, 'q': event_id}).q AS quote_id FROM r JOIN e ON e.symbol = r.symbol AND event_type IN ('view', 'click') AND ts > created AND (deleted IS NULL OR ts < deleted)
          AND CASE WHEN op = '>=' THEN value >= x ELSE value <= x END GROUP BY rule_id)
        SELECT rule_id, symbol, op, CASE WHEN quote_id IS NOT NULL THEN 'triggered' WHEN deleted IS NOT NULL THEN 'deleted' ELSE 'active' END AS status, quote_id FROM r LEFT JOIN h USING (rule_id)""",
    "price_history": f"""WITH l AS (SELECT l_suppkey AS code, CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS source, l_shipdate::DATE AS d, l_quantity AS q, l_extendedprice AS x FROM lineitem),
        g AS (SELECT code, source, d, round(sum(x), 2) / sum(q) AS close FROM l WHERE NOT (code % 4 = 1 AND source = 1) AND NOT (code % 8 = 1 AND source = 2) GROUP BY ALL),
        n AS (SELECT *, count(*) OVER (PARTITION BY code, source) AS n, row_number() OVER (PARTITION BY code, source ORDER BY d DESC) AS back FROM g),
        b AS (SELECT * FROM n WHERE n >= {ENOUGH} AND back <= {HISTORY} QUALIFY source = min(source) OVER (PARTITION BY code))
        SELECT code, d, source, round(close, 6) AS close, round(close / lag(close) OVER (PARTITION BY code ORDER BY d) - 1, 6) AS r FROM b""",
    "option_expirations": """SELECT p_brand AS expiry, count(DISTINCT p_size) AS n_strikes, count(*) FILTER (WHERE p_partkey % 2 = 0) AS n_calls, count(*) FILTER (WHERE p_partkey % 2 <> 0) AS n_puts,
        row_number() OVER (ORDER BY p_brand) AS place FROM part GROUP BY p_brand""",
    "paper_account": f"""WITH t AS (SELECT o_custkey, l_partkey % 100 AS symbol, list({{'sell': l_returnflag = 'R', 'q': l_quantity, 'p': coalesce(l_extendedprice / nullif(l_quantity, 0), 0), 'qty': 0.0::DOUBLE, 'cost': 0.0::DOUBLE, 'cash': 0.0::DOUBLE}}
            ORDER BY l_shipdate, l_orderkey, l_linenumber) AS l FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
        z AS (SELECT o_custkey, symbol, list_reduce(list_prepend({{'sell': false, 'q': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'qty': 0.0::DOUBLE, 'cost': 0.0::DOUBLE, 'cash': 0.0::DOUBLE}}, l), lambda a, x: {{'sell': false, 'q': 0.0::DOUBLE, 'p': 0.0::DOUBLE,
            'qty': CASE WHEN x.sell THEN a.qty - least(x.q, a.qty) ELSE a.qty + x.q END,
            'cost': CASE WHEN NOT x.sell THEN a.cost + x.q * x.p WHEN a.qty - least(x.q, a.qty) > 0 THEN a.cost - least(x.q, a.qty) * (a.cost / a.qty) ELSE 0.0::DOUBLE END,
            'cash': CASE WHEN x.sell THEN a.cash + least(x.q, a.qty) * x.p ELSE a.cash - x.q * x.p END}}) AS a FROM t),
        v AS (SELECT o_custkey, a.cash::DECIMAL(20, 8) AS cash, a.cost::DECIMAL(20, 8) AS cost, a.qty AS qty, (CASE WHEN a.qty > 0 THEN coalesce(CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice * a.qty END, a.cost) ELSE 0 END)::DECIMAL(20, 8) AS value FROM z LEFT JOIN part ON p_partkey = symbol)
        SELECT o_custkey, round({CASH}::DECIMAL(20, 8) + sum(cash), 2)::DOUBLE AS cash, round(sum(value), 2)::DOUBLE AS market_value, round({CASH}::DECIMAL(20, 8) + sum(cash) + sum(value), 2)::DOUBLE AS equity, round(sum(value) - sum(cost), 2)::DOUBLE AS unrealised, count(*) FILTER (WHERE qty > 0) AS n_positions FROM v GROUP BY 1""",
    "execution_returns": f"""WITH {PANEL}, o AS (SELECT code, ord, d, coalesce(lead(low) OVER w, lead(px) OVER w) AS opens FROM panel WINDOW w AS (PARTITION BY code ORDER BY ord))
        SELECT code, d, round(lead(opens) OVER (PARTITION BY code ORDER BY ord) / opens - 1, 6) AS r FROM o WHERE d IN (SELECT max(d) FROM cal GROUP BY date_trunc('month', d))""",
    "permuted_scores": f"""{ALL}, e AS (SELECT d, code, round(reversal_20, 6) AS score, row_number() OVER (PARTITION BY d ORDER BY code) AS k, row_number() OVER (PARTITION BY d ORDER BY md5('7|' || d || '|' || code), code) AS m FROM expo WHERE reversal_20 IS NOT NULL)
        SELECT a.d, a.code, a.score, b.score AS permuted FROM e a JOIN e b ON a.d = b.d AND a.k = b.m""",
}
