"""Point-in-time queries: as-of, interval and bitemporal lookups, statements, universe, trading rules, data checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import asof, statements, trading
from ..operators.panel import bars, calendar, frame, panel
from ..session import scratch, stored, table
from .market import ATTRIBUTES, PANEL, attributes, month_ends, the_panel


def orders(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))


def previous_price(spark, sf_dir: str) -> DataFrame:
    """Each order with the total of the customer's last finished order before its day."""
    o = orders(spark, sf_dir)
    asked = o.select("o_orderkey", "o_custkey", "day")
    done = o.where(F.col("o_orderstatus") == "F").select("o_custkey", F.col("day").alias("t"), F.col("o_totalprice").alias("price"))
    return asof.backward_asof(asked, done, "o_custkey", "day", "t", "price", strict=True)


def status_intervals(spark, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir).groupBy("o_custkey", "day").agg(F.max("o_orderstatus").alias("status"))
    return asof.runs(o, "o_custkey", ["day"], "status", "day")


def status_as_of(spark, sf_dir: str) -> DataFrame:
    """Each customer's status at the end of every year."""
    o = orders(spark, sf_dir)
    years = o.select("o_custkey").distinct().select("o_custkey", F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("y")).select("o_custkey", F.make_date("y", F.lit(12), F.lit(31)).alias("day"))
    return asof.interval_lookup(years, status_intervals(spark, sf_dir), "o_custkey", "day", "start_date", "end_date", "status")


def priority_at_shipment(spark, sf_dir: str) -> DataFrame:
    """Each line with the priority that its customer had when it was shipped, from spans that overlap, hold each other and stay open.

    An order gives its customer its priority from its day on, for up to 400 days; every eleventh order for good.
    """
    o = orders(spark, sf_dir)
    until = F.when(F.col("o_orderkey") % 11 != 0, F.date_add("day", (F.col("o_orderkey") % 401).cast("int")))
    spans = o.select("o_custkey", F.col("day").alias("start_date"), until.alias("end_date"), F.col("o_orderpriority").alias("priority"))
    li = table(spark, sf_dir, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    points = li.select("l_orderkey", "l_linenumber", "o_custkey", F.col("l_shipdate").cast("date").alias("day"))
    return asof.interval_lookup(points, spans, "o_custkey", "day", "start_date", "end_date", "priority")


AS_OF = ("1996-12-31", "1998-06-30", "2000-12-31")


def facts(spark, sf_dir: str) -> DataFrame:
    """code, period (quarter end of the order), ann_date (ship date), flag (1: returned), value."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    period = F.date_sub(F.add_months(F.trunc("o_orderdate", "quarter"), 3), 1)
    return j.select(F.col("l_suppkey").alias("code"), period.alias("period"), F.col("l_shipdate").cast("date").alias("ann_date"), (F.col("l_returnflag") == "R").cast("int").alias("flag"), F.col("l_extendedprice").alias("value"))


def visible_facts(spark, sf_dir: str) -> DataFrame:
    dates = spark.createDataFrame([(d,) for d in AS_OF], "s string").select(F.col("s").cast("date").alias("as_of"))
    return asof.bitemporal_latest(facts(spark, sf_dir), dates)


FIELDS = {"price": "l_extendedprice", "quantity": "l_quantity", "discount": "l_discount"}


def visible_fields(spark, sf_dir: str) -> DataFrame:
    """Three fields of the facts, each visible by its own announcements, side by side: fields are rows until the last step, so nothing is joined.

    A quantity is announced 30 days after the price, a discount not at all where it is 0.
    """
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    period = F.date_sub(F.add_months(F.trunc("o_orderdate", "quarter"), 3), 1)
    day = F.col("l_shipdate").cast("date")
    field = lambda name, at, value: F.struct(F.lit(name).alias("field"), at.alias("ann_date"), value.alias("value"))
    rows = F.explode(F.array(field("price", day, F.col("l_extendedprice")), field("quantity", F.date_add(day, 30), F.col("l_quantity")), field("discount", day, F.when(F.col("l_discount") > 0, F.col("l_discount")))))
    long = j.select(F.col("l_suppkey").alias("code"), period.alias("period"), (F.col("l_returnflag") == "R").cast("int").alias("flag"), rows.alias("f")).select("code", "period", "flag", "f.*")
    dates = spark.createDataFrame([(d,) for d in AS_OF], "s string").select(F.col("s").cast("date").alias("as_of"))
    seen = asof.bitemporal_latest(long, dates, ("code", "period", "field"))
    return seen.groupBy("as_of", "code", "period").pivot("field", list(FIELDS)).agg(F.first("value"))


def name_status(spark, sf_dir: str) -> DataFrame:
    """Status intervals from the names that a customer has had (made up: the order's state is put before it), classified by pattern; a customer without any is normal throughout."""
    o = orders(spark, sf_dir).groupBy("o_custkey", "day").agg(F.max("o_orderstatus").alias("s"))
    name = F.concat(F.when(F.col("s") == "F", "ST ").when(F.col("s") == "P", "*ST ").otherwise(""), F.lit("customer"))
    status = F.when(name.rlike(r"^\*ST"), "warned").when(name.rlike("^ST"), "special").otherwise("normal")
    spans = asof.runs(o.select("o_custkey", "day", status.alias("status")), "o_custkey", ["day"], "status", "day")
    rest = table(spark, sf_dir, "customer").join(spans, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    none = F.lit(None).cast("date")
    return spans.unionByName(rest.select(F.col("c_custkey").alias("o_custkey"), F.lit("normal").alias("status"), none.alias("start_date"), none.alias("end_date")))


def statement_table(spark, sf_dir: str) -> DataFrame:
    """code, q (year * 4 + quarter - 1), cumulative revenue and income within the year."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    q = F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1
    own = j.groupBy(F.col("l_suppkey").alias("code"), q.alias("q")).agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("rev"),
        F.round(F.sum(F.col("l_extendedprice") * (0.12 - F.col("l_discount"))), 4).alias("inc"),
    )
    w = Window.partitionBy("code", F.floor(F.col("q") / 4)).orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    return own.select("code", F.col("q").cast("long").alias("q"), F.round(F.sum("rev").over(w), 4).alias("revenue"), F.round(F.sum("inc").over(w), 4).alias("income"))


STATEMENTS = """
own AS (
  SELECT l_suppkey AS code, (year(o_orderdate) * 4 + quarter(o_orderdate) - 1)::BIGINT AS q,
         round(sum(l_extendedprice * (1 - l_discount)), 4) AS rev, round(sum(l_extendedprice * (0.12::DOUBLE - l_discount)), 4) AS inc
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
st AS (
  SELECT code, q, round(sum(rev) OVER w, 4) AS revenue, round(sum(inc) OVER w, 4) AS income
  FROM own WINDOW w AS (PARTITION BY code, q // 4 ORDER BY q ROWS UNBOUNDED PRECEDING)),
sq AS (
  SELECT s.*, CASE WHEN s.q % 4 = 0 THEN s.income ELSE s.income - p.income END AS income_q FROM st s LEFT JOIN st p ON p.code = s.code AND p.q = s.q - 1),
dl AS (SELECT a.code, a.q, a.income_q - b.income_q AS dq FROM sq a LEFT JOIN sq b ON b.code = a.code AND b.q = a.q - 4)"""


def statement_factors(spark, sf_dir: str) -> DataFrame:
    """Single-quarter income, trailing revenue and income, growth and surprise of every statement."""
    st = statements.single_quarter(statement_table(spark, sf_dir), "income")
    st = statements.ttm(statements.ttm(st, "revenue"), "income")
    st = statements.sue(statements.yoy(st, "income_q"), "income_q")
    r = lambda c, n: F.round(c, n).alias(c)
    return st.select("code", "q", r("income_q", 4), r("revenue_ttm", 4), r("income_ttm", 4), r("income_q_yoy", 6), r("income_q_sue", 6))


def value_factors(spark, sf_dir: str) -> DataFrame:
    """Earnings, sales and book yield, return on equity, gross margin and accruals at month ends, from the statements announced by then (60 days after their quarter).

    Equity is 1e6 + trailing income, assets four times as much; only positive denominators count.  The margin is
    that of the latest statement as announced, in percent: cumulative income over cumulative revenue, without a trailing sum.
    """
    st = statements.ttm(statements.ttm(statement_table(spark, sf_dir), "revenue"), "income")
    quarter_end = F.date_sub(F.add_months(F.make_date(F.floor(F.col("q") / 4).cast("int"), (F.col("q") % 4 * 3 + 1).cast("int"), F.lit(1)), 3), 1)
    st = st.withColumn("ann", F.date_add(quarter_end, 60)).withColumn("equity", 1e6 + F.col("income_ttm"))
    st = st.withColumn("equity0", statements.earlier("equity", 4))
    m = month_ends(the_panel(spark, sf_dir)).join(attributes(spark, sf_dir), "code").select("code", "d", (F.col("px") * F.col("shares")).alias("mv"))
    latest = st.select("code", "ann", F.struct("q", "revenue_ttm", "income_ttm", "revenue", "income", "equity", "equity0").alias("s"))
    best = asof.backward_asof(m, latest, "code", "d", "ann", "s").select("code", "d", "mv", "asof_s.*")
    over = lambda x, y: F.round(F.when(F.col("mv") > 0, x) / F.when(y > 0, y), 6)
    mv, eq = F.col("mv"), F.col("equity")
    mean_eq = F.when((eq > 0) & (F.col("equity0") > 0), (eq + F.col("equity0")) / 2)
    return best.select("code", "d", over(F.col("income_ttm"), mv).alias("ep_ttm"), over(F.col("revenue_ttm"), mv).alias("sp_ttm"), over(eq, mv).alias("bp"), over(F.col("income_ttm"), mean_eq).alias("roe_ttm"), F.round(F.when(F.col("revenue") > 0, 100 * F.col("income") / F.col("revenue")), 6).alias("gross_margin"), over(F.col("income_ttm") - F.col("income"), 4 * eq).alias("accrual"))


def limits_and_mask(spark, sf_dir: str) -> DataFrame:
    p = the_panel(spark, sf_dir)
    before = F.lag("px").over(Window.partitionBy("code").orderBy("ord"))
    p = p.withColumn("before", before).withColumn("board", F.when(F.col("code") % 3 == 0, "growth").otherwise("main")).withColumn("special", F.col("code") % 7 == 0)
    p = trading.price_limits(p, "before", "board", "special")
    last = F.max("ord").over(Window.partitionBy("code"))
    p = p.withColumn("delisted", (F.col("ord") == last) & (F.col("code") % 5 == 0)).withColumn("open", F.col("low"))
    return trading.tradable(p).select("code", "d", "limit_up", "limit_down", "reason", "can_buy", "can_sell")


def universe_steps(spark, sf_dir: str) -> DataFrame:
    """Month ends: listed 26 periods, not suspended, not special, price above 500, then the least liquid fifth goes."""
    p = the_panel(spark, sf_dir)
    p = p.withColumn("age", F.row_number().over(Window.partitionBy("code").orderBy("ord"))).withColumn("adv20", F.avg("amount").over(frame(-19)))
    checks = [("unseasoned", F.col("age") > 26), ("suspended", ~F.col("suspended")), ("special", F.col("code") % 7 != 0), ("penny", F.col("px") > 500)]
    return trading.universe(month_ends(p), "d", "code", checks, "adv20").select("d", "code", "reason")


def trade_costs(spark, sf_dir: str) -> DataFrame:
    """Every real bar as a trade of a tenth of its amount, bought in even weeks; inputs are 20-period means of traded periods before it."""
    p = the_panel(spark, sf_dir)
    real = ~F.col("suspended")
    rng = F.when(real & (F.col("low") > 0), F.col("high") / F.col("low") - 1)
    p = p.withColumn("adv20", F.avg(F.when(real, F.col("amount"))).over(frame(-20, -1))).withColumn("range20", F.avg(rng).over(frame(-20, -1)))
    t = p.where(real).select("code", "d", F.when(F.col("ord") % 2 == 0, "buy").otherwise("sell").alias("side"), (F.col("amount") / 10).alias("amount"), "adv20", "range20")
    return trading.charged(t).select("code", "d", "side", *[F.round(c, 8).alias(c) for c in ("commission", "stamp_duty", "transfer_fee", "impact", "total_cost")])


def publications(spark, sf_dir: str) -> DataFrame:
    """Monthly order totals by priority: indicator, period, publish_date, source, value; first (20 days after the month ends) and revised (50 days, plus 1 %)."""
    o = orders(spark, sf_dir).groupBy(F.substring("o_orderpriority", 1, 1).alias("indicator"), F.last_day("day").alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    pub = o.select("indicator", "period", "value", F.explode(F.array(F.lit(20), F.lit(50))).alias("after"))
    return pub.select("indicator", "period", F.expr("date_add(period, after)").alias("publish_date"), F.when(F.col("after") == 50, "revised").otherwise("first").alias("source"), F.round(F.col("value") * F.when(F.col("after") == 50, 1.01).otherwise(1.0), 1).alias("value"))


def macro_visible(spark, sf_dir: str) -> DataFrame:
    """The latest publication by each as-of date, last 3 periods of each indicator, side by side."""
    pub = publications(spark, sf_dir)
    dates = spark.createDataFrame([(d,) for d in AS_OF], "s string").select(F.col("s").cast("date").alias("as_of"))
    facts = pub.select("indicator", "period", F.col("publish_date").alias("ann_date"), F.lit(0).alias("flag"), "value")
    latest = asof.bitemporal_latest(facts, dates, ("indicator", "period"))
    rank = F.row_number().over(Window.partitionBy("as_of", "indicator").orderBy(F.col("period").desc()))
    top = latest.withColumn("r", rank).where("r <= 3")
    return top.groupBy("as_of", "period").pivot("indicator", ["1", "2", "3", "4", "5"]).agg(F.first("value")).select("as_of", "period", *[F.col(k).alias(f"p{k}") for k in "12345"])


def data_checks(spark, sf_dir: str) -> DataFrame:
    """Data checks over bars and their sources, one row each with severity and the number of offending rows (limit_coverage: traded rows without a limit price).

    The panel is made once and stored; its checks are conditional aggregates of one pass over it.
    """
    li, o = table(spark, sf_dir, "lineitem"), orders(spark, sf_dir)
    with scratch() as scope:
        p = the_panel(spark, sf_dir).select("code", "ord", "d", "px", "vol", "amount", "suspended")
        p = stored(p.withColumn("r", asof.ratio_to_previous(p, "code", "ord", "px")).withColumn("before", F.lag("px").over(Window.partitionBy("code").orderBy("ord"))), "checks-panel")
        listing = bars(li).join(calendar(bars(li)).select("d", "ord"), "d").groupBy("code").agg((F.max("ord") - F.min("ord") + 1).alias("n")).agg(F.sum("n").alias("want"))
        traded = ~F.col("suspended")
        of_panel = p.agg(
            F.count("*").alias("have"),
            F.count_if(~traded & ((F.col("vol") != 0) | (F.col("amount") != 0))).alias("placeholder"),
            F.count_if((F.col("r") > 20) | (F.col("r") < 0.05)).alias("price_jumps"),
            F.count_if(traded & (F.col("vol") == 0)).alias("zero_volume"),
            F.count_if(traded & F.col("before").isNull()).alias("limit_coverage"),
        ).crossJoin(listing)  # both are one row
        frozen = p.groupBy("d").agg((2 * F.count_if("suspended") > F.count("*")).alias("bad")).agg(F.count_if("bad").alias("frozen_days"))
        of_lines = li.join(o.select("o_orderkey", "o_orderdate", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("l_orderkey").agg(
            F.sum("l_extendedprice").alias("t"), F.max("o_totalprice").alias("want"), F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("early"),
        )
        of_lines = of_lines.agg(F.coalesce(F.sum("early"), F.lit(0)).alias("announced_before_order"), F.count_if(F.abs(F.try_divide(F.col("t"), F.col("want")) - 1) > 0.005).alias("total_differs"))
        unknown = li.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").agg(F.count("*").alias("unknown_supplier"))
        published = publications(spark, sf_dir).agg(F.count_if(F.col("publish_date").isNull() | F.col("source").isNull() | (F.col("publish_date") < F.col("period"))).alias("macro_publish_date"))
        severity = {"row_completeness": "blocking", "placeholder": "blocking", "price_jumps": "warning", "announced_before_order": "blocking", "unknown_supplier": "blocking", "frozen_days": "warning", "zero_volume": "warning", "total_differs": "warning", "macro_publish_date": "blocking", "limit_coverage": "report"}
        out = None
        for one in (of_panel.withColumn("row_completeness", F.abs(F.col("want") - F.col("have"))).drop("want", "have"), frozen, of_lines, unknown, published):
            named = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.lit(severity[c]).alias("severity"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("n_bad")) for c in one.columns]))
            rows = one.select(named.alias("r")).select("r.*")
            out = rows if out is None else out.unionByName(rows)
        return scope.keep(stored(out, "checks"))


def symmetric_difference(spark, sf_dir: str) -> DataFrame:
    """Rows in one of two versions of the order table only: open orders against those over 100,000."""
    o = orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderstatus")
    a, b = o.where(F.col("o_orderstatus") == "O"), orders(spark, sf_dir).where(F.col("o_totalprice") > 100000).select(*o.columns)
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionAll(b.exceptAll(a).withColumn("side", F.lit("b")))


def snapshot_floors(spark, sf_dir: str) -> DataFrame:
    """Publish ledger: the earliest date that any later publication affected; one that does not say makes all before it unknown."""
    o = orders(spark, sf_dir)
    ledger = o.groupBy(F.last_day("day").alias("promoted_at")).agg(F.min(F.when(F.col("o_orderkey") % 997 != 0, F.date_sub("day", (F.col("o_orderkey") % 400).cast("int")))).alias("affected"), F.max((F.col("o_orderkey") % 997 == 0).cast("int")).alias("silent"))
    ledger = ledger.withColumn("affected", F.when(F.col("silent") == 0, F.col("affected")))
    later = Window.partitionBy(F.lit(0)).orderBy("promoted_at").rowsBetween(1, Window.unboundedFollowing)
    unknown = F.coalesce(F.max(F.col("affected").isNull().cast("int")).over(later), F.lit(0)) == 1
    return ledger.select("promoted_at", "affected", F.when(~unknown, F.min("affected").over(later)).alias("floor"), unknown.alias("unknown"))


def coverage_report(spark, sf_dir: str) -> DataFrame:
    """Mean and least daily coverage of each factor, and whether all its rows are of a valid snapshot (sold in full units)."""
    from ..operators.factors import price_factors
    from .market import FACTOR_NAMES

    f = price_factors(the_panel(spark, sf_dir))
    long = f.select("d", "code", F.explode(F.create_map(*[x for n in FACTOR_NAMES for x in (F.lit(n), F.col(n))])).alias("factor", "value"))
    day = long.groupBy("factor", "d").agg((F.count("value") / F.count("*")).alias("c"), F.bool_and(F.col("code") % 50 != 49).alias("valid"))
    return day.groupBy("factor").agg(F.round(F.avg("c"), 6).alias("mean_coverage"), F.round(F.min("c"), 6).alias("min_coverage"), F.count_if("valid").alias("n_valid_days"), F.count("*").alias("n_days"))


def upsert(spark, sf_dir: str) -> DataFrame:
    """Latest version by key: orders, then their corrections (finished ones at 90 %), the later ingestion winning."""
    o = orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))
    new = o.where(F.col("o_orderstatus") == "F").withColumn("price", F.round(F.col("price") * 0.9, 1))
    both = o.withColumn("ingested", F.lit(1)).unionByName(new.withColumn("ingested", F.lit(2)))
    return both.groupBy("o_orderkey").agg(F.max_by(F.struct("o_orderstatus", "price", "ingested"), "ingested").alias("v")).select("o_orderkey", "v.*")


def merge_statements(spark, sf_dir: str) -> DataFrame:
    """Full outer merge of three partial statements on (code, year), the announcement being the latest."""
    li = table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate")).withColumn("d", F.col("l_shipdate").cast("date"))
    part = lambda flag, name: li.where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("code"), "y").agg(F.round(F.sum("l_extendedprice"), 2).alias(name), F.max("d").alias(f"d_{name}"))
    m = part("R", "returned").join(part("A", "accepted"), ["code", "y"], "full").join(part("N", "fresh"), ["code", "y"], "full")
    return m.select("code", "y", "returned", "accepted", "fresh", F.greatest("d_returned", "d_accepted", "d_fresh").alias("ann_date"))


QUERIES = {
    "backward_asof": previous_price,
    "status_intervals": status_intervals,
    "interval_lookup": status_as_of,
    "interval_overlaps": priority_at_shipment,
    "bitemporal_latest": visible_facts,
    "bitemporal_fields": visible_fields,
    "name_status": name_status,
    "statement_factors": statement_factors,
    "value_factors": value_factors,
    "limits_and_mask": limits_and_mask,
    "universe_cascade": universe_steps,
    "trade_costs": trade_costs,
    "macro_visible": macro_visible,
    "data_checks": data_checks,
    "symmetric_difference": symmetric_difference,
    "snapshot_floors": snapshot_floors,
    "coverage_report": coverage_report,
    "upsert_latest": upsert,
    "merge_statements": merge_statements,
}

RUNS = """
day AS (SELECT o_custkey, o_orderdate::DATE AS day, max(o_orderstatus) AS status FROM orders GROUP BY ALL),
rn AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN status IS DISTINCT FROM lag(status) OVER (PARTITION BY o_custkey ORDER BY day) THEN 1 ELSE 0 END AS new FROM day)),
sp AS (SELECT o_custkey, run, status, min(day) AS start_date FROM rn GROUP BY ALL),
iv AS (SELECT o_custkey, status, start_date, (lead(start_date) OVER (PARTITION BY o_custkey ORDER BY run) - 1)::DATE AS end_date FROM sp)"""
DATES = "a(as_of) AS (VALUES " + ", ".join(f"(DATE '{d}')" for d in AS_OF) + ")"

SQL = {
    "backward_asof": """SELECT o.o_orderkey, o.o_custkey, o.o_orderdate::DATE AS day,
        (SELECT max(p.o_totalprice) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = 'F' AND p.o_orderdate::DATE =
          (SELECT max(q.o_orderdate::DATE) FROM orders q WHERE q.o_custkey = o.o_custkey AND q.o_orderstatus = 'F' AND q.o_orderdate::DATE < o.o_orderdate::DATE)) AS asof_price FROM orders o""",
    "status_intervals": f"WITH {RUNS} SELECT * FROM iv",
    "interval_lookup": f"""WITH {RUNS}, pt AS (SELECT DISTINCT o_custkey, make_date(y, 12, 31) AS day FROM orders, range(1995, 2002) t(y))
        SELECT p.o_custkey, p.day, max_by(status, start_date) AS status FROM pt p LEFT JOIN iv i ON i.o_custkey = p.o_custkey AND start_date <= day AND (end_date IS NULL OR end_date >= day) GROUP BY ALL""",
    "interval_overlaps": """WITH s AS (SELECT o_custkey, o_orderdate::DATE AS a, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE + (o_orderkey % 401)::INT ELSE DATE '9999-12-31' END AS b, o_orderpriority AS p FROM orders),
        l AS (SELECT row_number() OVER () AS k, l_orderkey, l_linenumber, o_custkey, l_shipdate::DATE AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT l_orderkey, l_linenumber, l.o_custkey, day, max({'a': a, 'b': b, 'p': p}).p AS priority FROM l LEFT JOIN s ON s.o_custkey = l.o_custkey AND day BETWEEN a AND b GROUP BY k, l_orderkey, l_linenumber, l.o_custkey, day""",
    "bitemporal_latest": f"""WITH {DATES}, f AS (SELECT l_suppkey AS code, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period,
          l_shipdate::DATE AS ann_date, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS flag, l_extendedprice AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        r AS (SELECT *, row_number() OVER (PARTITION BY as_of, code, period ORDER BY flag, CASE WHEN flag = 0 THEN -epoch(ann_date) ELSE epoch(ann_date) END, CASE WHEN flag = 0 THEN -value ELSE value END) AS k
              FROM f JOIN a ON ann_date <= as_of)
        SELECT as_of, code, period, ann_date, value FROM r WHERE k = 1""",
    "bitemporal_fields": f"""WITH {DATES}, j AS (SELECT l_suppkey AS code, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period,
          l_shipdate::DATE AS day, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS flag, l_extendedprice AS p, l_quantity AS q, CASE WHEN l_discount > 0 THEN l_discount END AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        f AS (SELECT code, period, flag, 'price' AS field, day AS ann_date, p AS value FROM j UNION ALL SELECT code, period, flag, 'quantity', day + 30, q FROM j UNION ALL SELECT code, period, flag, 'discount', day, c FROM j WHERE c IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY as_of, code, period, field ORDER BY flag, CASE WHEN flag = 0 THEN -epoch(ann_date) ELSE epoch(ann_date) END, CASE WHEN flag = 0 THEN -value ELSE value END) AS k FROM f JOIN a ON ann_date <= as_of)
        SELECT as_of, code, period, max(value) FILTER (WHERE field = 'price') AS price, max(value) FILTER (WHERE field = 'quantity') AS quantity, max(value) FILTER (WHERE field = 'discount') AS discount FROM r WHERE k = 1 GROUP BY ALL""",
    "name_status": f"""WITH {RUNS} SELECT o_custkey, CASE status WHEN 'F' THEN 'special' WHEN 'P' THEN 'warned' ELSE 'normal' END AS status, start_date, end_date FROM iv
        UNION ALL SELECT c_custkey, 'normal', NULL, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
    "statement_factors": f"""WITH {STATEMENTS},
        w AS (SELECT a.code, a.q, a.dq AS d0, count(b.dq) AS n, stddev_samp(b.dq) AS sd, avg(abs(b.dq)) AS size FROM dl a LEFT JOIN dl b ON b.code = a.code AND b.q BETWEEN a.q - 7 AND a.q GROUP BY ALL)
        SELECT s.code, s.q, round(s.income_q, 4) AS income_q,
          round(CASE WHEN s.q % 4 = 3 THEN s.revenue ELSE s.revenue + y.revenue - p.revenue END, 4) AS revenue_ttm,
          round(CASE WHEN s.q % 4 = 3 THEN s.income ELSE s.income + y.income - p.income END, 4) AS income_ttm,
          round(CASE WHEN b.income_q > 0 AND b.income_q > 0.01 * abs(s.income_q) THEN s.income_q / b.income_q - 1 END, 6) AS income_q_yoy,
          round(CASE WHEN w.n = 8 AND w.sd > 1e-9 * w.size THEN w.d0 / w.sd END, 6) AS income_q_sue
        FROM sq s LEFT JOIN st p ON p.code = s.code AND p.q = s.q - 4 LEFT JOIN st y ON y.code = s.code AND y.q = (s.q // 4) * 4 - 1
        LEFT JOIN sq b ON b.code = s.code AND b.q = s.q - 4 LEFT JOIN w ON w.code = s.code AND w.q = s.q""",
    "value_factors": f"""WITH {PANEL}, {ATTRIBUTES}, {STATEMENTS},
        t AS (SELECT s.*, (make_date((s.q // 4)::INT, (s.q % 4 * 3 + 1)::INT, 1) + INTERVAL 3 MONTH + INTERVAL 59 DAY)::DATE AS ann,
          CASE WHEN s.q % 4 = 3 THEN s.revenue ELSE s.revenue + y.revenue - p.revenue END AS rt, CASE WHEN s.q % 4 = 3 THEN s.income ELSE s.income + y.income - p.income END AS it
          FROM st s LEFT JOIN st p ON p.code = s.code AND p.q = s.q - 4 LEFT JOIN st y ON y.code = s.code AND y.q = (s.q // 4) * 4 - 1),
        e AS (SELECT a.*, 1e6 + a.it AS eq, 1e6 + b.it AS eq0 FROM t a LEFT JOIN t b ON b.code = a.code AND b.q = a.q - 4),
        m AS (SELECT code, d, px * shares AS mv FROM panel JOIN attr USING (code) WHERE d IN (SELECT max(d) FROM cal GROUP BY date_trunc('month', d))),
        j AS (SELECT m.code, m.d, m.mv, e.*, row_number() OVER (PARTITION BY m.code, m.d ORDER BY e.q DESC) AS k FROM m LEFT JOIN e ON e.code = m.code AND e.ann <= m.d)
        SELECT code, d, round(CASE WHEN mv > 0 THEN it / mv END, 6) AS ep_ttm, round(CASE WHEN mv > 0 THEN rt / mv END, 6) AS sp_ttm, round(CASE WHEN mv > 0 THEN eq / mv END, 6) AS bp,
          round(CASE WHEN mv > 0 AND eq > 0 AND eq0 > 0 THEN it / ((eq + eq0) / 2) END, 6) AS roe_ttm, round(CASE WHEN revenue > 0 THEN 100 * income / revenue END, 6) AS gross_margin, round(CASE WHEN mv > 0 AND eq > 0 THEN (it - income) / (4 * eq) END, 6) AS accrual
        FROM j WHERE k = 1""",
    "limits_and_mask": f"""WITH {PANEL}, b AS (SELECT *, lag(px) OVER (PARTITION BY code ORDER BY ord) AS before,
          CASE WHEN code % 7 = 0 THEN 0.05 WHEN code % 3 = 0 THEN 0.2 ELSE 0.1 END::DOUBLE AS rate, ord = max(ord) OVER (PARTITION BY code) AND code % 5 = 0 AS delisted FROM panel),
        l AS (SELECT *, round((before * (1 + rate))::DECIMAL(20, 6), 2)::DOUBLE AS limit_up, round((before * (1 - rate))::DECIMAL(20, 6), 2)::DOUBLE AS limit_down FROM b),
        r AS (SELECT *, CASE WHEN delisted THEN 'delisted' WHEN suspended THEN 'suspended' WHEN limit_up IS NULL OR low IS NULL THEN 'limit_unknown'
          WHEN low >= limit_up - 1e-6 THEN 'limit_up_seal' WHEN low <= limit_down + 1e-6 THEN 'limit_down_seal' ELSE 'ok' END AS reason FROM l)
        SELECT code, d, limit_up, limit_down, reason, reason IN ('ok', 'limit_down_seal') AS can_buy, reason IN ('ok', 'limit_up_seal') AS can_sell FROM r""",
    "universe_cascade": f"""WITH {PANEL}, u AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ord) AS age, avg(amount) OVER (PARTITION BY code ORDER BY ord ROWS 19 PRECEDING) AS adv20 FROM panel),
        r AS (SELECT *, CASE WHEN age <= 26 THEN 'unseasoned' WHEN suspended THEN 'suspended' WHEN code % 7 = 0 THEN 'special' WHEN px IS NULL OR px <= 500 THEN 'penny' END AS reason
          FROM u WHERE d IN (SELECT max(d) FROM cal GROUP BY date_trunc('month', d))),
        k AS (SELECT *, row_number() OVER (PARTITION BY d, reason IS NULL ORDER BY adv20 NULLS FIRST, code) AS rank, count(*) OVER (PARTITION BY d, reason IS NULL) AS n FROM r)
        SELECT d, code, CASE WHEN reason IS NULL AND rank <= floor(n * 0.2::DOUBLE) THEN 'illiquid' ELSE coalesce(reason, 'kept') END AS reason FROM k""",
    "trade_costs": f"""WITH {PANEL}, t AS (SELECT *, avg(CASE WHEN NOT suspended THEN amount END) OVER w AS adv20,
          avg(CASE WHEN NOT suspended AND low > 0 THEN high / low - 1 END) OVER w AS range20
          FROM panel WINDOW w AS (PARTITION BY code ORDER BY ord ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
        c AS (SELECT code, d, CASE WHEN ord % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, amount / 10 AS a,
          coalesce(least(0.5 * (amount / 10) / CASE WHEN adv20 > 0 THEN adv20 END * range20, CASE WHEN adv20 > 0 AND range20 IS NOT NULL THEN 0.003 END), 0.003) AS rate FROM t WHERE NOT suspended),
        x AS (SELECT code, d, side, a * 0.00025 AS commission, CASE WHEN side = 'sell' THEN a * 0.0005 ELSE 0.0 END AS stamp_duty, a * 0.00001 AS transfer_fee, a * rate AS impact FROM c)
        SELECT code, d, side, round(commission, 8) AS commission, round(stamp_duty, 8) AS stamp_duty, round(transfer_fee, 8) AS transfer_fee, round(impact, 8) AS impact,
          round(commission + stamp_duty + transfer_fee + impact, 8) AS total_cost FROM x""",
    "macro_visible": f"""WITH {DATES}, o AS (SELECT o_orderpriority[1] AS indicator, last_day(o_orderdate::DATE) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL),
        p AS (SELECT indicator, period, (period + n)::DATE AS publish_date, round(value * CASE WHEN n = 50 THEN 1.01 ELSE 1.0 END::DOUBLE, 1) AS value FROM o, (VALUES (20), (50)) t(n)),
        l AS (SELECT as_of, indicator, period, max_by(value, publish_date) AS value FROM p JOIN a ON publish_date <= as_of GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY as_of, indicator ORDER BY period DESC) AS k FROM l)
        SELECT as_of, period, {', '.join(f"max(value) FILTER (WHERE indicator = '{k}') AS p{k}" for k in '12345')} FROM r WHERE k <= 3 GROUP BY ALL""",
    "data_checks": f"""WITH {PANEL}, j AS (SELECT px / lag(px) OVER (PARTITION BY code ORDER BY ord) AS r FROM panel),
        day AS (SELECT d, count(*) AS n, count(*) FILTER (WHERE suspended) AS s FROM panel GROUP BY d)
        SELECT 'row_completeness' AS "check", 'blocking' AS severity, abs((SELECT sum(b - a + 1) FROM listing) - (SELECT count(*) FROM panel))::BIGINT AS n_bad
        UNION ALL SELECT 'placeholder', 'blocking', (SELECT count(*) FROM panel WHERE suspended AND (vol <> 0 OR amount <> 0))
        UNION ALL SELECT 'price_jumps', 'warning', (SELECT count(*) FROM j WHERE r > 20 OR r < 0.05)
        UNION ALL SELECT 'announced_before_order', 'blocking', (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate)
        UNION ALL SELECT 'unknown_supplier', 'blocking', (SELECT count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier))
        UNION ALL SELECT 'frozen_days', 'warning', (SELECT count(*) FROM day WHERE s * 2 > n)
        UNION ALL SELECT 'zero_volume', 'warning', (SELECT count(*) FROM panel WHERE NOT suspended AND vol = 0)
        UNION ALL SELECT 'total_differs', 'warning', (SELECT count(*) FROM (SELECT l_orderkey, sum(l_extendedprice) AS t FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey WHERE abs(t / o_totalprice - 1) > 0.005)
        UNION ALL SELECT 'macro_publish_date', 'blocking', (SELECT count(*) FROM (SELECT last_day(o_orderdate::DATE) AS period, (last_day(o_orderdate::DATE) + n)::DATE AS pub FROM orders, (VALUES (20), (50)) t(n)) WHERE pub IS NULL OR pub < period)
        UNION ALL SELECT 'limit_coverage', 'report', (SELECT count(*) FROM (SELECT suspended, lag(px) OVER (PARTITION BY code ORDER BY ord) AS before FROM panel) WHERE NOT suspended AND before IS NULL)""",
    "symmetric_difference": """WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 100000)
        SELECT *, 'a' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'b' FROM (FROM b EXCEPT ALL FROM a)""",
    "snapshot_floors": """WITH l AS (SELECT last_day(o_orderdate::DATE) AS promoted_at,
          CASE WHEN max(CASE WHEN o_orderkey % 997 = 0 THEN 1 ELSE 0 END) = 0 THEN min(CASE WHEN o_orderkey % 997 <> 0 THEN o_orderdate::DATE - (o_orderkey % 400)::INT END) END AS affected FROM orders GROUP BY 1)
        SELECT promoted_at, affected, CASE WHEN NOT unknown THEN f END AS floor, unknown FROM (
          SELECT *, min(affected) OVER w AS f, coalesce(max(CASE WHEN affected IS NULL THEN 1 ELSE 0 END) OVER w, 0) = 1 AS unknown
          FROM l WINDOW w AS (ORDER BY promoted_at ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))""",
    "upsert_latest": """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN round(round(o_totalprice, 2) * 0.9::DOUBLE, 1) ELSE round(o_totalprice, 2) END AS price,
        CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS ingested FROM orders""",
    "merge_statements": """WITH l AS (SELECT l_suppkey AS code, year(l_shipdate)::INT AS y, l_returnflag AS f, round(sum(l_extendedprice), 2) AS v, max(l_shipdate::DATE) AS d FROM lineitem GROUP BY ALL)
        SELECT code, y, max(v) FILTER (WHERE f = 'R') AS returned, max(v) FILTER (WHERE f = 'A') AS accepted, max(v) FILTER (WHERE f = 'N') AS fresh, max(d) AS ann_date FROM l WHERE f IN ('R', 'A', 'N') GROUP BY ALL""",
}


def _coverage_sql() -> str:
    from .market import FACTOR_NAMES, FACTORS, RETURNS

    names = ", ".join(repr(n) for n in FACTOR_NAMES)
    return f"""WITH {PANEL}, {RETURNS}, {FACTORS}, l AS (SELECT d, code, unnest([{names}]) AS factor, unnest([{', '.join(FACTOR_NAMES)}]) AS value FROM fac),
        g AS (SELECT factor, d, count(value) / count(*) AS c, bool_and(code % 50 <> 49) AS valid FROM l GROUP BY factor, d)
        SELECT factor, round(avg(c), 6) AS mean_coverage, round(min(c), 6) AS min_coverage, count(*) FILTER (WHERE valid) AS n_valid_days, count(*) AS n_days FROM g GROUP BY factor"""


SQL["coverage_report"] = _coverage_sql()
