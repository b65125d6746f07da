"""Document dates, two-stage and filtered vector search, upkeep of stored memories, profiles and audit counters, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import retrieval
from ..session import scratch_path, table



def latest_date(name: Column) -> tuple[Column, Column]:
    """(pieces, date): the first is to be a column `_pieces` before the second is taken.

    The date is the latest valid date of 2000 to 2099 in a name; null if there is none.

    The name is taken apart into runs of digits and what lies between them.  A date's eight digits are one run, or year, month and day
    are runs of their own, or two of them together, with one of - _ . between runs.  All are looked at, wherever they begin.
    """
    pieces = F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    lengths = ((8,), (4, 4), (6, 2), (4, 2, 2))

    def at(i: Column) -> Column:
        found = []
        for shape in lengths:
            runs = [F.get(F.col("_pieces"), i + 2 * k) for k in range(len(shape))]
            fits = F.lit(True)
            for k, n in enumerate(shape):
                fits = fits & (F.length(runs[k]) == n) & runs[k].rlike("^[0-9]")
                if k:
                    fits = fits & F.get(F.col("_pieces"), i + 2 * k - 1).isin("-", "_", ".")
            digits = F.concat(*runs)
            day = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
            found.append(F.when(fits & digits.startswith("20"), day.try_cast("date")))
        return F.greatest(*found)

    return pieces, F.array_max(F.transform(F.sequence(F.lit(0), F.size("_pieces") - 1), at))


def publish_dates(spark, sf_dir: str) -> DataFrame:
    """The publish date of each file and where it comes from: an override, else the latest valid date of its name, else unknown.

    Files are named after orders (20 years later), in three spellings; every fifth has no date, every fourth also the end of the
    period it reports, before or after its date, every ninth a date that does not exist, and every seventh an override.
    """
    k = F.col("o_orderkey")
    day = F.add_months(F.col("o_orderdate").cast("date"), 240)
    spelt = F.when(k % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(day, "yyyyMMdd")).otherwise(F.date_format(day, "yyyy.MM.dd"))
    period = F.date_format(F.last_day(F.add_months(day, -3)), "yyyy-MM-dd")
    parts = [
        F.lit("note"), F.when((k % 4 == 0) & (k % 8 == 0), F.concat(F.lit("rep_"), period)), F.when(k % 9 == 0, F.lit("2031-02-31")), F.when(k % 5 != 0, spelt),
        F.when((k % 4 == 0) & (k % 8 != 0), F.concat(F.lit("rep_"), period)), F.concat(F.lit("n"), k.cast("string"), F.lit(".pdf")),
    ]
    f = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("_", *parts).alias("name"), F.when(k % 7 == 0, F.date_add(day, 1)).alias("override"))
    pieces, named = latest_date(F.col("name"))
    f = f.withColumn("_pieces", pieces).withColumn("named", named)
    source = F.when(F.col("override").isNotNull(), "override").when(F.col("named").isNotNull(), "filename").otherwise("unknown")
    return f.select("o_orderkey", "name", F.coalesce("override", "named").alias("publish_date"), source.alias("source"))


def asked(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0)


def nearest_by_cells(spark, sf_dir: str) -> DataFrame:
    """nearest_vectors by an index of cells: for tables too large to compare every query with every vector."""
    v = table(spark, sf_dir, "embeddings")
    return retrieval.nearest_in_cells(asked(spark, sf_dir), v, retrieval.fit_cells(v))


def reranked(spark, sf_dir: str) -> DataFrame:
    """Two stages: the 50 nearest vectors of every query, scored anew (20 times the cosine of the first 16 places, less 10), the best 10 of -10 at least."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    found = retrieval.nearest(asked(spark, sf_dir), table(spark, sf_dir, "embeddings"), 50)
    j = found.join(v, "vec_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("e").alias("q")), "query_id")
    return retrieval.reranked(j, 20 * retrieval.cosine(F.slice("q", 1, 16), F.slice("e", 1, 16)) - 10, 10, -10.0).select("query_id", "vec_id", "score", "rank")


def memory_search(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest memories of the first five labels with a similarity of 0.2 or more, by query; per memory how often it was found, and its best similarity."""
    v = table(spark, sf_dir, "embeddings")
    hits = retrieval.nearest(asked(spark, sf_dir), v.where("label < 5"), 10).where("similarity >= 0.2")
    return hits.groupBy("vec_id").agg(F.count("*").alias("touches"), F.max("similarity").alias("best"), F.min("query_id").alias("first_query"))


def memory_admission(spark, sf_dir: str) -> DataFrame:
    """Memories (the first five places of the vectors, by label as their user, in a shuffled order of arrival), each accepted or rejected as a duplicate of one accepted before."""
    v = table(spark, sf_dir, "embeddings")
    m = v.select("vec_id", F.col("label").alias("owner"), F.pmod(F.col("vec_id") * 7919, F.lit(10007)).alias("at"), F.slice("embedding", 1, 5).alias("embedding"))
    return retrieval.admitted(m)


def memory_upkeep(spark, sf_dir: str) -> DataFrame:
    """Memories (events) after upkeep, newest first by user: one user's are cleared, errors of every tenth user deleted, those of users not seen for five days pruned."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    deleted = e.where((F.col("user_id") == 7) | ((F.col("event_type") == "error") & (F.col("user_id") % 10 == 3))).select("event_id")
    seen = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    end = e.agg(F.max("ts").alias("end"))
    live = seen.crossJoin(F.broadcast(end)).where(F.col("last") >= F.col("end") - F.expr("INTERVAL 5 DAYS")).select("user_id")  # end is one row
    kept = e.join(live, "user_id", "left_semi").join(deleted, "event_id", "left_anti")
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return kept.select("user_id", "event_id", newest.cast("long").alias("place"))


def profiles(spark, sf_dir: str) -> DataFrame:
    """A user's profile: the last value of each kind of event, new entries in place of old ones, entries below 10 not taken over; keys in order."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("v"))
    half = lambda cond: e.where(cond).where("v >= 1000").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "v")).alias("x")).groupBy("user_id")
    entries = lambda g, name: g.agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.col("x.v").alias("v")))).alias(name))
    both = entries(half("event_id % 2 = 0"), "old").join(entries(half("event_id % 2 = 1"), "new"), "user_id", "full")
    empty = F.create_map().cast("map<string,bigint>")
    old, new = F.coalesce("old", empty), F.coalesce("new", empty)
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    text = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ";")
    return both.select("user_id", text.alias("profile"))


def audit_counters(spark, sf_dir: str) -> DataFrame:
    """An audit log appended batch by batch and counted by its labels."""
    path = scratch_path(spark, "audit")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("action"), F.when(F.col("value") > 400, "refused").otherwise("done").alias("outcome"), F.col("ts").cast("date").alias("day"))
    for part in ("event_id % 3 = 0", "event_id % 3 <> 0"):
        e.where(part).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("day", "action", "outcome").agg(F.count("*").alias("n"))


QUERIES = {
    "publish_dates": publish_dates,
    "nearest_by_cells": nearest_by_cells,
    "reranked_vectors": reranked,
    "memory_search": memory_search,
    "memory_admission": memory_admission,
    "memory_upkeep": memory_upkeep,
    "profile_merge": profiles,
    "audit_counters": audit_counters,
}

SQL = {
    "publish_dates": r"""WITH o AS (SELECT o_orderkey AS k, (o_orderdate::DATE + INTERVAL 240 MONTH)::DATE AS day FROM orders),
        f AS (SELECT k, concat_ws('_', 'note', CASE WHEN k % 8 = 0 THEN 'rep_' || strftime(last_day((day - INTERVAL 3 MONTH)::DATE), '%Y-%m-%d') END, CASE WHEN k % 9 = 0 THEN '2031-02-31' END,
            CASE WHEN k % 5 <> 0 THEN CASE k % 3 WHEN 0 THEN strftime(day, '%Y-%m-%d') WHEN 1 THEN strftime(day, '%Y%m%d') ELSE strftime(day, '%Y.%m.%d') END END,
            CASE WHEN k % 8 = 4 THEN 'rep_' || strftime(last_day((day - INTERVAL 3 MONTH)::DATE), '%Y-%m-%d') END, 'n' || k || '.pdf') AS name, CASE WHEN k % 7 = 0 THEN day + 1 END AS override FROM o),
        c AS (SELECT k, substr(name, i, n) AS s, substr(name, i - 1, 1) AS before, substr(name, i + n, 1) AS after
              FROM f, range(1, 60) p(i), range(8, 11) l(n) WHERE i + n <= length(name) + 1 AND substr(name, i, 2) = '20'),
        g AS (SELECT k, max(try_cast(substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) AS DATE)) AS named FROM (
              SELECT k, regexp_replace(s, '[-_.]', '', 'g') AS d FROM c WHERE regexp_full_match(s, '[0-9]{4}[-_.]?[0-9]{2}[-_.]?[0-9]{2}') AND NOT regexp_full_match(before, '[0-9]') AND NOT regexp_full_match(after, '[0-9]')) GROUP BY k)
        SELECT k AS o_orderkey, name, coalesce(override, named) AS publish_date, CASE WHEN override IS NOT NULL THEN 'override' WHEN named IS NOT NULL THEN 'filename' ELSE 'unknown' END AS source FROM f LEFT JOIN g USING (k)""",
    "reranked_vectors": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity,
          round(20 * list_cosine_similarity(q.embedding[1:16]::DOUBLE[], v.embedding[1:16]::DOUBLE[]) - 10, 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
        f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS k FROM s)
        SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM f WHERE k <= 50 AND score >= -10) WHERE rank <= 10""",
    "memory_search": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0 AND v.label < 5)
        SELECT vec_id, count(*) AS touches, max(similarity) AS best, min(query_id) AS first_query FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS k FROM s) WHERE k <= 10 AND similarity >= 0.2 GROUP BY vec_id""",
    "memory_admission": """WITH RECURSIVE m AS (SELECT vec_id, label AS owner, (vec_id * 7919) % 10007 AS at_, embedding[1:5]::DOUBLE[] AS e FROM embeddings),
        o AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY at_, vec_id) AS i FROM m),
        r(owner, i, vec_id, kept, best) AS (
          SELECT owner, i, vec_id, [{'e': e, 'a': at_, 'v': vec_id}], NULL::STRUCT(s DOUBLE, a BIGINT, v BIGINT) FROM o WHERE i = 1
          UNION ALL
          SELECT owner, i, vec_id, CASE WHEN len(near) = 0 THEN list_append(kept, {'e': e, 'a': at_, 'v': vec_id}) ELSE kept END, near[1] FROM (
            SELECT o.owner, o.i, o.vec_id, o.e, o.at_, r.kept,
              list_sort(list_transform(list_filter(r.kept, lambda k: list_cosine_similarity(k.e, o.e) >= 0.85), lambda k: {'s': -round(list_cosine_similarity(k.e, o.e), 6), 'a': k.a, 'v': k.v})) AS near
            FROM r JOIN o ON o.owner = r.owner AND o.i = r.i + 1))
        SELECT vec_id, owner, best IS NULL AS accepted, best.v AS duplicate_of, -best.s AS similarity FROM r""",
    "memory_upkeep": """WITH l AS (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY)
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events
        WHERE user_id IN (FROM l) AND user_id <> 7 AND NOT (event_type = 'error' AND user_id % 10 = 3)""",
    "profile_merge": """WITH e AS (SELECT *, round(value * 100)::BIGINT AS v FROM events), x AS (SELECT user_id, event_type, event_id % 2 AS new, max({'ts': ts, 'id': event_id, 'v': v}).v AS v FROM e WHERE v >= 1000 GROUP BY ALL),
        m AS (SELECT user_id, event_type, max_by(v, new) AS v FROM x GROUP BY ALL)
        SELECT user_id, string_agg(event_type || '=' || v, ';' ORDER BY event_type) AS profile FROM m GROUP BY 1""",
    "audit_counters": "SELECT ts::DATE AS day, event_type AS action, CASE WHEN value > 400 THEN 'refused' ELSE 'done' END AS outcome, count(*) AS n FROM events GROUP BY ALL",
}
