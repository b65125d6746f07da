"""Operator 8, quality rules: a rule bitmask ledger, in DataFrame functions alone.

`ledger` measures every document once and has one bit for each failed rule beside the
measurements.  Policies are versioned masks over those bits, so a new policy, or the question what
a rule costs, never reads a text again: `apply_policy` and `ablation` are bitwise arithmetic on the
ledger.  Nothing is shuffled but the ablation's few partial aggregates.

Defined results: a null or empty text has no words and fails `few_words`; null ids stay null;
repeated rows are judged each by itself; an empty table gives an empty ledger; further columns of
the input, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .text import SPACES, words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_upper", "n_letters", "n_bullets", "n_ellipses"]


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements, at a fixed bit; integers alone, so that it has one truth value."""

    bit: int
    name: str
    sql: str


#: Bits are never reused: a rule that changes gets a new bit, and old ledgers stay readable.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "exclamation", "10 * n_bangs > n_words"),
    Rule(5, "shouting", "100 * n_upper > 50 * n_letters"),
    Rule(6, "word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule(7, "bullets", "100 * n_bullets > 90 * n_lines"),
    Rule(8, "ellipses", "100 * n_ellipses > 30 * n_lines"),
)


def mask(*names: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in names)


BASE_MASK = mask("few_words", "repeated_words")

#: Policy versions: the bits that reject a document.
POLICIES = {
    "v1": BASE_MASK,
    "v2": mask(*(r.name for r in RULES if r.bit <= 6)),
    "v3": mask(*(r.name for r in RULES)),
}


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the MEASURES of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = F.lit("")
    split = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        "text",
        words(F.col("text")).alias("w"),
        F.filter(F.split(F.col("text"), "\n"), lambda x: F.translate(x, SPACES, "") != blank).alias("lines"),
    )
    n = F.size("w")
    # One hash for each 3-word window, by its place; 64 bits are ample within one text.
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    hashed = split.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        _count(F.col("text"), "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: F.substring(F.ltrim(x, F.lit(SPACES)), 1, 1).isin("-", "*", "\u2022"))).cast("long").alias("n_bullets"),
        F.size(F.filter("lines", lambda x: F.rtrim(x, F.lit(SPACES)).endswith("...") | F.rtrim(x, F.lit(SPACES)).endswith("\u2026"))).cast("long").alias("n_ellipses"),
        _count(F.col("text"), "!").cast("long").alias("n_bangs"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        windows.alias("h"),
    )
    # Windows found more than once are neighbours once sorted; the words they cover are counted once.
    ordered = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    placed = hashed.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), ordered))
    again = F.filter("s", lambda x, i: (x.h == F.get("s", i - 1).h).eqNullSafe(True) | (x.h == F.get("s", i + 1).h).eqNullSafe(True))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2))))
    return placed.withColumn("n_repeat_words", F.coalesce(F.when(F.col("s").isNotNull(), F.size(covered)), F.lit(0)).cast("long")).select("doc_id", *MEASURES)


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the MEASURES, and `failed`, a long with the bit of each failed rule."""
    bits = [F.when(F.expr(r.sql), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured(docs).withColumn("failed", failed.cast("long"))


def apply_policy(entries: DataFrame, policy: str = "v3") -> DataFrame:
    """The ledger with `kept`: no bit of the policy's mask is set."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablation(entries: DataFrame, policy: str = "v3") -> DataFrame:
    """Per rule of a policy: documents failing it, failing it alone (what dropping the rule would bring back), and rejected at all.

    One pass and one bitwise aggregation; a row for each rule, whatever the number of documents.
    """
    chosen = POLICIES[policy]
    hit = F.col("failed").bitwiseAND(F.lit(chosen))
    rules = [r for r in RULES if chosen >> r.bit & 1]
    sums = [F.coalesce(F.sum((hit.bitwiseAND(F.lit(1 << r.bit)) != 0).cast("long")), F.lit(0)).alias(f"f{r.bit}") for r in rules]
    sole = [F.coalesce(F.sum((hit == (1 << r.bit)).cast("long")), F.lit(0)).alias(f"o{r.bit}") for r in rules]
    total = entries.agg(*sums, *sole, F.count(F.when(hit != 0, 1)).alias("rejected"), F.count("*").alias("n_docs"))
    rows = F.array(*[F.struct(F.lit(r.bit).alias("bit"), F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"o{r.bit}").alias("n_sole")) for r in rules])
    return total.select(F.explode(rows).alias("r"), "rejected", "n_docs").select("r.*", "rejected", "n_docs")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the ledger of all documents, stored, under the newest policy."""
    entries = apply_policy(stored(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "rule-ledger"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(BASE_MASK)) != 0).alias("base_failed"), "kept", "failed",
    )


def ablation_query(spark, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs, over the stored ledger of all documents, which is read once for each policy."""
    entries = stored(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "rule-ledger")
    out = None
    for policy in POLICIES:
        one = ablation(entries, policy).select(F.lit(policy).alias("policy"), "*")
        out = one if out is None else out.unionByName(one)
    return out


LEDGER_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS k FROM documents),
w AS (
  SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
win AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n
  FROM (SELECT k, i, [w[i], w[i + 1], w[i + 2]] AS g
        FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))),
rep AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n >= 2) GROUP BY k),
m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines,
         length(regexp_replace(text, '[^!]+', '', 'g')) AS n_bangs,
         length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS n_letters,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]'))) AS n_bullets,
         len(list_filter(lines, lambda x: regexp_matches(x, '([.][.][.]|\x{2026})[\x20\x09-\x0D]*$'))) AS n_ellipses
  FROM w LEFT JOIN rep USING (k)),
f AS (
  SELECT *, ((CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * n_bangs > n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 100 * n_upper > 50 * n_letters THEN 32 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 64 ELSE 0 END)
    + (CASE WHEN 100 * n_bullets > 90 * n_lines THEN 128 ELSE 0 END)
    + (CASE WHEN 100 * n_ellipses > 30 * n_lines THEN 256 ELSE 0 END))::BIGINT AS failed
  FROM m)
"""
SQL = LEDGER_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed
FROM f
"""
ABLATION_SQL = LEDGER_SQL + """,
p(policy, mask) AS (VALUES ('v1', 3), ('v2', 127), ('v3', 511)),
r(bit, rule) AS (VALUES (0, 'few_words'), (1, 'repeated_words'), (2, 'symbols'), (3, 'duplicate_lines'), (4, 'exclamation'), (5, 'shouting'),
  (6, 'word_length'), (7, 'bullets'), (8, 'ellipses'))
SELECT policy, bit::INT AS bit, rule,
       (count(*) FILTER (WHERE (failed & (1 << bit)) <> 0))::BIGINT AS n_failed,
       (count(*) FILTER (WHERE (failed & mask) = (1 << bit)))::BIGINT AS n_sole,
       (count(*) FILTER (WHERE (failed & mask) <> 0))::BIGINT AS rejected, count(*)::BIGINT AS n_docs
FROM f, p, r WHERE (mask & (1 << bit)) <> 0 GROUP BY policy, bit, rule
"""
