"""Operator 3, chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: its text is all turns before it and its own, formatted,
and its loss mask loss_start..loss_end (code points) covers that reply's text alone.  A conversation that
does not end with an assistant turn has one more row with all its turns and no mask, so that the output
holds every turn.  By definition the output grows with the square of a conversation's turns.

Turns are numbered in windows over spans of turn numbers; each then goes to the blocks of BLOCK turns that follow in its conversation,
and a task streams through a block's turns in order, so that a long conversation's examples are written by
many tasks, each of which holds one text at a time.

Template: `<turn:ROLE>` newline, text, `</turn>` newline.  In roles and texts a backslash is doubled and
the control strings `<turn:` and `</turn>` get one in front (in roles, `>` too): reading takes one away.

Defined results: null role or text is empty; turns are ordered by turn (null first), then role and
text, so ties and repeated rows have one order; a null conv_id is one conversation; without an
assistant turn there are no examples, only the row of all turns; an example is one text, so a conversation
whose formatted turns exceed the 2^31 - 1 bytes of a cell is an error; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

OPEN, CLOSE, TRAINED = "<turn:", "</turn>", "assistant"
#: Turns of a block, and code points that a batch of written examples holds about.
BLOCK, WRITTEN_CHARS = 64, 4 << 20
#: Turn numbers of a span, within which turns are numbered.
SPAN = 4096


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (OPEN, CLOSE):
        out = F.replace(out, F.lit(control), F.lit("\\" + control))
    return out


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def placed(conversations: DataFrame, span: int = SPAN) -> DataFrame:
    """Formatted turns with their position in the conversation, the number of assistant turns before, and the turns in all.

    Turns are numbered within spans of turn numbers, and a span begins where those before it end: a long conversation is
    not in one task.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit(">"), F.lit("\\>")), F.lit(">\n"))
    body = escaped(F.col("text"))
    at = F.coalesce(F.floor(F.col("turn") / span), F.lit(-(1 << 62)))
    parts = turns.select("conv_id", at.alias("span"), "turn", "role", "text", F.concat(head, body, F.lit(CLOSE + "\n")).alias("segment"), F.length(head).alias("n_head"), F.length(body).alias("n_body"), (F.col("role") == TRAINED).alias("target"))
    order = Window.partitionBy("conv_id", "span").orderBy("turn", "role", "text")
    before = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    target = F.col("target").cast("long")
    own = parts.withColumn("_k", F.row_number().over(order) - 1).withColumn("_t", before(target, order))
    # A row for each span; those of one conversation are few.
    ends = turns.select("conv_id", at.alias("span"), (F.col("role") == TRAINED).cast("long").alias("t")).groupBy("conv_id", "span").agg(F.count("*").alias("n"), F.sum("t").alias("t"))
    line = Window.partitionBy("conv_id").orderBy("span")
    begun = ends.select(F.col("conv_id").alias("_id"), F.col("span").alias("_span"), before(F.col("n"), line).alias("_n"), before(F.col("t"), line).alias("_m"), F.sum("n").over(Window.partitionBy("conv_id")).alias("n_all"))
    found = own.join(begun, F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("span") == F.col("_span")))
    return found.select("conv_id", (F.col("_n") + F.col("_k")).cast("long").alias("position"), "n_all", (F.col("_m") + F.col("_t")).alias("nth"), "target", "segment", "n_head", "n_body")


def _written(block_turns: int):
    """Turns sorted by conversation, block and position to the rows of their block; one text is held at a time."""
    names = ["conv_id", "example", "n_turns", "whole", "text", "loss_start", "loss_end"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, chars, ids, out, size, kind = None, [], 0, [], [], 0, None

        def given():
            nonlocal size
            made = pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True))], names=names)
            ids.clear()
            out.clear()
            size = 0
            return made

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, block, position, n_all, nth, target, segment, n_head, n_body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, block) != now:
                    now, parts, chars = (conv, block), [], 0
                start, chars = chars, chars + len(segment)
                parts.append(segment)
                whole = position + 1 == n_all
                if position // block_turns == block and (target or whole):
                    parts = ["".join(parts)]
                    ids.append(conv)
                    first = start + n_head
                    out.append((nth if target else None, position + 1, whole, parts[0], first if target else None, first + n_body if target else None))
                    size += len(parts[0])
                    if size > WRITTEN_CHARS:
                        yield given()
        if out:
            yield given()

    return run


def expand(conversations: DataFrame, block_turns: int = BLOCK) -> DataFrame:
    """One row per assistant turn (example counts them from 0), and one per conversation that ends otherwise (example and mask null):
    conv_id, example, n_turns and text (of the prefix), whole (it is the conversation), loss_start, loss_end.
    """
    p = placed(conversations)
    blocks = F.sequence(F.expr(f"position div {block_turns}"), F.expr(f"(n_all - 1) div {block_turns}"))
    dealt = p.select("conv_id", F.explode(blocks).alias("block"), "position", "n_all", "nth", "target", "segment", "n_head", "n_body")
    ordered = dealt.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "position")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(_written(block_turns), f"conv_id {kind}, example long, n_turns long, whole boolean, text string, loss_start long, loss_end long")


#: A segment: role, then text, up to the first control string that is not escaped.
SEGMENT = re.compile(r"<turn:((?:[^\\>]|\\.)*)>\n((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted text."""
    out, at = [], 0
    while at < len(text):
        m = SEGMENT.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return out


def _turns_digest(texts: pa.Array) -> pa.Array:
    """SHA-256 over role, newline, text, newline of every turn of each whole text; null for other rows."""
    out = []
    for text in texts.to_pylist():
        if text is None:
            out.append(None)
            continue
        digest, n = hashlib.sha256(), 0
        for role, body in parsed(text):
            n += 1
            digest.update(f"{role}\n{body}\n".encode())
        out.append({"n": n, "sha256": digest.hexdigest()})
    return pa.array(out, pa.struct([("n", pa.int64()), ("sha256", pa.string())]))


READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, example_chars long, examples_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and example to a row per conversation; only running digests are held, however long it is."""
    fields = [f.split() for f in READ.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[t] for _, t in fields]
    now, kind, done, ids, begun = None, None, [], [], False

    def close():
        ids.append(now)
        done.append((*whole[:2], loss_chars, loss.hexdigest(), whole[2], count, total, texts.hexdigest()))

    def batch_out():
        made = pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True))], names=["conv_id", *(n for n, _ in fields)])
        ids.clear()
        done.clear()
        return made

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, example, chars, sha, trained, turns in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "example", "chars", "sha256", "trained", "turns")), strict=True):
            if not begun or conv != now:
                if begun:
                    close()
                now, begun = conv, True
                whole, loss_chars, count, total, loss, texts = (None, None, None), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            if turns is not None:
                whole = (turns["n"], turns["sha256"], chars)
            if example is not None:
                count, total = count + 1, total + chars
                loss_chars += len(trained)
                loss.update(trained.encode())
                texts.update(sha.encode())
        if len(done) > 5000:
            yield batch_out()
    if begun:
        close()
    if done:
        yield batch_out()


def read_back(written: DataFrame) -> DataFrame:
    """What the written rows hold of each conversation: its turns by the row of all of them, the replies under the masks, and the examples' texts.

    Of each row only the text under its mask and digests are moved.  A digest over a conversation is
    sequential: a task streams through it.
    """
    masked = F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    read = written.select(
        "conv_id", "example", F.length("text").cast("long").alias("chars"), F.sha2(F.col("text"), 256).alias("sha256"),
        F.regexp_replace(masked, r"(?s)\\(.)", "$1").alias("trained"),
        F.arrow_udf(_turns_digest, "n long, sha256 string")(F.when(F.col("whole"), F.col("text"))).alias("turns"),
    )
    kind = written.schema["conv_id"].dataType.simpleString()
    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", F.col("example").asc_nulls_last())
    return ordered.mapInArrow(_digests, f"conv_id {kind}, {READ}")


PROBE = r"\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the examples of all conversations and of number -7, written as Parquet and read back."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"), F.lit(PROBE).alias("text"))
    return read_back(stored(expand(talks.unionByName(probe)), "chat-examples"))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, row_number() OVER w AS i,
         '<turn:' || replace(replace(replace(replace(role, '\', '\\'), '<turn:', '\<turn:'), '</turn>', '\</turn>'), '>', '\>') || '>' || chr(10)
         || replace(replace(replace(text, '\', '\\'), '<turn:', '\<turn:'), '</turn>', '\</turn>') || '</turn>' || chr(10) AS seg
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, string_agg(seg, '') OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM f)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(seg))::BIGINT AS formatted_chars,
       (count(*) FILTER (WHERE role = 'assistant'))::BIGINT AS n_examples,
       coalesce(sum(length(upto)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS example_chars,
       sha256(coalesce(string_agg(sha256(upto), '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS examples_sha256
FROM e GROUP BY conv_id
"""
