"""Chat formatting by multi-party perspective rotation.

For every participant of a dialogue, the dialogue is rendered with that speaker as assistant and
the others as named users, with the stretches of the text that a model learns from: the assistant's
own messages with their end marks. A rendering is stored in parts of PART turn numbers, and of PART
messages of these (``sub``), so that no row holds a dialogue of any length: ``offset`` says where in
the whole text a part begins, masks are places in the whole text, and the parts' texts joined in order
are the dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

PART = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def safe(c: Column) -> Column:
    """Text without markers of the format: each ``<|`` gets a backslash in between."""
    return F.replace(c, F.lit("<|"), F.lit("<\\|"))


def parts(turns: DataFrame, part: int = PART) -> DataFrame:
    """c and none (conv_id without null, whether it was null), part, sub and ``messages``: the distinct (turn, role, text) of those turn numbers in order, PART at most.

    Null roles are the speaker "unknown", null texts are empty, null turns come first (part -1).
    Rows that are alike in conv_id, turn, role and text are one message; null conv_ids are one dialogue.
    Messages are numbered within the turn numbers of a part, so only equal or null turns meet in one sort.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.floor(F.col("turn") / part), F.lit(-1)).cast("long").alias("part"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"),
    )
    rows = rows.select(F.coalesce("conv_id", F.lit(0)).alias("c"), F.isnull("conv_id").alias("none"), "part", "m")
    number = F.dense_rank().over(Window.partitionBy("c", "none", "part").orderBy("m.turn", "m.role", "m.text"))
    rows = rows.select("*", F.floor((number - 1) / part).cast("long").alias("sub"))
    return rows.groupBy("c", "none", "part", "sub").agg(F.sort_array(F.collect_set("m")).alias("messages"))


def _head(role: Column, own: Column) -> Column:
    return F.concat(F.lit(OPEN), F.when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), safe(role))), F.lit("\n"))


def _body(text: Column) -> Column:
    return F.concat(safe(text), F.lit(CLOSE))


def _offsets(held: DataFrame) -> DataFrame:
    """c, none, part, sub, participant and offset: the code points of a participant's rendering before each part, from lengths alone."""
    size = lambda m, own: F.length(_head(m["role"], own)) + F.length(_body(m["text"])) + 1
    each = held.select("c", "none", "part", "sub", F.explode(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), size(m, F.lit(False)).alias("other"), size(m, F.lit(True)).alias("own")))).alias("m"))
    each = each.groupBy("c", "none", "part", "sub", F.col("m.role").alias("role")).agg(F.sum("m.other").alias("other"), F.sum(F.col("m.own") - F.col("m.other")).alias("more"))
    whole = each.groupBy("c", "none", "part", "sub").agg(F.sum("other").alias("size"))
    speakers = each.select("c", "none", F.col("role").alias("participant")).distinct()
    grid = whole.join(speakers, ["c", "none"]).join(each.select("c", "none", "part", "sub", F.col("role").alias("participant"), "more"), ["c", "none", "part", "sub", "participant"], "left")
    before = Window.partitionBy("c", "none", "participant").orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)
    return grid.select("c", "none", "part", "sub", "participant", F.coalesce(F.sum(F.col("size") + F.coalesce("more", F.lit(0))).over(before), F.lit(0)).alias("offset"))


def rotate(turns: DataFrame, part: int = PART) -> DataFrame:
    """A row for every dialogue, participant and part: conv_id, participant, part, sub, offset, n_messages, n_own, text and masks.

    masks are (start, end) in code points of the whole dialogue's text, in order, end exclusive: what to
    learn. A participant who says nothing in a part has none there. An empty table gives no row.
    """
    held = parts(turns, part)
    both = held.join(_offsets(held), ["c", "none", "part", "sub"])
    own = lambda m: m["role"] == F.col("participant")
    said = both.select("c", "none", "participant", "part", "sub", "offset", F.transform("messages", lambda m: F.struct(own(m).alias("own"), _head(m["role"], own(m)).alias("head"), _body(m["text"]).alias("body"))).alias("said"))
    # lengths add up in one pass; a mask is the body of an own message
    zero = F.struct(F.col("offset").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + F.length(s["head"])
        end = start + F.length(s["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(s["own"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return said.select(
        F.when(~F.col("none"), F.col("c")).alias("conv_id"),
        "participant",
        "part",
        "sub",
        "offset",
        F.size("said").cast("long").alias("n_messages"),
        F.size(F.filter("said", lambda s: s["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("said", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "").alias("text"),
        F.aggregate("said", zero, step)["out"].alias("masks"),
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "participant", "part", "sub", "offset", "n_messages", "n_own", "text", F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"])), ",").alias("masks"))


SQL = {
    "op4_chat": rf"""
WITH m AS (
  SELECT DISTINCT conv_id, coalesce(floor(turn / {PART}), -1)::BIGINT AS part, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), p AS (SELECT DISTINCT conv_id, role AS participant FROM m
), n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, text) - 1) // {PART} AS sub FROM m
), s AS (
  SELECT n.conv_id, participant, part, sub, turn, role, text, role = participant AS own,
    '{OPEN}' || (CASE WHEN role = participant THEN 'assistant' ELSE 'user name=' || replace(role, '<|', '<\|') END) || chr(10) AS head,
    replace(text, '<|', '<\|') || '{CLOSE}' AS body
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id
), a AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM s
), b AS (SELECT *, pos + length(head) AS start FROM a)
SELECT conv_id, participant, part, sub::BIGINT AS sub, min(pos)::BIGINT AS "offset", count(*)::BIGINT AS n_messages, count(*) FILTER (WHERE own)::BIGINT AS n_own,
  string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text,
  coalesce(string_agg(start || ':' || (start + length(body)), ',' ORDER BY start) FILTER (WHERE own), '') AS masks
FROM b GROUP BY conv_id, participant, part, sub
"""
}
