"""Preference formatting of chosen and rejected conversations, in DataFrame functions.

The longest common prefix of turns (same role and text) is rendered once as the prompt. What follows it is rendered
for each side, with the character ranges that a loss may look at: the assistant's turns without their headers.
A "<|" inside a role or text is rendered with a backslash between the two characters (one more where there are some already),
so that no turn can forge the border of another, and removing one backslash gives the text back.

Defined cases: turns are ordered by (turn, role, text), nulls first, and repeated turns stay; a null role or text is
rendered as empty and equals only another null. A pair is usable only if both sides have a turn to train on after the prompt and
are not rendered alike; others are returned with usable = false. A row with a null pair id belongs to no pair: it is
returned as a row of its own, not usable, so such rows are never gathered. Texts are worked on whole; no rows give no rows;
extra columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

HEADER, END = "<|{}|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def header(turn: Column) -> Column:
    before, after = HEADER.split("{}")
    return F.concat(F.lit(before), escaped(turn["role"]), F.lit(after))


def body(turn: Column) -> Column:
    return F.concat(escaped(turn["text"]), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), body(t))), "")


def mask(turns: Column) -> Column:
    """Array of (from, to): the characters of render(turns) that are trained on."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(header(t))
        end = begin + F.length(body(t))
        span = F.array(F.struct(begin.cast("int").alias("from"), end.cast("int").alias("to")))
        trained = F.coalesce(t["role"] == TRAINED_ROLE, F.lit(False))
        return F.struct(end.cast("int").alias("at"), F.when(trained, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame, pair: Column, chosen: Column, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each pair: pair_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask, usable.

    A side's turns are gathered in its own row: as many as one conversation has, however many pairs there are.
    """
    one = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    named = turns.select(pair.alias("pair_id"), chosen.alias("chosen"), one.alias("one"))
    side = lambda which: F.sort_array(F.collect_list(F.when(which, F.col("one"))))
    grouped = named.filter("pair_id IS NOT NULL").groupBy("pair_id").agg(side(F.col("chosen")).alias("c"), side(~F.col("chosen")).alias("r"))
    none = F.array().cast(grouped.schema["c"].dataType)
    alone = named.filter("pair_id IS NULL").select("pair_id", F.when(F.col("chosen"), F.array("one")).otherwise(none).alias("c"), F.when(F.col("chosen"), none).otherwise(F.array("one")).alias("r"))
    grouped = grouped.unionByName(alone)
    same = F.zip_with("c", "r", lambda a, b: F.coalesce(a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]), F.lit(False)))
    first_other = F.array_position(same, False).cast("int")
    length = grouped.withColumn("k", F.when(first_other == 0, F.size("c")).otherwise(first_other - 1))
    rest = lambda c: F.slice(c, F.col("k") + 1, F.size(c))
    split = length.select("pair_id", "k", F.slice("c", F.lit(1), F.col("k")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    out = split.select(
        "pair_id", F.col("k").cast("long").alias("n_prefix"), render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"),
        mask(F.col("c")).alias("chosen_mask"), mask(F.col("r")).alias("rejected_mask"),
    )
    return out.withColumn("usable", (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0) & (F.col("chosen") != F.col("rejected")))


def op8_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs conversation 2k (chosen) with 2k + 1 (rejected)."""
    turns = table(spark, sf_dir, "conversations")
    out = format_preferences(turns, F.floor(F.col("conv_id") / 2).cast("long"), F.coalesce(F.col("conv_id") % 2 == 0, F.lit(True)))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["from"].cast("string"), F.lit(":"), x["to"].cast("string"))), ",")
    return out.withColumns({"chosen_mask": spans("chosen_mask"), "rejected_mask": spans("rejected_mask")})


ORACLE = r"""
WITH t AS (
  SELECT CASE WHEN conv_id IS NULL THEN 'row' || row_number() OVER () ELSE 'pair' || conv_id // 2 END AS g, conv_id // 2 AS pair_id, coalesce(conv_id % 2 = 0, true) AS is_chosen, turn, role, text,
         '<|' || regexp_replace(coalesce(role, ''), '<(\\*)\|', '<\\\1|', 'g') || '|>' || chr(10) AS head, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS rest
  FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY g, is_chosen ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM t
), m AS (
  SELECT coalesce(c.g, r.g) AS g, coalesce(c.i, r.i) AS i,
         c.i IS NOT NULL AND r.i IS NOT NULL AND c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS same
  FROM (FROM n WHERE is_chosen) c FULL JOIN (FROM n WHERE NOT is_chosen) r ON c.g = r.g AND c.i = r.i
), k AS (
  SELECT g, coalesce(min(CASE WHEN NOT same THEN i END) - 1, max(i)) AS n_prefix FROM m GROUP BY g
), placed AS (
  SELECT n.*, n_prefix, coalesce(sum(length(head) + length(rest)) OVER (PARTITION BY g, is_chosen, i > n_prefix ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM n JOIN k USING (g)
), sides AS (
  SELECT any_value(pair_id) AS pair_id, any_value(n_prefix) AS n_prefix,
    coalesce(string_agg(head || rest, '' ORDER BY i) FILTER (WHERE is_chosen AND i <= n_prefix), '') AS prompt,
    coalesce(string_agg(head || rest, '' ORDER BY i) FILTER (WHERE is_chosen AND i > n_prefix), '') AS chosen,
    coalesce(string_agg(head || rest, '' ORDER BY i) FILTER (WHERE NOT is_chosen AND i > n_prefix), '') AS rejected,
    coalesce(string_agg((pos + length(head))::BIGINT || ':' || (pos + length(head) + length(rest))::BIGINT, ',' ORDER BY i) FILTER (WHERE is_chosen AND i > n_prefix AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg((pos + length(head))::BIGINT || ':' || (pos + length(head) + length(rest))::BIGINT, ',' ORDER BY i) FILTER (WHERE NOT is_chosen AND i > n_prefix AND role = 'assistant'), '') AS rejected_mask
  FROM placed GROUP BY g
)
SELECT *, chosen_mask != '' AND rejected_mask != '' AND chosen != rejected AS usable FROM sides
"""
