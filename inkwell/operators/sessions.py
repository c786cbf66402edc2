"""Order-dependent operators over conversations: latest rows, token budgets, ring buffers, pairs, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens_for_history
from ..plans.registry import query
from ..plans.session import table

BUDGET = 400


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS newest FROM conversations) WHERE newest = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by(F.struct("turn", "text"), "turn").alias("last")
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(last).select("conv_id", F.col("last.turn").alias("turn"), "role", F.col("last.text").alias("text"))


@query(
    f"""WITH t AS (SELECT *, greatest(1, length(text) // 2) AS tok, turn = 0 AND role = 'system' AS leads FROM conversations), s AS (
  SELECT *, coalesce(sum(tok) FILTER (WHERE leads) OVER (PARTITION BY conv_id), 0) AS lead_cost,
    sum(CASE WHEN leads THEN 0 ELSE tok END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS newest FROM t)
SELECT conv_id, turn, role, tok AS tokens FROM s WHERE leads OR newest = 1 OR used <= {BUDGET} - lead_cost"""
)
def history_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the newest turn back while the budget lasts; the newest turn and a leading system turn always stay."""
    leads = (F.col("turn") == 0) & (F.col("role") == "system")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", tokens_for_history(F.col("text")).alias("tokens"), leads.alias("leads"))
    conv = Window.partitionBy("conv_id")
    back = conv.orderBy(F.desc("turn"))
    rows = rows.withColumns({
        "lead_cost": F.sum(F.when(F.col("leads"), F.col("tokens")).otherwise(0)).over(conv),
        "used": F.sum(F.when(F.col("leads"), 0).otherwise(F.col("tokens"))).over(back.rowsBetween(Window.unboundedPreceding, 0)),
        "newest": F.row_number().over(back),
    })
    return rows.filter(F.col("leads") | (F.col("newest") == 1) | (F.col("used") <= BUDGET - F.col("lead_cost"))).select("conv_id", "turn", "role", "tokens")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS newest FROM conversations) WHERE newest <= 3")
def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three rows of each key (a ring buffer)."""
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf_dir, "conversations").withColumn("newest", newest).filter("newest <= 3").select("conv_id", "turn", "role")


@query("SELECT * FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) WHERE next_role IS NOT NULL")
def consecutive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return pairs.filter("next_role IS NOT NULL").select("conv_id", "turn", "role", "next_role")


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS batch FROM conversations")
def element_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a document in batches of a fixed size."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor((place - 1) / 2).alias("batch"))


@query(
    """SELECT conv_id, turn, last_value(first_line IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS subject
  FROM (SELECT *, CASE WHEN role = 'user' THEN substr(string_split(text, chr(10))[1], 1, 60) END AS first_line FROM conversations)"""
)
def context_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject of the last user turn among the four before."""
    subject = F.when(F.col("role") == "user", F.substring(F.split("text", "\n").getItem(0), 1, 60))
    window = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-4, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(subject, ignorenulls=True).over(window).alias("subject"))
