"""Relational shapes at volume: equi-joins, semi and anti joins, overlays, grouping sets, JSON columns, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markers
from ..plans.registry import query
from ..plans.session import small, table
from .analytics import share


@query("SELECT n_name, r_name, count(*) AS n, round(sum(o_totalprice) / 1000, 1) AS revenue_k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are summed by customer before they meet names, so the shuffle carries one row a customer."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("p"))
    places = table(spark, sf_dir, "nation").join(small(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(small(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "r_name").agg(F.sum("n").alias("n"), F.round(F.sum("p") / 1000, 1).alias("revenue_k"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 4) AS mean_discount, min(l_shipdate) AS first_ship FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def line_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 4).alias("mean_discount"), F.min("l_shipdate").alias("first_ship")
    )


@query("SELECT c_custkey, c_name, n_orders, largest FROM (SELECT o_custkey AS c_custkey, count(*) AS n_orders, max(o_totalprice) AS largest FROM orders GROUP BY 1 ORDER BY n_orders DESC, c_custkey LIMIT 50) JOIN customer USING (c_custkey)")
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("largest")).orderBy(F.desc("n_orders"), "c_custkey").limit(50)
    return table(spark, sf_dir, "customer").join(F.broadcast(top), "c_custkey").select("c_custkey", "c_name", "n_orders", "largest")


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean_balance FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_mktsegment")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    idle = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return idle.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"))


@query("SELECT p_brand, count(*) AS n_parts FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) GROUP BY p_brand")
def parts_in_large_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(large, "p_partkey", "left_semi").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_parts"))


@query("SELECT s_suppkey, s_name, coalesce(n, 0) AS n_lines, coalesce(flag, 'none') AS top_flag FROM supplier LEFT JOIN (SELECT l_suppkey, sum(c)::BIGINT AS n, arg_max(l_returnflag, (c, l_returnflag)) AS flag FROM (SELECT l_suppkey, l_returnflag, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY l_suppkey) ON s_suppkey = l_suppkey")
def supplier_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rows overlaid by what an aggregate knows of them."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("c"))
    known = lines.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("c").alias("n"), F.max_by("l_returnflag", F.struct("c", "l_returnflag")).alias("flag"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").join(known, "s_suppkey", "left")
    return rows.select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("flag", F.lit("none")).alias("top_flag"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) AS g1, grouping(o_orderpriority) AS g2 FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping("o_orderstatus").cast("long").alias("g1"), F.grouping("o_orderpriority").cast("long").alias("g2"))


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 2")
def top_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("place", place).filter("place <= 2").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT k % 10 AS bucket, count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT (props::JSON ->> '$.k')::BIGINT AS k FROM events) GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a JSON text column, parsed once with a fixed schema."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select(k.alias("k")).groupBy((F.col("k") % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query("SELECT event_type, key, count(*) AS n, sum(v)::BIGINT AS total FROM (SELECT event_type, unnest(json_keys(props::JSON)) AS key, (props::JSON ->> '$.k')::BIGINT AS v FROM events) GROUP BY ALL")
def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the keys of nested counters, whatever their names."""
    rows = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "v"))
    return rows.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("SELECT event_id, ts, event_type, value FROM events WHERE event_type IN ('error', 'signup') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 10")
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of filtered audit events, newest first; the filter reaches the scan."""
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "signup") & (F.col("ts") >= day("2024-01-10")) & (F.col("ts") < day("2024-01-20")))
    return rows.orderBy(F.desc("ts"), "event_id").offset(10).limit(50).select("event_id", "ts", "event_type", "value")


@query("SELECT user_id, value, event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND event_type = 'error'")
def recent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after a retention of seven days before the newest event."""
    rows = table(spark, sf_dir, "events")
    newest = rows.agg(F.max("ts").alias("newest"))
    return rows.filter("event_type = 'error'").crossJoin(F.broadcast(newest)).filter(F.col("ts") >= F.col("newest") - F.expr("INTERVAL 7 DAYS")).select("user_id", "value", "event_id")


FAILURES = (*markers.FAILURE_CATEGORIES, ("error at 1", "first_users", True), ("error", "other", False))
_MESSAGE_SQL = "event_type || ' at ' || user_id"
_CASE_SQL = "CASE " + " ".join(f"WHEN contains({_MESSAGE_SQL}, '{w}') THEN '{n}'" for w, n, _ in FAILURES) + " ELSE 'unknown' END"


@query(f"SELECT category, count(*) AS n, CASE category WHEN 'first_users' THEN true ELSE false END AS recoverable FROM (SELECT {_CASE_SQL} AS category FROM events) GROUP BY category")
def failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by the first pattern they hold, with whether a retry can help."""
    message = F.concat("event_type", F.lit(" at "), F.col("user_id").cast("string"))
    category = F.lit("unknown")
    for words, name, _ in reversed(FAILURES):
        category = F.when(message.contains(words), name).otherwise(category)
    helps = sorted({n for _, n, again in FAILURES if again})
    counts = table(spark, sf_dir, "events").groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("recoverable", F.col("category").isin(helps))


@query("SELECT role, text, conv_id FROM (SELECT *, row_number() OVER (PARTITION BY role, text ORDER BY conv_id DESC, turn DESC) AS newest FROM conversations) WHERE newest = 1")
def sample_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each signature."""
    return table(spark, sf_dir, "conversations").groupBy("role", "text").agg(F.max("conv_id").alias("conv_id"))


@query("SELECT lang, CASE WHEN sum(1) <= 0 THEN 0.0 ELSE round(sum((quality IS NOT NULL)::INTEGER) / sum(1), 4) END AS completion, sum(1)::BIGINT AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def delivery_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("lang").agg(share(F.count("quality"), F.count(F.lit(1))).alias("completion"), F.count(F.lit(1)).alias("n"))
