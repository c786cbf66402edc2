"""Usage, feedback, latency, audit and failure rollups: one pass and one aggregation each, with partial sums before the shuffle.

On the driver's tables: action = event_type, latency = value, session = conv_id, rating = 2 * quality - 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import error_signature, tokens_for_usage
from ..plans.registry import query
from ..plans.session import table


def share(part: Column, whole: Column) -> Column:
    """part / whole rounded to 4 places; 0.0 where whole is not positive."""
    return F.when(whole <= 0, 0.0).otherwise(F.round(part / whole, 4))


def ratio_sql(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} <= 0 THEN 0.0 ELSE round({part} / {whole}, 4) END"


@query("SELECT text AS question, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY text ORDER BY n DESC, question LIMIT 5")
def top_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return users.groupBy(F.col("text").alias("question")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "question").limit(5)


@query("SELECT day, n FROM (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY ts::DATE ORDER BY day DESC LIMIT 7) ORDER BY day")
def trend_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.orderBy(F.desc("day")).limit(7).orderBy("day")


@query("SELECT role, count(*) AS n, avg(length(text)) AS mean_chars FROM conversations GROUP BY role")
def role_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("mean_chars"))


@query("SELECT coalesce(source, 'unknown') AS source, CASE WHEN n_chars >= 2000 THEN 'ready' WHEN n_chars >= 200 THEN 'queued' ELSE 'failed' END AS status, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def source_status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    status = F.when(F.col("n_chars") >= 2000, "ready").when(F.col("n_chars") >= 200, "queued").otherwise("failed")
    return docs.groupBy(F.coalesce("source", F.lit("unknown")).alias("source"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(f"SELECT role = 'assistant' AS is_answer, count(*) AS n, {ratio_sql('sum(CASE WHEN length(text) < 200 THEN 1 ELSE 0 END)', 'count(*)')} AS short_rate FROM conversations GROUP BY 1")
def cache_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conditional share among all rows of a kind (as of cached among all answers)."""
    rows = table(spark, sf_dir, "conversations").groupBy((F.col("role") == "assistant").alias("is_answer"))
    return rows.agg(F.count(F.lit(1)).alias("n"), share(F.sum(F.when(F.length("text") < 200, 1).otherwise(0)), F.count(F.lit(1))).alias("short_rate"))


@query(
    f"""SELECT source, count(*) AS total, sum(CASE WHEN rating > 0 THEN 1 ELSE 0 END)::BIGINT AS positive, sum(CASE WHEN rating < 0 THEN 1 ELSE 0 END)::BIGINT AS negative,
  sum(CASE WHEN rating = 0 THEN 1 ELSE 0 END)::BIGINT AS neutral, {ratio_sql("sum(CASE WHEN rating < 0 THEN 1 ELSE 0 END)", "count(*)")} AS negative_rate,
  {ratio_sql("sum(CASE WHEN rating > 0 THEN 1 ELSE 0 END)", "count(*)")} AS positive_rate FROM (SELECT source, 2 * quality - 1 - (toxic = 1 AND quality = 1)::INTEGER AS rating FROM labels JOIN documents USING (doc_id)) GROUP BY source"""
)
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive, negative and neutral ratings (a good but toxic document is rated 0) and their rates."""
    rating = 2 * F.col("quality") - 1 - ((F.col("toxic") == 1) & (F.col("quality") == 1)).cast("int")
    rated = table(spark, sf_dir, "labels").withColumn("rating", rating).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    neutral = F.sum(F.when(F.col("rating") == 0, 1).otherwise(0))
    up, down = (F.sum(F.when(c, 1).otherwise(0)) for c in (F.col("rating") > 0, F.col("rating") < 0))
    return rated.groupBy("source").agg(F.count(F.lit(1)).alias("total"), up.alias("positive"), down.alias("negative"), neutral.alias("neutral"), share(down, F.count(F.lit(1))).alias("negative_rate"), share(up, F.count(F.lit(1))).alias("positive_rate"))


@query("SELECT source, round(avg(2 * quality - 1), 6) AS mean_rating, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source HAVING avg(2 * quality - 1) <= 0.75 ORDER BY mean_rating, source LIMIT 100")
def low_quality_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    means = rated.groupBy("source").agg(F.avg(2 * F.col("quality") - 1).alias("m"), F.count(F.lit(1)).alias("n")).filter("m <= 0.75")
    return means.select("source", F.round("m", 6).alias("mean_rating"), "n").orderBy("mean_rating", "source").limit(100)


def nearest_place(rows: DataFrame, keys: list[str], value: str, place: Column, share_of: float = 0.95) -> DataFrame:
    """The value at a 0-based place (an expression of n, the group's count, near share_of * n) among a group's sorted values.

    A sketch brackets the place for groups of 1,000 rows and more (its error of 0.1 % of the ranks is far inside the 2 % on each side);
    what lies below the bracket is only counted, what lies above goes, and only the bracket's distinct values are ordered.
    """
    ends = [max(0.0, share_of - 0.02), min(1.0, share_of + 0.02)]
    sketch = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile_approx(value, ends, 1000).alias("ends"))
    wide = F.col("n") >= 1000
    met = rows.filter(F.col(value).isNotNull()).join(sketch, keys).filter(~wide | (F.col(value) <= F.col("ends")[1]))
    counted = met.groupBy(*keys, "n", F.when(~wide | (F.col(value) >= F.col("ends")[0]), F.col(value)).alias(value)).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("upto", F.sum("c").over(order))
    return upto.filter((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place))


@query("SELECT event_type, v[(floor(0.95 * (n - 1)))::BIGINT + 1] AS p95, n FROM (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY event_type)")
def latency_p95_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sorted[int(0.95 * (n - 1))]."""
    out = nearest_place(table(spark, sf_dir, "events"), ["event_type"], "value", F.floor(0.95 * (F.col("n") - 1)))
    return out.select("event_type", F.col("value").alias("p95"), "n")


@query("SELECT event_type, v[greatest(floor(n * 0.95)::BIGINT - 1, 0) + 1] AS p95, n FROM (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY event_type)")
def latency_p95_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sorted[max(int(0.95 * n) - 1, 0)]."""
    out = nearest_place(table(spark, sf_dir, "events"), ["event_type"], "value", F.greatest(F.floor(F.col("n") * 0.95) - 1, F.lit(0)))
    return out.select("event_type", F.col("value").alias("p95"), "n")


@query(
    f"""SELECT user_id % 5 AS backend, count(*) AS requests, {ratio_sql("sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)", "count(*)")} AS success_rate,
  {ratio_sql("sum(CASE WHEN value > 100 THEN 1 ELSE 0 END)", "count(*)")} AS slow_rate, arg_max(event_type, (ts, event_id)) AS last_type, max(ts) AS last_ts FROM events GROUP BY 1"""
)
def backend_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    rate = lambda c: share(F.sum(F.when(c, 1).otherwise(0)), F.count(F.lit(1)))
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("backend")).agg(
        n.alias("requests"), rate(F.col("event_type") != "error").alias("success_rate"), rate(F.col("value") > 100).alias("slow_rate"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("ts").alias("last_ts"),
    )


KINDS = ("click", "error", "purchase", "signup", "view")


@query(f"SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, {', '.join(f'''count(*) FILTER (WHERE event_type = '{k}') AS n_{k}''' for k in KINDS)}, count(*) FILTER (WHERE event_type NOT IN {KINDS}) AS n_other FROM events GROUP BY 1")
def hourly_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each kind by hour; kinds that are not listed count as other."""
    rows = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"))
    return rows.agg(*[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in KINDS], F.count_if(~F.col("event_type").isin(*KINDS)).alias("n_other"))


@query("WITH t AS (SELECT user_id, count(*) AS total FROM events GROUP BY user_id ORDER BY total DESC, user_id LIMIT 20) SELECT user_id, event_type, count(*) AS n, any_value(total) AS total FROM events JOIN t USING (user_id) GROUP BY user_id, event_type")
def decision_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each kind for the twenty most active users (a tool by decision matrix)."""
    rows = table(spark, sf_dir, "events")
    top = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "user_id").limit(20)
    return rows.join(F.broadcast(top), "user_id").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total"))


@query("SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_type = 'error' OR value > 400 ORDER BY ts DESC, event_id LIMIT 50")
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter((F.col("event_type") == "error") | (F.col("value") > 400))
    return rows.select("event_id", "ts", "user_id", "event_type", "value").orderBy(F.desc("ts"), "event_id").limit(50)


SIGNATURE_SQL = r"left(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[0-9a-f]{{8,}}', '<hex>', 'g'), '\d{{2,}}', '<num>', 'g'), '\s+', ' ', 'g')), 120)"


@query(
    f"""SELECT sig AS signature, count(*) AS n, max(ts) AS last_ts, arg_min(event_id, event_id) AS first_event, count(*) FILTER (WHERE value > 100) AS n_large
  FROM (SELECT *, {SIGNATURE_SQL.format("event_type || ' at ' || user_id || ' ' || props")} AS sig FROM events WHERE event_type = 'error') GROUP BY sig"""
)
def failure_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by the signature of their message: count, last time, first example."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'")
    message = F.concat(F.col("event_type"), F.lit(" at "), F.col("user_id").cast("string"), F.lit(" "), F.col("props"))
    return rows.groupBy(error_signature(message).alias("signature")).agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"), F.min("event_id").alias("first_event"), F.count_if(F.col("value") > 100).alias("n_large")
    )


@query("SELECT source, 2 * quality - 1 - (toxic = 1 AND quality = 1)::INTEGER AS rating, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL ORDER BY source, rating DESC")
def rating_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ratings of each value a source has, the best first."""
    rating = 2 * F.col("quality") - 1 - ((F.col("toxic") == 1) & (F.col("quality") == 1)).cast("int")
    rated = table(spark, sf_dir, "labels").select("doc_id", rating.alias("rating")).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rated.groupBy("source", "rating").agg(F.count(F.lit(1)).alias("n")).orderBy("source", F.desc("rating"))


ACTIVE_STATES, FAILED_STATES, DONE_STATE = ("queued", "parsing", "chunking", "indexing", "retrying"), ("failed", "partial_failed"), "ready"


def state_counts(status: Column) -> list[Column]:
    """active (queued ones among them), queued, failed and completed; other states and null count nowhere."""
    return [
        F.count_if(status.isin(*ACTIVE_STATES)).alias("active"), F.count_if(status == "queued").alias("queued"),
        F.count_if(status.isin(*FAILED_STATES)).alias("failed"), F.count_if(status == DONE_STATE).alias("completed"),
    ]


@query(
    """SELECT user_id, count(*) FILTER (WHERE event_type != 'error') AS sent, count(*) FILTER (WHERE event_type = 'error') AS failed,
  CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'ok' ELSE 'partial_failed' END AS status FROM events GROUP BY user_id"""
)
def delivery_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sent and failed deliveries of each user (errors are failed ones); one failed delivery makes the whole partly failed."""
    failed = F.count_if(F.col("event_type") == "error")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("sent"), failed.alias("failed"))
    return rows.withColumn("status", F.when(F.col("failed") == 0, "ok").otherwise("partial_failed"))


@query("SELECT event_type IN ('view', 'click') AS active, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS value FROM events GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").isin("view", "click").alias("active"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("value"))


CHECKS = (("has_events", 20, "count(*) > 0"), ("few_errors", 25, "avg((event_type = 'error')::INTEGER) < 0.25"), ("sells", 15, "count(*) FILTER (WHERE event_type = 'purchase') > 10"), ("low_values", 40, "max(value) < 200"))


@query(f"SELECT user_id % 10 AS grp, round(({' + '.join(f'CASE WHEN {c} THEN {w} ELSE 0 END' for _, w, c in CHECKS)}) / 100.0 * 100, 2) AS score, ({' + '.join(f'CASE WHEN {c} THEN {w} ELSE 0 END' for _, w, c in CHECKS)}) >= 85 AS ready FROM events GROUP BY 1")
def readiness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted checks by group; ready from 85 of 100."""
    kind = F.col("event_type")
    checks = [(20, F.count(F.lit(1)) > 0), (25, F.avg((kind == "error").cast("int")) < 0.25), (15, F.count_if(kind == "purchase") > 10), (40, F.max("value") < 200)]
    total = sum((F.when(c, w).otherwise(0) for w, c in checks), F.lit(0))
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("grp")).agg(total.alias("points"))
    return rows.select("grp", F.round(F.col("points") / 100.0 * 100, 2).alias("score"), (F.col("points") >= 85).alias("ready"))


@query("SELECT event_type, user_id % 3 AS route, count(*) AS n, round(avg(value), 4) AS mean_ms, max(value) AS max_ms, count(*) FILTER (WHERE value >= 100) AS slow FROM events GROUP BY ALL ORDER BY mean_ms DESC, max_ms DESC, event_type, route LIMIT 10")
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).alias("route"))
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_ms"), F.max("value").alias("max_ms"), F.count_if(F.col("value") >= 100).alias("slow"))
    return out.orderBy(F.desc("mean_ms"), F.desc("max_ms"), "event_type", "route").limit(10)


@query("SELECT 'http_requests{kind=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type UNION ALL SELECT 'http_max_value{kind=\"' || event_type || '\"} ' || printf('%.3f', max(value)) FROM events GROUP BY event_type")
def prometheus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and maxima in a metrics exporter's text format."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("m"))
    lines = F.array(F.format_string('http_requests{kind="%s"} %d', "event_type", "n"), F.format_string('http_max_value{kind="%s"} %.3f', "event_type", "m"))
    return rows.select(F.explode(lines).alias("line"))


@query("SELECT conv_id, count(*) AS n, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)::BIGINT AS n_user FROM conversations GROUP BY conv_id")
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count and latest values of each session."""
    last = F.max_by(F.struct("role", "text"), "turn")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), last.alias("last"), F.count_if(F.col("role") == "user").alias("n_user"))
    return rows.select("conv_id", "n", F.col("last.role").alias("last_role"), F.col("last.text").alias("last_text"), "n_user")


@query(
    r"""SELECT role, sum(CASE WHEN w = 0 THEN 0 WHEN w > 1 THEN w ELSE greatest(1, length(text) // 2) END)::BIGINT AS tokens
  FROM (SELECT role, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM conversations) GROUP BY role"""
)
def usage_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(tokens_for_usage(F.col("text"))).alias("tokens"))


@query(
    f"""SELECT d.tenant AS tenant, n_docs, n_chars, n_rated, {ratio_sql("coalesce(good, 0)", "coalesce(n_rated, 0)")} AS good_rate, {ratio_sql("coalesce(toxic, 0)", "coalesce(n_rated, 0)")} AS toxic_rate FROM
  (SELECT source AS tenant, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, count(quality) AS n_rated, sum(quality) AS good, sum(toxic) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source) d"""
)
def tenant_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant's dashboard in one pass: counts, sizes and shares."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("tenant"), "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rated = F.count("quality")
    return rows.groupBy("tenant").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"), rated.alias("n_rated"),
        share(F.coalesce(F.sum("quality"), F.lit(0)), rated).alias("good_rate"), share(F.coalesce(F.sum("toxic"), F.lit(0)), rated).alias("toxic_rate"),
    )


@query("SELECT status, lang, count(*) AS n FROM (SELECT lang, CASE WHEN quality = 1 AND toxic = 0 THEN 'approved' WHEN quality = 0 THEN 'rejected' ELSE 'pending' END AS status FROM labels JOIN documents USING (doc_id)) GROUP BY GROUPING SETS ((status), (lang))")
def qa_pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status and by language in one pass (grouping sets)."""
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "approved").when(F.col("quality") == 0, "rejected").otherwise("pending")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select(status.alias("status"), "lang")
    return rows.groupingSets([["status"], ["lang"]], "status", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, ts, event_id, value, prev_value, round(value - prev_value, 4) AS delta FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS newest FROM events) WHERE newest = 1")
def drift_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest value against the one before."""
    by_user = Window.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").withColumns({"prev_value": F.lag("value").over(by_user.orderBy("ts", "event_id")), "newest": F.row_number().over(by_user.orderBy(F.desc("ts"), F.desc("event_id")))})
    return rows.filter("newest = 1").select("user_id", "ts", "event_id", "value", "prev_value", F.round(F.col("value") - F.col("prev_value"), 4).alias("delta"))


LAST = 1000


@query(f"SELECT backend, count(*) AS n, round(avg(value), 4) AS mean, min(ts) AS since, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors FROM (SELECT *, user_id % 5 AS backend, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= {LAST} GROUP BY backend")
def latency_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the newest thousand requests of each backend; older ones are dropped before the shuffle by the window's group limit."""
    rows = table(spark, sf_dir, "events").withColumn("backend", F.col("user_id") % 5)
    newest = rows.withColumn("back", F.row_number().over(Window.partitionBy("backend").orderBy(F.desc("ts"), F.desc("event_id")))).filter(F.col("back") <= LAST)
    return newest.groupBy("backend").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.min("ts").alias("since"), F.count_if(F.col("event_type") == "error").alias("errors"))
