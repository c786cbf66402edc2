"""Predicates and rules on answers and results: excerpts, evidence packs, recall, cache policy, permissions, merging of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markers
from ..functions import text as tx
from ..plans.registry import query
from ..plans.session import LIBRARY_SQL, library, table
from .analytics import share
from .documents import any_sql
from .search import BM25_SQL, COSINE_SQL, EVERY, VECTORS_SQL, asking, best, bm25_ranked, cosine_ranked, hit_documents, synthetic_title, vector_index, vectors

SYNTHETIC_SQL = "regexp_full_match(lower({}), '" + "|".join(markers.SYNTHETIC_TITLES) + "')"


@query(
    f"""SELECT page_id, name, {SYNTHETIC_SQL.format("name")} AS synthetic FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'tmp' || page_id || '.csv' ELSE regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) END AS name FROM pages)"""
)
def synthetic_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names that tests and load runs leave behind."""
    name = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("tmp"), F.col("page_id").cast("string"), F.lit(".csv"))).otherwise(F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name")).select("page_id", "name", synthetic_title(F.col("name")).alias("synthetic"))


def boilerplate(text: Column) -> Column:
    """Two or more marks of a page's footer."""
    return sum((text.contains(m).cast("int") for m in markers.FOOTER_MARKS), F.lit(0)) >= 2


def low_information(content: Column, title: Column, section: Column) -> Column:
    """Empty; up to 32 characters that only repeat title or section; up to 12 of a page's frame; or boilerplate."""
    bare = lambda c: F.replace(F.replace(c, F.lit(".html"), F.lit("")), F.lit(".pdf"), F.lit(""))
    text = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", " "))
    low, named = F.lower(text), F.trim(F.lower(F.coalesce(title, F.lit(""))))
    known = F.array(named, bare(named), F.trim(F.lower(F.coalesce(section, F.lit("")))), F.concat(bare(named), F.lit("-信息公开")))
    repeats = (F.array_contains(known, low) | F.array_contains(known, bare(low))) & (F.length(text) <= 32)
    return (text == "") | repeats | ((F.length(text) <= 12) & (text.contains("信息公开") | text.contains("版权所有"))) | boilerplate(text)


_TEXT_SQL = r"trim(regexp_replace(coalesce(content, ''), '\s+', ' ', 'g'))"
LOW_SQL = f"""(x = '' OR (length(x) <= 32 AND (lower(x) IN (tl, bt, sl, bt || '-信息公开') OR replace(replace(lower(x), '.html', ''), '.pdf', '') IN (tl, bt, sl, bt || '-信息公开')))
  OR (length(x) <= 12 AND (contains(x, '信息公开') OR contains(x, '版权所有'))) OR ({' + '.join(f"contains(x, '{m}')::INTEGER" for m in markers.FOOTER_MARKS)}) >= 2)"""
LOW_FROM_SQL = f"(SELECT *, replace(replace(tl, '.html', ''), '.pdf', '') AS bt FROM (SELECT *, {_TEXT_SQL} AS x, trim(lower(coalesce(title, ''))) AS tl, trim(lower(coalesce(section, ''))) AS sl FROM lib))"


@query(f"WITH {LIBRARY_SQL} SELECT tenant_id, count(*) FILTER (WHERE {LOW_SQL}) AS n_low, count(*) AS n FROM {LOW_FROM_SQL} GROUP BY tenant_id")
def low_information_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = library(spark, sf_dir).groupBy("tenant_id")
    return rows.agg(F.count_if(low_information(F.col("content"), F.col("title"), F.col("section"))).alias("n_low"), F.count(F.lit(1)).alias("n"))


EXCERPT = 80


def excerpt(text: Column, word: str, width: int = EXCERPT) -> Column:
    """width characters around the first match (a quarter before it), or the start."""
    at = F.instr(text, word)
    return F.substr(text, F.greatest(F.lit(1), at - width // 4), F.lit(width + width // 4))


@query(f"SELECT doc_id, strpos(text, 'Licensed') AS found_at, substr(text, greatest(1, strpos(text, 'Licensed') - {EXCERPT // 4}), {EXCERPT + EXCERPT // 4}) AS excerpt FROM documents WHERE contains(text, 'Licensed')")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.col("text").contains("Licensed"))
    return docs.select("doc_id", F.instr("text", "Licensed").cast("long").alias("found_at"), excerpt(F.col("text"), "Licensed").alias("excerpt"))


@query(
    f"""WITH {BM25_SQL}, h AS (SELECT item_id, tenant_id, title, rank FROM bmr JOIN sec USING (doc_id) WHERE rank <= 40), n AS (SELECT *, row_number() OVER (PARTITION BY item_id, tenant_id ORDER BY rank) AS within FROM h)
  SELECT item_id, tenant_id, count(*) AS n_hits, min(rank) AS best_rank, string_agg(title, ' / ' ORDER BY rank) FILTER (WHERE within <= 3) AS points FROM n GROUP BY item_id, tenant_id"""
)
def evidence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each query by tenant: how many, the best rank, and the first three titles; a query has at most 40 hits."""
    found = bm25_ranked(spark, sf_dir, 40)
    hits = found.join(hit_documents(spark, sf_dir, found, 40).select("doc_id", "tenant_id", "title"), "doc_id")
    rows = hits.groupBy("item_id", "tenant_id").agg(F.count(F.lit(1)).alias("n_hits"), F.min("rank").alias("best_rank"), F.sort_array(F.collect_list(F.struct("rank", "title"))).alias("t"))
    return rows.select("item_id", "tenant_id", "n_hits", "best_rank", F.array_join(F.transform(F.slice("t", 1, 3), lambda x: x["title"]), " / ").alias("points"))


@query(
    f"""WITH {BM25_SQL}, s AS (SELECT item_id, substr(text, 1, 24) AS probe FROM benchmark), h AS (SELECT item_id, bool_or(contains(content, probe)) AS hit FROM bmr JOIN sec USING (doc_id) JOIN s USING (item_id) WHERE rank <= 10 GROUP BY item_id)
  SELECT s.item_id, coalesce(hit, false) AS hit FROM s LEFT JOIN h USING (item_id)"""
)
def sample_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one of a query's ten best documents holds the start of the query itself."""
    samples = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 24).alias("probe"))
    hits = bm25_ranked(spark, sf_dir, 10).join(library(spark, sf_dir).select("doc_id", "content"), "doc_id").join(samples, "item_id")
    found = hits.groupBy("item_id").agg(F.max(F.col("content").contains(F.col("probe"))).alias("hit"))
    return samples.join(found, "item_id", "left").select("item_id", F.coalesce("hit", F.lit(False)).alias("hit"))


LIKE, CANDIDATES = 0.95, 3


@query(
    f"""WITH {VECTORS_SQL}, cs AS (SELECT c.vec_id AS query_id, c.label AS scope, e.vec_id, e.label, round({COSINE_SQL}, 6) AS score FROM vec e, vec c WHERE c.vec_id % {EVERY} = 0 AND e.vec_id % {EVERY} != 0
), cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cs)
SELECT query_id, arg_min(vec_id, rank) FILTER (WHERE score >= {LIKE} AND label = scope) AS cached, count(*) FILTER (WHERE score >= {LIKE} AND label = scope) > 0 AS hit FROM cr WHERE rank <= {CANDIDATES} GROUP BY query_id"""
)
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored vector that answers a question: the first of the three nearest that is near enough and of the asker's own scope."""
    rows = vectors(spark, sf_dir)
    near = cosine_ranked(vector_index(spark, sf_dir), asking(rows), CANDIDATES, rows.filter(F.col("id") % EVERY != 0))
    scopes = rows.select(F.col("id").alias("query_id"), F.col("label").alias("scope"))
    met = near.join(rows.select(F.col("id").alias("vec_id"), "label"), "vec_id").join(scopes, "query_id")
    good = (F.col("score") >= LIKE) & (F.col("label") == F.col("scope"))
    return met.groupBy("query_id").agg(F.min_by(F.when(good, F.col("vec_id")), F.when(good, F.col("rank"))).alias("cached"), F.max(good).alias("hit"))


@query("SELECT conv_id, turn, length(text) >= 20 AND NOT contains(lower(text), 'sorry') AND NOT contains(text, '??') AS cacheable FROM conversations WHERE role = 'assistant'")
def cacheable_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that a cache may keep: long enough and without marks of a failed answer."""
    text = F.col("text")
    good = (F.length(text) >= 20) & ~F.lower(text).contains("sorry") & ~text.contains("??")
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", good.alias("cacheable"))


FOLLOW_UPS = (*markers.FOLLOW_UP_WORDS, "this", "that")


@query(f"SELECT conv_id, turn, turn > 0 AND ({any_sql('lower(text)', FOLLOW_UPS)} OR length(trim(text)) <= 16) AS follow_up FROM conversations WHERE role = 'user'")
def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that lean on the turns before."""
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'")
    leans = tx.any_of(F.lower("text"), FOLLOW_UPS) | (F.length(F.trim("text")) <= 16)
    return asked.select("conv_id", "turn", ((F.col("turn") > 0) & leans).alias("follow_up"))


@query("SELECT user_id, event_type, CASE WHEN event_type = 'error' THEN 'deny' WHEN value > 100 AND user_id % 4 < 2 THEN 'ask' ELSE 'allow' END AS decision, count(*) AS n FROM events GROUP BY ALL")
def permission_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disabled tools are denied, high risk asks unless the role is senior, all else is allowed."""
    decision = F.when(F.col("event_type") == "error", "deny").when((F.col("value") > 100) & (F.col("user_id") % 4 < 2), "ask").otherwise("allow")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""SELECT domain, count(*) AS n, count(DISTINCT doc_id) AS n_docs, domain IN ('mail7.example.com', 'mail1.example.com') AS blocked FROM
  (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1))) AS domain FROM documents) GROUP BY domain"""
)
def email_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of addresses in the texts, with those that a block list holds."""
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"), F.lit(1))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("d")).select("doc_id", F.lower("d").alias("domain"))
    out = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))
    return out.withColumn("blocked", F.col("domain").isin("mail7.example.com", "mail1.example.com"))


@query("SELECT doc_id, score, n_chars FROM (SELECT doc_id, n_chars, 3 * contains(text, 'the ')::INTEGER + 2 * contains(text, 'License')::INTEGER + (n_chars >= 800)::INTEGER AS score FROM documents) ORDER BY score DESC, n_chars DESC, doc_id LIMIT 400")
def export_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows for an export by additive score, size and id: a top-k report."""
    text = F.col("text")
    score = 3 * text.contains("the ").cast("int") + 2 * text.contains("License").cast("int") + (F.col("n_chars") >= 800).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score"), "n_chars").orderBy(F.desc("score"), F.desc("n_chars"), "doc_id").limit(400)


KEYWORDS = ("the", "License", "der", "les")


@query(f"SELECT keyword, count(*) AS n_docs, count(DISTINCT source) AS n_sources FROM (SELECT doc_id, source, unnest(list_filter({list(KEYWORDS)}, lambda k: contains(text, k))) AS keyword FROM documents) GROUP BY keyword")
def keyword_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and sources that hold each keyword of a list, in one pass."""
    held = F.filter(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.col("text").contains(k))
    rows = table(spark, sf_dir, "documents").select("source", F.explode(held).alias("keyword"))
    return rows.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_docs"), F.count_distinct("source").alias("n_sources"))


@query(
    """WITH u AS (SELECT conv_id, turn, text, 1 AS list_no FROM conversations WHERE role = 'user' AND turn = 0 UNION ALL SELECT conv_id, turn, text, 2 FROM conversations WHERE role = 'user'),
  d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY list_no, conv_id, turn) AS first FROM u) SELECT conv_id, turn, list_no FROM d WHERE first = 1 ORDER BY list_no, conv_id, turn LIMIT 200"""
)
def merged_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual samples first, then generated ones that are new, up to a set size."""
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    both = asked.filter("turn = 0").withColumn("list_no", F.lit(1)).unionByName(asked.withColumn("list_no", F.lit(2)))
    unique = best(both, ["text"], [F.asc("list_no"), F.asc("conv_id"), F.asc("turn")], 1, "first")
    return unique.orderBy("list_no", "conv_id", "turn").limit(200).select("conv_id", "turn", "list_no")


@query(
    """WITH m AS (SELECT user_id, event_type, date_trunc('minute', ts) AS minute, min(CASE WHEN value > 10 THEN 1 ELSE 2 END) AS source_no, count(*) AS n FROM events GROUP BY ALL)
  SELECT user_id, event_type, minute::TIMESTAMP AS minute, CASE WHEN n > 1 THEN 'merged' WHEN source_no = 1 THEN 'audit' ELSE 'runtime' END AS channel FROM m"""
)
def merged_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one decision from two channels, matched by minute; the audit channel wins."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.date_trunc("minute", "ts").alias("minute"))
    rows = rows.agg(F.min(F.when(F.col("value") > 10, 1).otherwise(2)).alias("source_no"), F.count(F.lit(1)).alias("n"))
    channel = F.when(F.col("n") > 1, "merged").when(F.col("source_no") == 1, "audit").otherwise("runtime")
    return rows.select("user_id", "event_type", "minute", channel.alias("channel"))


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'missing' WHEN toxic = 1 THEN 'blocked' WHEN quality = 0 THEN 'rejected' WHEN n_chars < 200 THEN 'stale' ELSE 'ready' END AS readiness FROM documents LEFT JOIN labels USING (doc_id)")
def deployment_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first check that a row fails, in order, or ready."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    state = F.when(F.col("quality").isNull(), "missing").when(F.col("toxic") == 1, "blocked").when(F.col("quality") == 0, "rejected").when(F.col("n_chars") < 200, "stale").otherwise("ready")
    return rows.select("doc_id", state.alias("readiness"))


@query("SELECT severity, count(*) AS n, CASE WHEN count(*) <= 0 THEN 0.0 ELSE round(sum(failing) / count(*), 4) END AS failing_rate FROM (SELECT CASE WHEN value > 100 THEN 'high' WHEN value > 20 THEN 'medium' ELSE 'ok' END AS severity, (event_type = 'error')::INTEGER AS failing FROM events) GROUP BY severity")
def control_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("value") > 100, "high").when(F.col("value") > 20, "medium").otherwise("ok")
    rows = table(spark, sf_dir, "events").groupBy(severity.alias("severity"))
    return rows.agg(F.count(F.lit(1)).alias("n"), share(F.sum((F.col("event_type") == "error").cast("int")), F.count(F.lit(1))).alias("failing_rate"))


@query(r"SELECT conv_id, turn, CASE WHEN length(t) > 40 THEN substr(t, 1, 40) || '…' ELSE t END AS title FROM (SELECT conv_id, turn, trim(regexp_replace(string_split_regex(text, '[.!?\n]')[1], '^[#>*0-9. -]+', '')) AS t FROM conversations WHERE role = 'user')")
def session_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title from a question's first sentence, at most 40 characters."""
    t = F.trim(F.regexp_replace(F.split("text", r"[.!?\n]").getItem(0), r"^[#>*0-9. -]+", ""))
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", t.alias("t"))
    return rows.select("conv_id", "turn", F.when(F.length("t") > 40, F.concat(F.substring("t", 1, 40), F.lit("…"))).otherwise(F.col("t")).alias("title"))


@query("SELECT vec_id, list_transform(embedding[1:8], lambda x: round(x::DOUBLE, 4))[1] AS first, len(embedding) AS dim, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS squared FROM embeddings")
def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index upsert checks of each vector: dimension and length."""
    squared = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first"), F.size("embedding").cast("long").alias("dim"), F.round(squared, 4).alias("squared"))


@query("SELECT conv_id, turn, role, lag_role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS lag_role FROM conversations) WHERE role = lag_role OR (turn = 0 AND role = 'assistant')")
def broken_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns out of order: a role that repeats, or an answer first."""
    rows = table(spark, sf_dir, "conversations").withColumn("lag_role", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.filter((F.col("role") == F.col("lag_role")) | ((F.col("turn") == 0) & (F.col("role") == "assistant"))).select("conv_id", "turn", "role", "lag_role")
