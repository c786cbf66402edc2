"""Entities and relations of documents, intent and evidence rules, and evaluation of answers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markers
from ..functions import text as tx
from ..plans.registry import query
from ..plans.session import kept, table
from .analytics import share
from .documents import any_sql

ENTITIES = 10
ENTITY_SQL = "list_slice(list_transform(list_sort(list_transform(list_distinct(r), lambda x: {'p': list_position(r, x), 'x': x})), lambda s: s.x), 1, 10)"
CAPITAL_SQL = r"regexp_extract_all(text, '[A-Z][a-z]{3,}')"


def entities(text: Column) -> Column:
    """Up to ten distinct capitalised words; for CJK text pass runs() of two or more."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit("([A-Z][a-z]{3,})"), F.lit(1))), 1, ENTITIES)


RELATIONS = (*markers.RELATION_WORDS, ("references", ("see ",)), ("amends", ("from ",)))


def edges(docs: DataFrame) -> DataFrame:
    """(doc_id, tenant_id, source, relationship, target): neighbours among a document's entities, once each."""
    found = docs.select("doc_id", F.col("source").alias("tenant_id"), entities(F.col("text")).alias("e"), tx.first_rule(F.col("text"), RELATIONS, "related_to").alias("relationship")).filter(F.size("e") >= 2)
    pairs = F.transform(F.sequence(F.lit(1), F.size("e") - 1), lambda i: F.struct(F.get("e", i - 1).alias("source"), F.get("e", i).alias("target")))
    return found.select("doc_id", "tenant_id", "relationship", F.explode(pairs).alias("p")).select("doc_id", "tenant_id", "p.source", "relationship", "p.target").distinct()


def _relation_sql() -> str:
    return "CASE " + " ".join(f"WHEN {any_sql('text', w)} THEN '{n}'" for n, w in RELATIONS) + " ELSE 'related_to' END"


EDGES_SQL = f"""e AS (SELECT doc_id, source AS tenant_id, {ENTITY_SQL} AS e, {_relation_sql()} AS relationship FROM (SELECT *, {CAPITAL_SQL} AS r FROM documents)),
  g AS (SELECT DISTINCT doc_id, tenant_id, e[i] AS source, relationship, e[i + 1] AS target FROM (SELECT *, unnest(range(1, len(e))) AS i FROM e WHERE len(e) >= 2))"""


@query(f"WITH {EDGES_SQL} SELECT * FROM g")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(table(spark, sf_dir, "documents"))


@query(f"WITH {EDGES_SQL} SELECT source, relationship, target, count(*) AS n_docs, min(doc_id) AS first_doc FROM g WHERE lower(source) LIKE '%tion%' OR lower(target) LIKE '%tion%' GROUP BY ALL")
def graph_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges around entities that hold a term, with the documents that state them."""
    near = F.lower("source").contains("tion") | F.lower("target").contains("tion")
    return edges(table(spark, sf_dir, "documents")).filter(near).groupBy("source", "relationship", "target").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


#: Edges of a task's side, on average (small inputs are cut up to LEAST times anyway); the share of a task's far ends from which a middle's are kept as a row of flags, in so many bytes.
SIDE, LEAST, COMMON, DENSE = 1_000_000, 4, 20, 1 << 26


def two_hop(steps: DataFrame, side: int = SIDE) -> DataFrame:
    """(entity, reach) of distinct edges (source, target): how many other entities two steps lead to.

    First steps are dealt into blocks by where they begin and second ones into parts by where they end. A task marks the ends in its part for one
    entity after another; parts share no end, so their numbers add up and no pair of steps becomes a row. Middles and ends are told apart by 64-bit hashes.
    """
    edges_in = steps.count()
    n = max(1, math.ceil(edges_in / side), min(LEAST, edges_in * 16 // side))
    upto = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    code, place = (lambda c: F.xxhash64(F.col(c))), (lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(1)), F.lit(n)).cast("int"))
    left = steps.filter("source IS NOT NULL").select(F.col("source").alias("entity"), code("source").alias("own"), code("target").alias("mid"), place("source").alias("block"), upto.alias("part"))
    right = steps.filter("target IS NOT NULL").select(code("source").alias("mid"), code("target").alias("far"), place("target").alias("part"), upto.alias("block"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"entity": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        far, end = np.unique(b["far"].to_numpy(), return_inverse=True)
        by = np.argsort(b["mid"].to_numpy(), kind="stable")
        mids, first = np.unique(b["mid"].to_numpy()[by], return_index=True)
        end, last = end[by].astype(np.int32), np.append(first[1:], len(by))
        known = np.isin(a["mid"].to_numpy(), mids)
        a = a.filter(pa.array(known))
        coded = a["entity"].combine_chunks().dictionary_encode()
        order = np.argsort(coded.indices.to_numpy(), kind="stable")
        entity, own = coded.indices.to_numpy()[order], a["own"].to_numpy()[order]
        slots = np.searchsorted(mids, a["mid"].to_numpy()[order])
        starts = np.flatnonzero(np.r_[True, entity[1:] != entity[:-1]]) if len(entity) else np.array([], dtype=int)
        rows: dict[int, np.ndarray] = {}
        counts = np.zeros(len(starts), dtype=np.int64)
        for i, (s, e) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(entity)], strict=False)):
            flags = np.zeros(len(far), dtype=bool)
            for j in slots[s:e].tolist():
                x, y = first[j], last[j]
                if (y - x) * COMMON > len(far) and (j in rows or (len(rows) + 1) * len(far) <= DENSE):
                    if j not in rows:
                        rows[j] = np.zeros(len(far), dtype=bool)
                        rows[j][end[x:y]] = True
                    flags |= rows[j]
                else:
                    flags[end[x:y]] = True
            at = np.searchsorted(far, own[s])
            counts[i] = np.count_nonzero(flags) - int(at < len(far) and far[at] == own[s] and flags[at])
        return pa.table({"entity": coded.dictionary.take(pa.array(entity[starts])).cast(pa.string()), "n": counts})

    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(run, "entity string, n bigint")
    return found.groupBy("entity").agg(F.sum("n").alias("reach")).filter("reach > 0")


@query(f"WITH {EDGES_SQL} SELECT a.source AS entity, count(DISTINCT b.target) AS reach FROM (SELECT DISTINCT source, target FROM g) a JOIN (SELECT DISTINCT source, target FROM g) b ON a.target = b.source WHERE b.target <> a.source GROUP BY a.source")
def graph_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entities two steps reach."""
    return two_hop(kept(edges(table(spark, sf_dir, "documents")).select("source", "target").distinct()))


# Intent and evidence ---------------------------------------------------------------------------------------------------

# Words of the driver's tables added to the lists, which are parameters.
ASKS_COMPARE, ASKS_STATISTICS, ASKS_GRAPH, ASKS_SUMMARY = (*markers.COMPARE_WORDS, "with the"), (*markers.STATISTICS_WORDS, "from the"), (*markers.GRAPH_WORDS, "that the"), (*markers.SUMMARY_WORDS, "of the")
INTENT_SQL = f"CASE WHEN {any_sql('lower(text)', ASKS_COMPARE)} THEN 'compare' WHEN {any_sql('lower(text)', ASKS_STATISTICS)} THEN 'statistics' WHEN {any_sql('lower(text)', ASKS_GRAPH)} THEN 'graph_query' WHEN {any_sql('lower(text)', ASKS_SUMMARY)} THEN 'summarize' ELSE 'qa' END"


def intent(text: Column) -> Column:
    return tx.first_rule(F.lower(text), (("compare", ASKS_COMPARE), ("statistics", ASKS_STATISTICS), ("graph_query", ASKS_GRAPH), ("summarize", ASKS_SUMMARY)), "qa")


@query(
    f"""SELECT conv_id, turn, intent, CASE intent WHEN 'compare' THEN 'compare' WHEN 'summarize' THEN 'summary' WHEN 'statistics' THEN 'extract' WHEN 'graph_query' THEN 'process' ELSE 'qa' END AS task_mode,
  CASE WHEN intent IN ('compare', 'summarize') THEN 10 ELSE 6 END AS top_k FROM (SELECT *, {INTENT_SQL} AS intent FROM conversations WHERE role = 'user')"""
)
def intent_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent, task mode and retrieval plan of each question; the plan table has a row for each intent."""
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", intent(F.col("text")).alias("intent"))
    modes = {"compare": "compare", "summarize": "summary", "statistics": "extract", "graph_query": "process"}
    plans = spark.createDataFrame([(i, modes.get(i, "qa"), k) for i, k, _, _ in markers.RETRIEVAL_PLANS], "intent string, task_mode string, top_k int")
    return asked.join(F.broadcast(plans), "intent").select("conv_id", "turn", "intent", "task_mode", "top_k")


EVIDENCE = tuple((n, (*w, *extra)) for (n, w), extra in zip(markers.EVIDENCE_WORDS, (("from",), ("must",), ("version",), ("MIT",), ("but",)), strict=True))
DATE = "[0-9]{4}年|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
EVIDENCE_SQL = f"CASE WHEN length(text) - length(replace(text, '|', '')) >= 6 OR regexp_matches(text, '[0-9][0-9,]{{2,}}(\\.[0-9]+)?') THEN 'numeric' {' '.join(f'''WHEN {any_sql('text', w)} THEN '{n}' ''' for n, w in EVIDENCE)} WHEN regexp_matches(text, '{DATE}') THEN 'versioning' ELSE 'general' END"


def evidence(text: Column) -> Column:
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    tabular = (pipes >= 6) | text.rlike(r"[0-9][0-9,]{2,}(?:\.[0-9]+)?")
    return F.when(tabular, "numeric").otherwise(tx.first_rule(text, EVIDENCE, F.when(text.rlike(DATE), "versioning").otherwise("general")))


@query(f"SELECT doc_id, {EVIDENCE_SQL} AS category FROM documents")
def evidence_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", evidence(F.col("text")).alias("category"))


@query(
    f"""SELECT source, any_value(n) AS n, arg_max(category, (c, -first)) AS dominant FROM (SELECT source, category, count(*) AS c, min(doc_id) AS first, sum(count(*)) OVER (PARTITION BY source)::BIGINT AS n
  FROM (SELECT source, doc_id, {EVIDENCE_SQL} AS category FROM documents) GROUP BY source, category) GROUP BY source"""
)
def evidence_pack_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading category of each source; of equals the one seen first."""
    each = table(spark, sf_dir, "documents").groupBy("source", evidence(F.col("text")).alias("category")).agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("first"))
    return each.groupBy("source").agg(F.sum("c").alias("n"), F.max_by("category", F.struct("c", -F.col("first"))).alias("dominant"))


@query(r"SELECT doc_id, list_count(p) AS n_points, array_to_string(p, ' / ') AS points FROM (SELECT doc_id, list_slice(list_filter(list_transform(string_split_regex(text, '[.;!?\n]'), lambda x: trim(x)), lambda x: length(x) >= 12), 1, 3) AS p FROM documents) WHERE len(p) > 0")
def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three sentences of twelve characters or more."""
    points = F.slice(F.filter(F.transform(F.split("text", r"[.;!?\n]"), lambda x: F.trim(x)), lambda x: F.length(x) >= 12), 1, 3)
    rows = table(spark, sf_dir, "documents").select("doc_id", points.alias("p")).filter(F.size("p") > 0)
    return rows.select("doc_id", F.size("p").cast("long").alias("n_points"), F.array_join("p", " / ").alias("points"))


# Evaluation -------------------------------------------------------------------------------------------------------------

SET_SQL = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda x: x <> ''))"


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""))


def overlap(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


OVERLAP_SQL = "CASE WHEN len({0}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / len({0}) END"
ANSWERS_SQL = f"""a AS (SELECT conv_id, turn, {SET_SQL.format("text")} AS ans, {SET_SQL.format("question")} AS q, {SET_SQL.format("context")} AS ctx FROM (
  SELECT *, lag(text) OVER w AS question, coalesce(lag(text, 2) OVER w, '') AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND question IS NOT NULL)"""


def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer against its question (the turn before) and its context (the one before that)."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumns({"question": F.lag("text").over(w), "context": F.coalesce(F.lag("text", 2).over(w), F.lit(""))})
    sets = rows.filter("role = 'assistant' AND question IS NOT NULL").select("conv_id", "turn", word_set(F.col("text")).alias("ans"), word_set(F.col("question")).alias("q"), word_set(F.col("context")).alias("ctx"))
    return sets.select(
        "conv_id", "turn", overlap(F.col("ans"), F.col("ctx")).alias("faithfulness"), overlap(F.col("ans"), F.array_union("q", "ctx")).alias("relevancy"), overlap(F.col("ctx"), F.col("ans")).alias("precision")
    )


SCORES_SQL = f"s AS (SELECT conv_id, turn, {OVERLAP_SQL.format('ans', 'ctx')} AS faithfulness, {OVERLAP_SQL.format('ans', 'list_distinct(list_concat(q, ctx))')} AS relevancy, {OVERLAP_SQL.format('ctx', 'ans')} AS precision FROM a)"


@query(f"WITH {ANSWERS_SQL}, {SCORES_SQL} SELECT conv_id, turn, round(faithfulness, 4) AS faithfulness, round(relevancy, 4) AS relevancy, round(precision, 4) AS precision FROM s")
def eval_overlap_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_answers(spark, sf_dir).select("conv_id", "turn", *[F.round(c, 4).alias(c) for c in ("faithfulness", "relevancy", "precision")])


GATES = {"faithfulness": 0.1, "relevancy": 0.1, "precision": 0.4}


@query(
    f"""WITH {ANSWERS_SQL}, {SCORES_SQL}, m AS (SELECT unnest(['faithfulness', 'relevancy', 'precision']) AS metric, unnest([round(avg(faithfulness), 4), round(avg(relevancy), 4), round(avg(precision), 4)]) AS value, unnest({list(GATES.values())}) AS least FROM s)
  SELECT metric, value, least::DOUBLE AS least, value >= least AS passed FROM m"""
)
def eval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics against their thresholds."""
    means = scored_answers(spark, sf_dir).agg(*[F.round(F.avg(m), 4).alias(m) for m in GATES])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).alias("least")) for m, t in GATES.items()]))
    return means.select(rows.alias("r")).select("r.*").withColumn("passed", F.col("value") >= F.col("least"))


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, round(avg(n_chars), 2) AS mean_chars, round(avg(quality), 4) AS good FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.round(F.avg("n_chars"), 2).alias("mean_chars"), F.round(F.avg("quality"), 4).alias("good"))


@query("SELECT toxic, count(*) AS n, CASE WHEN count(*) <= 0 THEN 0.0 ELSE round(sum(quality) / count(*), 4) END AS good_rate FROM labels GROUP BY toxic")
def label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), share(F.sum("quality"), F.count(F.lit(1))).alias("good_rate"))
