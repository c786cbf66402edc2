"""Row rules on titles, snippets, blocks, answers and stored metadata, as column functions, and queries that apply them to whole tables.

The word lists are parameters in markers; where these documents hold none of the words, unit tests on small rows decide the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markers
from ..functions import text as tx
from ..plans.registry import query
from ..plans.session import LIBRARY_SQL, library, table
from .answers import LOW_FROM_SQL, LOW_SQL, low_information
from .chunking import folded, lines, segments
from .documents import any_sql, sliding
from .knowledge import ANSWERS_SQL, SCORES_SQL, scored_answers
from .search import BM25_SQL, best, bm25_ranked, hit_documents, keyword_heavy

HAN = "[一-鿿]"
WORDS = "([一-鿿A-Za-z0-9]{2,})"
SNIPPET = 300


def squashed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def marks(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words text holds."""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def marks_sql(column: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({column}, '{w}')::INTEGER" for w in words) + ")"


# Titles and questions --------------------------------------------------------------------------------------------------


def synthetic_eval_title(title: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return low.rlike("^(?:smoke_|tmp_|test_|sample_)") | low.rlike(r"\.(?:tmp|sample)\.csv$")


def needs_new_title(title: Column) -> Column:
    """Empty, or with the traces of a broken encoding."""
    t = F.trim(F.coalesce(title, F.lit("")))
    broken = (F.regexp_count(t, F.lit(r"\?")) >= 3) | t.contains("�")
    return (t == "") | broken | ((F.regexp_count(t, F.lit("[À-ÿ]")) >= 4) & ~t.rlike(HAN))


def explicit_titles(question: Column) -> Column:
    """Titles in 《》 of 2 to 80 characters and the same without a file's ending; of equal ones up to case, one."""
    found = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit("《([^》]{2,80})》"), F.lit(1))
    both = F.flatten(F.transform(found, lambda t: F.array(F.trim(t), F.regexp_replace(F.trim(t), r"\.[A-Za-z0-9]{2,5}$", ""))))
    return F.array_distinct(F.transform(F.filter(both, lambda t: t != ""), F.lower))


def keyword_path(live: DataFrame, rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, position): hits of the index, but for questions that name a title, or that the index has nothing for, the rows of the table search first.

    live, rows: item_id, doc_id, rank; asked: item_id, phrase. Of a document found twice the first place counts.
    """
    named = asked.select("item_id", (F.size(explicit_titles(F.col("phrase"))) > 0).alias("named")).join(live.select("item_id", F.lit(True).alias("met")).distinct(), "item_id", "left")
    wanted = named.filter(F.col("named") | F.col("met").isNull()).select("item_id")
    both = rows.join(wanted, "item_id", "left_semi").select("item_id", "doc_id", F.lit(1).alias("list_no"), "rank").unionByName(live.select("item_id", "doc_id", F.lit(2).alias("list_no"), "rank"))
    unique = both.groupBy("item_id", "doc_id").agg(F.min(F.struct("list_no", "rank")).alias("at"))
    return best(unique, ["item_id"], [F.asc("at"), F.asc("doc_id")], k, "position").select("item_id", "doc_id", "position")


def title_boost(title: Column, question: Column) -> Column:
    """0.8 where a title named in the question is part of the document's."""
    return F.when(F.exists(explicit_titles(question), lambda t: F.lower(F.coalesce(title, F.lit(""))).contains(t)), 0.8).otherwise(0.0)


def fallback_score(dense: Column, sparse: Column, is_parent: Column, section: Column, terms: Column, title: Column, question: Column) -> Column:
    """The score of a stored chunk where no vector index answers: cosine and sparse overlap, 0.15 for a parent, 0.1 for a query term in the section, 0.8 for a named title.

    Only scores above 0 are hits.
    """
    known = F.coalesce(section, F.lit(""))
    hit = F.exists(F.coalesce(terms, F.array().cast("array<string>")), lambda t: known.contains(t)) & (known != "")
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    return F.round(zero(dense) + zero(sparse) + F.when(F.coalesce(is_parent, F.lit(False)), 0.15).otherwise(0.0) + F.when(hit, 0.1).otherwise(0.0) + zero(title_boost(title, question)), 6)


def about(title: Column, subject: Column) -> Column:
    bare = F.lower(F.trim(F.translate(subject, "《》", "")))
    return (bare != "") & F.lower(F.coalesce(title, F.lit(""))).contains(bare)


def asks_for_relation(question: Column) -> Column:
    q = F.coalesce(question, F.lit(""))
    return tx.any_of(q, markers.GRAPH_HINTS) | q.rlike("谁.*负责|谁.*审批|由谁|归谁|上级|下级|关联关系")


def version_scope(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(20[0-9]{2}年|20[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}|上一版|前一版|新版|旧版)", 1)


def section_or_title(section: Column, title: Column) -> Column:
    s = F.trim(F.coalesce(section, F.lit("")))
    return F.when((s == "") | F.lower(s).rlike("^tmp[0-9a-z_-]{6,}$"), title).otherwise(s)


@query(
    rf"""WITH {LIBRARY_SQL} SELECT doc_id, regexp_matches(lower(trim(title)), '^(?:smoke_|tmp_|test_|sample_)') OR regexp_matches(lower(trim(title)), '\.(?:tmp|sample)\.csv$') AS synthetic,
  trim(title) = '' OR len(regexp_extract_all(trim(title), '\?')) >= 3 OR contains(title, '�') OR (len(regexp_extract_all(title, '[À-ÿ]')) >= 4 AND NOT regexp_matches(title, '[一-鿿]')) AS broken,
  regexp_matches(title, '[A-Z]{{2,}}[-_][0-9]+|[0-9]{{4}}') OR regexp_matches(title, '[:/_]') AS heavy,
  {any_sql("title", markers.GRAPH_HINTS)} OR regexp_matches(title, '谁.*负责|谁.*审批|由谁|归谁|上级|下级|关联关系') AS relation,
  regexp_extract(content, '(20[0-9]{{2}}年|20[0-9]{{2}}-[0-9]{{1,2}}-[0-9]{{1,2}}|上一版|前一版|新版|旧版)', 1) AS version,
  CASE WHEN trim(coalesce(section, '')) = '' OR regexp_matches(lower(trim(section)), '^tmp[0-9a-z_-]{{6,}}$') THEN title ELSE trim(section) END AS section, contains(lower(title), 'the') AS subject FROM lib"""
)
def title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a title says about its document: synthetic, broken, code-like, relational, about a subject; its version and section."""
    docs, title = library(spark, sf_dir), F.coalesce("title", F.lit(""))
    return docs.select(
        "doc_id", synthetic_eval_title(title).alias("synthetic"), needs_new_title(title).alias("broken"), keyword_heavy(title).alias("heavy"), asks_for_relation(title).alias("relation"),
        version_scope(F.col("content")).alias("version"), section_or_title(F.col("section"), F.col("title")).alias("section"), about(title, F.lit("《The》")).alias("subject"),
    )


# Snippets --------------------------------------------------------------------------------------------------------------


def substantive(snippet: Column) -> Column:
    s = squashed(snippet)
    han, digits = F.regexp_count(s, F.lit(HAN)), F.regexp_count(s, F.lit("[0-9]"))
    return (F.length(s) >= 8) & (marks(s, markers.SNIPPET_MARKS) < 2) & ((han >= 6) | (F.length(s) >= 20) | ((han >= 4) & (digits >= 2)))


def eval_worthy(text: Column) -> Column:
    """Fit to make questions from: a table of three rows, or text without a table of contents and page noise."""
    s = squashed(text)
    rows = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.ltrim(x).startswith("|")))
    return (F.length(s) >= 8) & ((rows >= 3) | (~F.substring(s, 1, 40).contains("目录") & (marks(s, markers.EVAL_NOISE) < 2)))


def no_graph(text: Column, kind: Column) -> Column:
    """Chunks that entities are not taken from: tables, empty ones, and those of numbers."""
    s = F.trim(F.coalesce(text, F.lit("")))
    numbers, words = F.regexp_count(s, F.lit(r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?")), F.regexp_count(s, F.lit("[一-鿿A-Za-z]{2,}"))
    return (F.lower(F.coalesce(kind, F.lit(""))) == "table") | (s == "") | (marks(s, markers.TABLE_MARKS) > 0) | ((numbers >= 8) & (words <= numbers))


def token_fingerprint(text: Column) -> Column:
    """The first sixteen runs of two or more characters of one script."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit("([一-鿿]{2,}|[A-Za-z0-9]{2,})"), F.lit(1)), 1, 16), "|")


def probe_query(title: Column, section: Column, content: Column) -> Column:
    """Eight distinct words of title, section and content, or the content's first 80 characters."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", title, section, content)), F.lit(WORDS), F.lit(1)))
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 8), " ")).otherwise(F.substring(F.coalesce(content, F.lit("")), 1, 80))


def title_overlap(title: Column, text: Column) -> Column:
    """How many words of a title stand in a text."""
    words = F.filter(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(WORDS), F.lit(1)), lambda w: ~w.isin(*markers.PLAIN_TITLE_WORDS))
    return tx.let(text, lambda t: F.size(F.filter(words, lambda w: t.contains(w))))


def export_sensitivity(content: Column) -> Column:
    hits = marks(F.lower(content), markers.SENSITIVE_TERMS)
    return F.when(hits >= 2, "high").when(hits == 1, "medium").otherwise("low")


_SQUASH = r"trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'))"


@query(
    rf"""WITH {LIBRARY_SQL}, low AS (SELECT *, {LOW_SQL} AS low_information FROM {LOW_FROM_SQL}), v AS (SELECT *, {_SQUASH.format("substr(content, 1, 300)")} AS s, {_SQUASH.format("content")} AS c FROM low)
SELECT doc_id, low_information,
  length(s) >= 8 AND {marks_sql("s", markers.SNIPPET_MARKS)} < 2 AND (len(regexp_extract_all(s, '[一-鿿]')) >= 6 OR length(s) >= 20 OR (len(regexp_extract_all(s, '[一-鿿]')) >= 4 AND len(regexp_extract_all(s, '[0-9]')) >= 2)) AS substantive,
  length(c) >= 8 AND (len(list_filter(string_split(content, chr(10)), lambda l: starts_with(ltrim(l), '|'))) >= 3 OR (NOT contains(substr(c, 1, 40), '目录') AND {marks_sql("c", markers.EVAL_NOISE)} < 2)) AS worthy,
  trim(content) = '' OR {marks_sql("content", markers.TABLE_MARKS)} > 0 OR (len(regexp_extract_all(content, '[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?')) >= 8 AND len(regexp_extract_all(content, '[一-鿿A-Za-z]{{2,}}')) <= len(regexp_extract_all(content, '[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?'))) AS no_graph,
  array_to_string(regexp_extract_all(content, '[一-鿿]{{2,}}|[A-Za-z0-9]{{2,}}')[1:16], '|') AS fingerprint,
  len(list_filter(regexp_extract_all(title, '[一-鿿A-Za-z0-9]{{2,}}'), lambda w: NOT list_contains({list(markers.PLAIN_TITLE_WORDS)}, w) AND contains(content, w))) AS title_words,
  CASE WHEN {marks_sql("lower(content)", markers.SENSITIVE_TERMS)} >= 2 THEN 'high' WHEN {marks_sql("lower(content)", markers.SENSITIVE_TERMS)} = 1 THEN 'medium' ELSE 'low' END AS sensitivity FROM v"""
)
def snippet_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's text may be shown, asked about, or searched for entities, with its token fingerprint and sensitivity."""
    docs, content = library(spark, sf_dir).filter(F.col("content").isNotNull()), F.col("content")
    return docs.select(
        "doc_id", low_information(content, F.col("title"), F.col("section")).alias("low_information"), substantive(F.substring(content, 1, SNIPPET)).alias("substantive"), eval_worthy(content).alias("worthy"),
        no_graph(content, F.lit("text")).alias("no_graph"), token_fingerprint(content).alias("fingerprint"), title_overlap(F.col("title"), content).alias("title_words"), export_sensitivity(content).alias("sensitivity"),
    )


@query(rf"""WITH {LIBRARY_SQL}, w AS (SELECT doc_id, content, regexp_extract_all(lower(concat_ws(' ', title, section, content)), '[一-鿿A-Za-z0-9]{{2,}}') AS ts FROM lib),
  e AS (SELECT doc_id, content, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM w), f AS (SELECT doc_id, t, min(i) AS i FROM e GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f),
  p AS (SELECT doc_id, string_agg(t, ' ' ORDER BY n) AS probe FROM n WHERE n <= 8 GROUP BY doc_id) SELECT doc_id, coalesce(probe, substr(content, 1, 80)) AS probe FROM w LEFT JOIN p USING (doc_id)""")
def probe_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question with which an index is asked for each document."""
    return library(spark, sf_dir).select("doc_id", probe_query(F.col("title"), F.col("section"), F.col("content")).alias("probe"))


# Blocks and chunks -----------------------------------------------------------------------------------------------------


def text_blocks(text: Column) -> Column:
    """Pieces between blank lines, line breaks inside as spaces, of eight characters or more."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n{2,}"), lambda x: F.trim(F.regexp_replace(x, r"\n+", " ")))
    return F.filter(pieces, lambda x: F.length(x) >= 8)


def block_kind(text: Column) -> Column:
    """heading, table or paragraph."""
    t = F.trim(text)
    spaces = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    pipes = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    named = F.substring(t, 1, 40).rlike("表[0-9]+|附表|项目|金额|部门|日期") & (spaces >= 2)
    return F.when(t.rlike(r"^[一-鿿0-9A-Za-z\-.、()（） ]{1,40}$"), "heading").when((pipes >= 2) | named, "table").otherwise("paragraph")


def guessed_section(text: Column, fallback: Column) -> Column:
    first = F.trim(F.get(F.split(text, "[。！？\n]", 2), F.lit(0)))
    return F.when(F.length(first).between(2, 40), first).otherwise(fallback)


def collapsed_kind(kinds: Column) -> Column:
    has = lambda k: F.array_contains(kinds, k)
    return F.when(has("table"), "table").when(has("heading"), "heading").when(has("ocr_page"), "ocr_page").otherwise("text")


@query(
    rf"""WITH {LIBRARY_SQL}, b AS (SELECT doc_id, title, list_filter(list_transform(string_split_regex(content, '\n{{2,}}'), lambda x: trim(regexp_replace(x, '\n+', ' ', 'g'))), lambda x: length(x) >= 8) AS bs FROM lib),
  e AS (SELECT doc_id, title, unnest(bs) AS b, generate_subscripts(bs, 1) - 1 AS block FROM b),
  k AS (SELECT *, CASE WHEN regexp_matches(b, '^[一-鿿0-9A-Za-z\-.、()（） ]{{1,40}}$') THEN 'heading' WHEN length(b) - length(replace(b, '|', '')) >= 2 OR (regexp_matches(substr(b, 1, 40), '表[0-9]+|附表|项目|金额|部门|日期') AND length(b) - length(replace(b, ' ', '')) >= 2) THEN 'table' ELSE 'paragraph' END AS kind,
    trim(string_split_regex(b, '[。！？\n]')[1]) AS f FROM e)
SELECT doc_id, block::INTEGER AS block, kind, CASE WHEN length(f) BETWEEN 2 AND 40 THEN f ELSE title END AS section, length(b) AS chars, CASE WHEN max(kind = 'table') OVER w THEN 'table' WHEN max(kind = 'heading') OVER w THEN 'heading' ELSE 'text' END AS of_document FROM k WINDOW w AS (PARTITION BY doc_id)"""
)
def text_block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each document with kind, section and size, and the kind that stands for the whole document."""
    docs = library(spark, sf_dir).select("doc_id", "title", text_blocks(F.col("content")).alias("bs")).withColumn("kinds", F.transform("bs", block_kind))
    each = docs.select("doc_id", "title", collapsed_kind(F.col("kinds")).alias("of_document"), F.posexplode(F.arrays_zip("bs", "kinds")).alias("block", "b"))
    return each.select("doc_id", "block", F.col("b.kinds").alias("kind"), guessed_section(F.col("b.bs"), F.col("title")).alias("section"), F.length("b.bs").cast("long").alias("chars"), "of_document")


CHILD_WORDS, CHILD_STRIDE = 384, 326


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, parent, child, id, parent_id, n_words): each parent segment, then its children (windows of words); docs: doc_id, pieces (lines).

    Ids are digests of document, parent and child, so a job that runs again writes the same ones.
    """
    parents = folded(docs, "pieces", segments).join(docs, "doc_id").select("doc_id", "part", F.array_join(F.slice("pieces", F.col("first").cast("int") + 1, F.col("n").cast("int")), "\n").alias("text"))
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    whole = parents.select("doc_id", "part", F.posexplode(F.concat(F.array(words), sliding(words, CHILD_WORDS, CHILD_STRIDE))).alias("child", "ws"))
    key = lambda *c: F.sha2(F.concat_ws("|", *c), 256)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "child")) - 1
    return whole.select(
        "doc_id", number.cast("long").alias("chunk_index"), F.col("part").alias("parent"), "child", key("doc_id", "part", "child").alias("id"),
        F.when(F.col("child") > 0, key("doc_id", "part", F.lit(0))).alias("parent_id"), F.size("ws").cast("long").alias("n_words"),
    )


@query()
def chunk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows(lines(spark, sf_dir))


SCORE_TERMS = ("the", "and", "of", "de", "la", "und", "die", "el")
MAX_CHUNKS = 6


@query(
    rf"""WITH {LIBRARY_SQL}, b AS (SELECT doc_id, title, list_filter(list_transform(string_split_regex(content, '\n{{2,}}'), lambda x: trim(regexp_replace(x, '\n+', ' ', 'g'))), lambda x: length(x) >= 8) AS bs FROM lib),
  e AS (SELECT doc_id, title, unnest(bs) AS b, generate_subscripts(bs, 1) - 1 AS block FROM b), s AS (SELECT *, 1 + 2 * {marks_sql("lower(b)", SCORE_TERMS)} + CASE WHEN length(b) >= 80 THEN 2 ELSE 0 END AS score FROM e),
  u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, substr(b, 1, 240) ORDER BY score DESC, block) AS copy FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, block) AS rank FROM u WHERE copy = 1),
  k AS (SELECT * FROM r WHERE rank <= {MAX_CHUNKS}), d AS (SELECT doc_id, any_value(title) AS title, max(score) AS best, count(*) AS n, string_agg(block::VARCHAR, ',' ORDER BY rank) AS blocks FROM k GROUP BY doc_id)
SELECT doc_id, best::BIGINT AS best, n, blocks FROM d"""
)
def grouped_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of each document, of equal beginnings one, at most six (the feature's own limit)."""
    docs = library(spark, sf_dir).select("doc_id", F.posexplode(text_blocks(F.col("content"))).alias("block", "b"))
    score = 1 + 2 * marks(F.lower("b"), SCORE_TERMS) + F.when(F.length("b") >= 80, 2).otherwise(0)
    order = [F.desc("score"), F.asc("block")]
    scored = docs.select("doc_id", "block", score.alias("score"), F.substring("b", 1, 240).alias("start"))
    unique = scored.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "start").orderBy(*order))).filter("copy = 1")
    ranked = unique.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).filter(F.col("rank") <= MAX_CHUNKS)
    named = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"].cast("string"))
    return ranked.groupBy("doc_id").agg(F.max("score").cast("long").alias("best"), F.count(F.lit(1)).alias("n"), F.array_join(named, ",").alias("blocks"))


# Evidence and training rows --------------------------------------------------------------------------------------------


def best_sentence(question: Column, text: Column) -> Column:
    """The sentence with the most words of the question, of these the longest, of these the first."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit(WORDS), F.lit(1)))
    pieces = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[。；\n]"), lambda x: F.trim(x)), lambda s: s != "")
    scored = F.transform(pieces, lambda s, i: F.struct(F.size(F.filter(words, lambda w: F.lower(s).contains(w))).alias("hits"), F.length(s).alias("n"), (-i).alias("at"), s.alias("s")))
    return F.array_max(scored)["s"]


def duty_sentence(sentences: Column, text: Column) -> Column:
    """The first sentence that binds somebody, else the first, else the text's start."""
    bound = F.filter(sentences, lambda s: tx.any_of(s, markers.DUTY_WORDS))
    return F.coalesce(F.get(bound, F.lit(0)), F.get(sentences, F.lit(0)), F.substring(text, 1, 220))


def version_sentence(sentences: Column) -> Column:
    """The first sentence with a date and a word for a version."""
    return F.get(F.filter(sentences, lambda s: s.rlike(r"20[0-9]{2}") & s.rlike("生效|施行|版本|修订|实施|version|effective")), F.lit(0))


def training_text(title: Column, section: Column, page: Column, content: Column) -> Column:
    """A header that places a chunk, and the chunk."""
    part = lambda label, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(label), c.cast("string")))
    return F.concat(F.concat_ws("\n", F.concat(F.lit("文档标题："), title), part("章节：", section), part("页码：", page)), F.lit("\n\n"), content)


def rule_summary(content: Column) -> Column:
    """Three points and a line on the risk of not following them."""
    points = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), "[。；;\n]+"), lambda x: F.regexp_replace(x, "^[ \n\t；。]+|[ \n\t；。]+$", "")), lambda x: x != "")
    numbered = F.transform(F.slice(points, 1, 3), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    shown = F.when(F.size(points) > 0, F.array_join(numbered, "\n")).otherwise("1. 未提取到明确管理要点")
    risk = F.coalesce(F.get(points, F.lit(3)), F.get(points, F.size(points) - 1), F.lit("原文信息不足"))
    return F.concat(shown, F.lit("\n执行风险：如未严格按上述要求执行，可能在“"), F.substring(risk, 1, 36), F.lit("”相关环节出现审批遗漏、责任不清或留痕不足。"))


@query(
    rf"""WITH {LIBRARY_SQL}, p AS (SELECT doc_id, title, section, content, list_filter(list_transform(string_split_regex(content, '[。；;\n]+'), lambda x: regexp_replace(x, '^[ \n\t；。]+|[ \n\t；。]+$', '', 'g')), lambda x: x != '') AS ps FROM lib)
SELECT doc_id, md5('文档标题：' || title || CASE WHEN coalesce(section, '') != '' THEN chr(10) || '章节：' || section ELSE '' END || chr(10) || chr(10) || content) AS cpt,
  md5(CASE WHEN len(ps) > 0 THEN array_to_string(list_transform(ps[1:3], lambda x, i: i || '. ' || x), chr(10)) ELSE '1. 未提取到明确管理要点' END || chr(10) || '执行风险：如未严格按上述要求执行，可能在“' || substr(coalesce(ps[4], ps[len(ps)], '原文信息不足'), 1, 36) || '”相关环节出现审批遗漏、责任不清或留痕不足。') AS summary FROM p"""
)
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the pre-training text and the rule summary of each document."""
    docs = library(spark, sf_dir)
    return docs.select("doc_id", F.md5(training_text(F.col("title"), F.col("section"), F.lit(None).cast("int"), F.col("content"))).alias("cpt"), F.md5(rule_summary(F.col("content"))).alias("summary"))


@query(
    r"""WITH a AS (SELECT a.conv_id, a.turn, q.text AS question, a.text AS answer FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE a.role = 'assistant' AND q.role = 'user'),
  w AS (SELECT *, list_distinct(regexp_extract_all(lower(question), '[一-鿿A-Za-z0-9]{2,}')) AS ws, list_filter(list_transform(string_split_regex(answer, '[。；\n]'), lambda x: trim(x)), lambda x: x != '') AS ss FROM a),
  e AS (SELECT conv_id, turn, ws, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM w)
SELECT conv_id, turn, arg_max(s, (len(list_filter(ws, lambda x: contains(lower(s), x))), length(s), -i)) AS evidence FROM e GROUP BY conv_id, turn"""
)
def best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of each answer that fits its question best."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    answers = turns.filter("role = 'assistant'").filter(F.col("text").rlike("[^。；\n ]"))  # with one sentence at least
    pairs = answers.join(asked.filter("question IS NOT NULL"), ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", best_sentence(F.col("question"), F.col("text")).alias("evidence"))


# Stored metadata and model replies -------------------------------------------------------------------------------------


def lenient_map(text: Column) -> Column:
    """A map from JSON, or from a literal with single quotes and None, True, False; empty where neither can be read."""
    literal = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    read = lambda t: F.from_json(t, "map<string,string>", {"allowSingleQuotes": "true"})
    return F.coalesce(F.when(text.rlike(r"(?s)^\s*\{.*\}\s*$"), F.coalesce(read(text), read(literal))), F.create_map().cast("map<string,string>"))


def merged_maps(old: Column, new: Column) -> Column:
    """The keys of both; of shared keys the new value."""
    return F.map_zip_with(old, new, lambda _, a, b: F.coalesce(b, a))


def listed(reply: Column, schema: str) -> Column:
    """The JSON array in a model's reply: the whole reply, a fenced block, or what stands between the first and the last bracket."""
    whole = F.when(F.trim(reply).startswith("["), F.from_json(F.trim(reply), schema))
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1), F.lit(""))
    between = F.nullif(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), F.lit(""))
    return F.coalesce(whole, F.from_json(fenced, schema), F.from_json(between, schema))


def looks_numeric(value: Column) -> Column:
    return F.replace(F.trim(value), F.lit(","), F.lit("")).try_cast("decimal(38,10)").isNotNull()


@query(
    """WITH p AS (SELECT event_id, user_id, props, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, (props->>'k') AS k, coalesce((before->>'k'), (props->>'k')) AS k_before, len(json_keys(props)) AS n_keys, len(json_keys(json_merge_patch(coalesce(before, '{}'), props))) AS n_merged FROM p"""
)
def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata stored as JSON by every second writer and as literals by the others, read and merged with the user's previous one."""
    rows = table(spark, sf_dir, "events")
    stored = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.translate("props", '"', "'"))
    before = F.lag("m").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    both = rows.select("event_id", "user_id", "ts", lenient_map(stored).alias("m")).withColumn("before", F.coalesce(before, F.create_map().cast("map<string,string>")))
    merged = merged_maps(F.col("before"), F.col("m"))
    return both.select(
        "event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.coalesce(F.try_element_at("before", F.lit("k")), F.try_element_at("m", F.lit("k"))).alias("k_before"),
        F.size("m").cast("long").alias("n_keys"), F.size(merged).cast("long").alias("n_merged"),
    )


@query("SELECT conv_id, turn, text AS question, lead AS answer FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS lead, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE role = 'user' AND next = 'assistant'")
def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer pairs written as a model replies (bare, fenced, between words) and read back."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    pairs = table(spark, sf_dir, "conversations").withColumns({"answer": F.lead("text").over(order), "next": F.lead("role").over(order)}).filter("role = 'user' AND next = 'assistant'")
    array = F.to_json(F.array(F.struct(F.col("text").alias("question"), "answer")))
    reply = F.when(F.col("conv_id") % 3 == 0, array).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("Here you are:\n```json\n"), array, F.lit("\n```\n"))).otherwise(F.concat(F.lit("The pairs are "), array, F.lit(" as asked.")))
    read = pairs.select("conv_id", "turn", F.explode(listed(reply, "array<struct<question:string,answer:string>>")).alias("p"))
    return read.select("conv_id", "turn", "p.question", "p.answer")


@query(
    rf"""SELECT doc_id, CASE WHEN length(text) >= 30 AND length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) < 0.5 * length(regexp_replace(text, '\s', '', 'g')) THEN 'garbled' WHEN regexp_matches(text, '(^|[^0-9])1[0-9]{{10}}($|[^0-9])') THEN 'phone'
  WHEN regexp_matches(text, '(^|[^0-9])[0-9]{{17}}[0-9Xx]($|[^0-9])') THEN 'id' WHEN regexp_matches(text, '(^|[^0-9])[0-9]{{16,19}}($|[^0-9])') THEN 'bank' WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') THEN 'email' ELSE 'pass' END AS verdict,
  contains(substr(text, 1, 1048576), '{markers.TEST_VIRUS}') AS infected FROM documents"""
)
def output_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a guard would stop a text, the first reason in order; and whether its first megabyte holds the scanners' test mark."""
    t = F.col("text")
    verdict = F.when(tx.garbled(t), "garbled").when(t.rlike(r"(?<![0-9])1[0-9]{10}(?![0-9])"), "phone").when(t.rlike(r"(?<![0-9])[0-9]{17}[0-9Xx](?![0-9])"), "id")
    verdict = verdict.when(t.rlike(r"(?<![0-9])[0-9]{16,19}(?![0-9])"), "bank").when(t.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), "email").otherwise("pass")
    return table(spark, sf_dir, "documents").select("doc_id", verdict.alias("verdict"), F.substring(t, 1, 1 << 20).contains(markers.TEST_VIRUS).alias("infected"))


@query(
    rf"""WITH {BM25_SQL}, p AS (SELECT bmr.item_id, doc_id, score, bmr.rank, len(list_filter(regexp_extract_all(title, '[一-鿿A-Za-z0-9]{{2,}}'), lambda w: NOT list_contains({list(markers.PLAIN_TITLE_WORDS)}, w) AND contains(b.text, w))) AS priority
  FROM bmr JOIN sec USING (doc_id) JOIN benchmark b ON b.item_id = bmr.item_id WHERE bmr.rank <= 40)
SELECT item_id, doc_id, priority, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY priority DESC, score DESC, rank) AS place FROM p) WHERE place <= 10"""
)
def prioritized_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by a priority (here the title's words in the question), then by score, then as they came; the first is the primary one."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    found = bm25_ranked(spark, sf_dir, 40)
    hits = found.join(hit_documents(spark, sf_dir, found, 40).select("doc_id", "title"), "doc_id").join(asked, "item_id")
    ranked = hits.withColumn("priority", title_overlap(F.col("title"), F.col("question")).cast("long"))
    return best(ranked, ["item_id"], [F.desc("priority"), F.desc("score"), F.asc("rank")], 10, "place").select("item_id", "doc_id", "priority", "place")


REPORTED = 5


@query(f"WITH {ANSWERS_SQL}, {SCORES_SQL} SELECT conv_id, turn, round(precision, 4) AS precision, round(faithfulness, 4) AS faithfulness FROM s ORDER BY round(precision, 4), round(faithfulness, 4), conv_id, turn LIMIT {REPORTED}")
def worst_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five worst samples of an evaluation, as its report lists them."""
    scored = scored_answers(spark, sf_dir).select("conv_id", "turn", F.round("precision", 4).alias("precision"), F.round("faithfulness", 4).alias("faithfulness"))
    return scored.orderBy("precision", "faithfulness", "conv_id", "turn").limit(REPORTED)


@query("SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role, CASE WHEN arg_max(role, turn) = 'assistant' THEN 'done' ELSE 'answer' END AS resume_at FROM conversations GROUP BY conv_id")
def resume_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stored step of each run and the step at which it goes on."""
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))
    return last.withColumn("resume_at", F.when(F.col("last_role") == "assistant", "done").otherwise("answer"))
