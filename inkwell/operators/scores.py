"""Additive points of chunks, matches of hits and samples, and entities that a graph may hold.

Rules by words are tables in markers; each query applies them to every line of every document, a line being a chunk, four lines a page.
Marks that name one institution are left out. Null fields count as empty; documents without text have no chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markers
from ..functions import text as tx
from ..plans.registry import query
from ..plans.session import LIBRARY_SQL, library, table
from .answers import boilerplate, low_information
from .documents import any_sql
from .rules import squashed, title_overlap, token_fingerprint
from .search import BM25_SQL, bm25_ranked

Points = Sequence[tuple[str, Sequence[str], int]]
LINES_A_PAGE = 4
#: The question under which the registered queries rank chunks: it asks for a summary, for core content and for materials.
QUESTION = "概括主要内容和材料"


def by_words(fields: dict[str, Column], rules: Points) -> Column:
    """The points of all rules of whose words a field holds one."""
    return sum((F.when(tx.any_of(fields[f], words), n).otherwise(0) for f, words, n in rules), F.lit(0))


def given(*rules: tuple[Column, int]) -> Column:
    return sum((F.when(condition, n).otherwise(0) for condition, n in rules), F.lit(0))


def starts(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: text.startswith(w))


def asking(section: Column, snippet: Column) -> Column:
    """A chunk that itself asks something."""
    return section.rlike("^[一二三四五六七八九十]+[、.]") | tx.any_of(F.concat_ws(" ", section, snippet), markers.ASKING_WORDS)


def cleaned(rows: DataFrame) -> DataFrame:
    """rows with title, section and snippet trimmed, white space in snippet squashed, and null as empty, so that the rules below read each once."""
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return rows.withColumns({"title": empty("title"), "section": empty("section"), "snippet": squashed(F.col("snippet"))})


def chunk_priority(title: Column, section: Column, snippet: Column, page: Column, question: Column, details: bool) -> Column:
    """How much a retrieved chunk (cleaned) deserves a place; details: the question names a document or its plan prefers details."""
    f, page, q = {"section": section, "snippet": snippet}, F.coalesce(page, F.lit(0)), F.coalesce(question, F.lit(""))
    t, sec, s = title, section, snippet
    total = F.when(F.length(s) >= 120, 3).when(F.length(s) >= 60, 1).otherwise(0) + 2 * title_overlap(t, F.concat_ws(" ", sec, s))
    total = total + given(((sec == t) & (page > 1), -4)) + by_words(f, markers.CHUNK_POINTS)
    faq, answers = t.contains("常见问题"), s.contains("常见问题解答")
    if details:
        opening = page.isin(1, 2) & ~tx.any_of(s, ("说明", "一、", "常见问题解答"))
        total = total + by_words(f, markers.CHUNK_DETAIL_POINTS)
        total = total + given((F.substring(s, 1, 20).contains("目录"), -5), (opening, -3), (starts(sec, markers.LATER_SECTIONS), -4), (starts(s, markers.ATTACHMENT_STARTS), 12))
        summary = by_words(f, markers.CHUNK_SUMMARY_POINTS) + given((faq & (page == 1), 18), (faq & (page >= 4), -10), (asking(sec, s) & ~(answers & (page == 1)), -10))
        total = total + F.when(tx.any_of(q, markers.SUMMARY_QUESTION), summary).otherwise(0)
    core = by_words(f, markers.CHUNK_CORE_POINTS) + given((page == 1, -4), (page >= 10, -2), (page.between(2, 8), 3))
    total = total + F.when(tx.any_of(q, markers.CORE_QUESTION), core).otherwise(0)
    return total + F.when(tx.any_of(q, markers.MATERIALS_QUESTION), by_words(f, markers.CHUNK_MATERIAL_POINTS)).otherwise(0)


def summary_priority(title: Column, section: Column, snippet: Column, page: Column) -> Column:
    """How much a chunk (cleaned) says about its whole document."""
    page, t, s = F.coalesce(page, F.lit(0)), title, snippet
    sec = F.coalesce(F.nullif(squashed(section), F.lit("")), F.lit("未命名章节"))
    f = {"section": sec, "snippet": s}
    faq = t.contains("常见问题")
    return (
        by_words(f, markers.SUMMARY_POINTS) + 3 * title_overlap(t, F.concat_ws(" ", sec, s)) + F.when(page == 1, 8).when(page == 2, 4).otherwise(0)
        + F.when((sec == t) & (page == 1), 10).when((sec == t) & (page > 1), -4).otherwise(0) + F.when(F.length(s) >= 100, 4).when(F.length(s) >= 50, 2).otherwise(0)
        + given(
            (faq & (page == 1), 18), (faq & (page >= 4), -10), (starts(s, markers.ATTACHMENT_STARTS), 12), (asking(sec, s) & ~(s.contains("常见问题解答") & (page == 1)), -8),
            (s.rlike(r"^[二三四五六七八九十]\s*[、.]"), -3), (sec.rlike(r"^\d+\s"), -5), (starts(sec, markers.SUMMARY_LATER_SECTIONS), -6), (F.substring(s, 1, 20).contains("目录"), -8), (page >= 8, -2),
        )
    )


def primary_points(snippet: Column, page: Column) -> Column:
    """What makes a chunk (cleaned) the one that an answer on core requirements rests on."""
    page = F.coalesce(page, F.lit(0))
    return by_words({"snippet": snippet}, markers.PRIMARY_POINTS) + given((page.between(2, 6), 3), (page >= 10, -2))


def eval_points(title: Column, section: Column, content: Column, index: Column) -> Column:
    """How well a chunk (cleaned) serves for evaluation samples; -100 without any text."""
    many = lambda c: F.length(content) - F.length(F.replace(content, F.lit(c), F.lit("")))
    parts = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (title, section, content)])
    by_text = lambda e: by_words({"all": e}, markers.EVAL_POINTS) + given((e.rlike(r"\d[\d,]{2,}"), 3), (e.contains("单位：万元") | (many("|") >= 8), 5))
    rest = given((section != "", 2), (title.rlike(r"\.(?:pdf|html)$"), 1), ((many(".") >= 20) | content.contains("." * 32), -24), (F.coalesce(index <= 3, F.lit(False)), -10))
    return tx.let(parts, lambda e: F.when(e == "", -100).otherwise(by_text(e) + rest))


def chunks(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, title, section, chunk_index, page, snippet), cleaned: the lines of all documents, or of those whose doc_id is wanted."""
    docs = library(spark, sf_dir)
    docs = docs if wanted is None else docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return cleaned(docs.select("doc_id", "title", "section", F.posexplode(F.split("content", "\n")).alias("chunk_index", "snippet"))).withColumn("page", F.expr(f"1 + chunk_index DIV {LINES_A_PAGE}"))


def _points_sql(rules: Points) -> str:
    return " + ".join(f"CASE WHEN {any_sql('s_all' if f == 'all' else f, words)} THEN {n} ELSE 0 END" for f, words, n in rules)


def _starts_sql(column: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"starts_with({column}, '{w}')" for w in words) + ")"


_PLAIN = list(markers.PLAIN_TITLE_WORDS)
_ASKING_SQL = f"(regexp_matches(section, '^[一二三四五六七八九十]+[、.]') OR {any_sql("section || ' ' || snippet", markers.ASKING_WORDS)})"
CHUNKS_SQL = rf"""{LIBRARY_SQL}, ls AS (SELECT doc_id, coalesce(title, '') AS title, coalesce(section, '') AS section, string_split(content, chr(10)) AS ls FROM lib),
  raw AS (SELECT doc_id, trim(title) AS title, trim(section) AS section, regexp_replace(section, '\s+', ' ', 'g') AS squashed, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS chunk_index FROM ls),
  ch AS (SELECT doc_id, title, section, trim(squashed) AS squashed, chunk_index, 1 + chunk_index // {LINES_A_PAGE} AS page, trim(regexp_replace(line, '\s+', ' ', 'g')) AS snippet FROM raw),
  wd AS (SELECT *, concat_ws(' ', nullif(title, ''), nullif(section, ''), nullif(snippet, '')) AS s_all, list_filter(regexp_extract_all(title, '[一-鿿A-Za-z0-9]{{2,}}'), lambda w: NOT list_contains({_PLAIN}, w)) AS ws FROM ch)"""


@query(
    rf"""WITH {CHUNKS_SQL}, p AS (SELECT doc_id, chunk_index,
  CASE WHEN length(snippet) >= 120 THEN 3 WHEN length(snippet) >= 60 THEN 1 ELSE 0 END + 2 * len(list_filter(ws, lambda w: contains(section || ' ' || snippet, w))) + CASE WHEN section = title AND page > 1 THEN -4 ELSE 0 END
  + {_points_sql(markers.CHUNK_POINTS + markers.CHUNK_DETAIL_POINTS + markers.CHUNK_SUMMARY_POINTS + markers.CHUNK_CORE_POINTS + markers.CHUNK_MATERIAL_POINTS)} + CASE WHEN contains(substr(snippet, 1, 20), '目录') THEN -5 ELSE 0 END
  + CASE WHEN page <= 2 AND NOT {any_sql("snippet", ("说明", "一、", "常见问题解答"))} THEN -3 ELSE 0 END + CASE WHEN {_starts_sql("section", markers.LATER_SECTIONS)} THEN -4 ELSE 0 END
  + CASE WHEN {_starts_sql("snippet", markers.ATTACHMENT_STARTS)} THEN 12 ELSE 0 END + CASE WHEN contains(title, '常见问题') AND page = 1 THEN 18 WHEN contains(title, '常见问题') AND page >= 4 THEN -10 ELSE 0 END
  + CASE WHEN {_ASKING_SQL} AND NOT (contains(snippet, '常见问题解答') AND page = 1) THEN -10 ELSE 0 END + CASE WHEN page = 1 THEN -4 WHEN page <= 8 THEN 3 WHEN page >= 10 THEN -2 ELSE 0 END AS priority,
  {_points_sql(markers.PRIMARY_POINTS)} + CASE WHEN page BETWEEN 2 AND 6 THEN 3 WHEN page >= 10 THEN -2 ELSE 0 END AS primary_points,
  CASE WHEN s_all = '' THEN -100 ELSE {_points_sql(markers.EVAL_POINTS)} + CASE WHEN regexp_matches(s_all, '[0-9][0-9,]{{2,}}') THEN 3 ELSE 0 END + CASE WHEN contains(s_all, '单位：万元') OR length(snippet) - length(replace(snippet, '|', '')) >= 8 THEN 5 ELSE 0 END
  + CASE WHEN section != '' THEN 2 ELSE 0 END + CASE WHEN regexp_matches(title, '\.(pdf|html)$') THEN 1 ELSE 0 END + CASE WHEN length(snippet) - length(replace(snippet, '.', '')) >= 20 THEN -24 ELSE 0 END + CASE WHEN chunk_index <= 3 THEN -10 ELSE 0 END END AS eval_points
  FROM wd),
q AS (SELECT doc_id, chunk_index, title, snippet, page, ws, coalesce(nullif(squashed, ''), '未命名章节') AS section FROM wd),
m AS (SELECT doc_id, chunk_index, {_points_sql(markers.SUMMARY_POINTS)} + 3 * len(list_filter(ws, lambda w: contains(section || ' ' || snippet, w))) + CASE page WHEN 1 THEN 8 WHEN 2 THEN 4 ELSE 0 END + CASE WHEN section != title THEN 0 WHEN page = 1 THEN 10 ELSE -4 END
  + CASE WHEN length(snippet) >= 100 THEN 4 WHEN length(snippet) >= 50 THEN 2 ELSE 0 END + CASE WHEN contains(title, '常见问题') AND page = 1 THEN 18 WHEN contains(title, '常见问题') AND page >= 4 THEN -10 ELSE 0 END
  + CASE WHEN {_starts_sql("snippet", markers.ATTACHMENT_STARTS)} THEN 12 ELSE 0 END + CASE WHEN {_ASKING_SQL} AND NOT (contains(snippet, '常见问题解答') AND page = 1) THEN -8 ELSE 0 END + CASE WHEN regexp_matches(snippet, '^[二三四五六七八九十]\s*[、.]') THEN -3 ELSE 0 END
  + CASE WHEN regexp_matches(section, '^[0-9]+\s') THEN -5 ELSE 0 END + CASE WHEN {_starts_sql("section", markers.SUMMARY_LATER_SECTIONS)} THEN -6 ELSE 0 END + CASE WHEN contains(substr(snippet, 1, 20), '目录') THEN -8 ELSE 0 END + CASE WHEN page >= 8 THEN -2 ELSE 0 END AS summary_priority FROM q)
SELECT doc_id, chunk_index, priority, summary_priority, primary_points, eval_points FROM p JOIN m USING (doc_id, chunk_index)"""
)
def chunk_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of every chunk: for an answer, for a summary, as primary evidence and for evaluation samples."""
    c, question = chunks(spark, sf_dir), F.lit(QUESTION)
    title, section, snippet, page = (F.col(n) for n in ("title", "section", "snippet", "page"))
    return c.select(
        "doc_id", "chunk_index", chunk_priority(title, section, snippet, page, question, True).alias("priority"), summary_priority(title, section, snippet, page).alias("summary_priority"),
        primary_points(snippet, page).alias("primary_points"), eval_points(title, section, snippet, F.col("chunk_index")).alias("eval_points"),
    )


@query(
    f"""WITH {CHUNKS_SQL}, p AS (SELECT doc_id, chunk_index, length(snippet) AS n, {_points_sql(markers.PRIMARY_POINTS)} + CASE WHEN page BETWEEN 2 AND 6 THEN 3 WHEN page >= 10 THEN -2 ELSE 0 END AS points FROM wd)
SELECT doc_id, arg_max(chunk_index, (points, n, -chunk_index)) AS chunk_index, max(points) AS points FROM p GROUP BY doc_id"""
)
def primary_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk of each document that an answer on core requirements rests on: most points, then the longest, then the first."""
    rated = chunks(spark, sf_dir).select("doc_id", "chunk_index", F.length("snippet").alias("n"), primary_points(F.col("snippet"), F.col("page")).alias("points"))
    return rated.groupBy("doc_id").agg(F.max_by("chunk_index", F.struct("points", "n", -F.col("chunk_index"))).alias("chunk_index"), F.max("points").alias("points"))


# Results as an answer takes them ---------------------------------------------------------------------------------------


def preferred(rows: DataFrame, by: list[str], wanted: Column) -> DataFrame:
    """Of each group the wanted rows, or all where none is wanted."""
    any_wanted = F.max(F.coalesce(wanted, F.lit(False))).over(Window.partitionBy(*by))
    return rows.withColumn("_any", any_wanted).filter(~F.col("_any") | F.coalesce(wanted, F.lit(False))).drop("_any")


def normalised(hits: DataFrame, by: str, per_document: int, named: Column | None = None, all_documents: bool = False) -> DataFrame:
    """hits (by, doc_id, title, section, snippet, score, rank, priority) as an answer takes them, with their place.

    Hits of named documents, else all; of these informative ones, else those that are not a page's frame, else all; by priority, score and
    rank; repeated texts of a document once; per_document of each document; all_documents: the documents take turns.
    """
    low = low_information(F.col("snippet"), F.col("title"), F.col("section"))
    rows = hits if named is None else preferred(hits, [by], named)
    rows = rows.withColumn("_kind", F.when(~low, 0).when(~boilerplate(F.col("snippet")), 1).otherwise(2))
    rows = rows.withColumn("_best", F.min("_kind").over(Window.partitionBy(by))).filter("_kind = _best")
    order = [F.desc("priority"), F.desc("score"), F.asc("rank")]
    same = Window.partitionBy(by, "doc_id", F.trim(F.coalesce("section", F.lit(""))), F.trim(F.coalesce("snippet", F.lit("")))).orderBy(*order)
    rows = rows.withColumn("_copy", F.row_number().over(same)).filter("_copy = 1")
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(by, "doc_id").orderBy(*order))).filter(F.col("_nth") <= per_document)
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    if all_documents:
        rows = rows.withColumn("_place", place).withColumn("_lead", F.min("_place").over(Window.partitionBy(by, "doc_id")))
        place = F.row_number().over(Window.partitionBy(by).orderBy("_nth", "_lead"))
    return rows.withColumn("place", place).drop("_kind", "_best", "_copy", "_nth", "_place", "_lead")


CANDIDATES, PER_DOCUMENT = 40, 2


@query()
def shaped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each question's 40 best documents as an answer takes them: two of a document, those of documents whose title the question names."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("question"))
    found = bm25_ranked(spark, sf_dir, CANDIDATES).withColumnRenamed("rank", "found")
    hits = found.join(chunks(spark, sf_dir, found), "doc_id").join(asked, "item_id")
    hits = hits.withColumn("rank", F.struct("found", "chunk_index")).withColumn("priority", chunk_priority(F.col("title"), F.col("section"), F.col("snippet"), F.col("page"), F.col("question"), False))
    named = (F.length(F.trim("title")) >= 2) & F.col("question").contains(F.lower(F.trim("title")))
    return normalised(hits, "item_id", PER_DOCUMENT, named, all_documents=True).select("item_id", "doc_id", "chunk_index", F.col("priority").cast("long").alias("priority"), "place")


# Hits and samples ------------------------------------------------------------------------------------------------------

RUNS = "([一-鿿]{2,}|[A-Za-z0-9]{2,})"
ENOUGH = 0.75


def shared(left: Column, right: Column) -> Column:
    """The share of left's words that right holds; 0 without words."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(RUNS), F.lit(1)))
    return tx.let(words(left), lambda l: F.when(F.size(l) > 0, F.size(F.array_intersect(l, words(right))) / F.size(l)).otherwise(0.0))


def hit_matches(hit: dict[str, Column], sample: dict[str, Column]) -> Column:
    """Whether a hit is what a sample was made from (chunk_id, doc_id, title, section, content): an id, title and section, or the content."""
    low = lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")
    h, s = ({k: low(r[k]) for k in ("title", "section", "content")} for r in (hit, sample))
    same = lambda k: (h[k] != "") & (h[k] == s[k])
    both = (h["content"] != "") & (s["content"] != "")
    mark = token_fingerprint(s["content"])
    ids = (hit["chunk_id"] == sample["chunk_id"]) | (hit["doc_id"] == sample["doc_id"])
    text = both & (((mark != "") & (mark == token_fingerprint(h["content"]))) | (shared(s["content"], h["content"]) >= ENOUGH))
    return F.coalesce(ids, F.lit(False)) | (same("title") & same("section")) | text


@query(
    rf"""WITH {BM25_SQL}, h AS (SELECT item_id, doc_id, rank FROM bmr WHERE rank <= 10),
  t AS (SELECT h.*, trim(regexp_replace(lower(trim(b.text)), '\s+', ' ', 'g')) AS s, regexp_replace(lower(trim(d.text)), '\s+', ' ', 'g') AS c FROM h JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)),
  w AS (SELECT *, list_distinct(regexp_extract_all(s, '[一-鿿]{{2,}}|[A-Za-z0-9]{{2,}}')) AS l, list_distinct(regexp_extract_all(c, '[一-鿿]{{2,}}|[A-Za-z0-9]{{2,}}')) AS r,
    array_to_string(regexp_extract_all(s, '[一-鿿]{{2,}}|[A-Za-z0-9]{{2,}}')[1:16], '|') AS f, array_to_string(regexp_extract_all(c, '[一-鿿]{{2,}}|[A-Za-z0-9]{{2,}}')[1:16], '|') AS g FROM t)
SELECT item_id, doc_id, rank, (f != '' AND f = g) OR (len(l) > 0 AND len(list_intersect(l, r)) / len(l) >= {ENOUGH}) AS matches FROM w"""
)
def sample_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the ten best hits of each item hold the item's text."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("sample"))
    hits = bm25_ranked(spark, sf_dir, 10).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(items, "item_id")
    none = F.lit(None).cast("string")
    blank = {"chunk_id": none, "doc_id": none, "title": none, "section": none}
    return hits.select("item_id", "doc_id", "rank", hit_matches({**blank, "content": F.col("text")}, {**blank, "content": F.col("sample")}).alias("matches"))


def table_cell(question: Column, text: Column) -> Column:
    """The last cell of the Markdown row that fits the question best, of equal ones the first; empty without one."""
    q = F.coalesce(question, F.lit(""))
    aliased = F.flatten(F.array(*[F.when(tx.any_of(q, words), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for words, names in markers.TABLE_ALIASES]))
    words = F.when(F.size(aliased) > 0, aliased).otherwise(F.array_distinct(tx.terms(q)))
    rows = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda r: r.startswith("|"))
    cells = F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(r, r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x)))
    joined = lambda c: F.lower(F.array_join(c, " "))
    cells = F.filter(cells, lambda c: (F.size(c) >= 2) & ~joined(c).startswith("policy content") & ~joined(c).startswith("---") & ~F.element_at(c, -1).isin("", "---"))
    scored = F.transform(cells, lambda c, i: F.struct(F.size(F.filter(words, lambda w: joined(c).contains(w))).alias("hits"), (-i).alias("at"), F.element_at(c, -1).alias("cell")))
    return F.coalesce(F.array_max(scored)["cell"], F.lit(""))


# Entities --------------------------------------------------------------------------------------------------------------


def fragment(token: Column) -> Column:
    """A piece of a sentence rather than a name."""
    return tx.any_of(token, markers.FRAGMENT_MARKS) | token.rlike("|".join(markers.FRAGMENT_SHAPES))


def valid_entity(token: Column) -> Column:
    """A name that a graph may hold: not a common word, a number, a date, an amount, an article's number or a fragment."""
    t = F.trim(token)
    name = ~t.isin(*markers.GENERIC_ENTITIES) & ~fragment(t)
    return (F.length(t) >= 2) & ~t.rlike("|".join(markers.NOT_ENTITY)) & (~t.rlike("[一-鿿]") | name)  # the words and marks are all Chinese


def entity_parts(token: Column) -> Column:
    """What stands before and after each verb in a phrase, where it ends like a name."""
    edge = "^[：:、，,（）() ]+|[：:、，,（）() ]+$"
    t, sides = F.trim(token), []
    for verb in markers.ENTITY_VERBS:
        at = F.instr(t, verb)
        sides += [F.when(at > 0, F.regexp_replace(F.substring(t, F.lit(1), at - 1), edge, "")), F.when(at > 0, F.regexp_replace(F.substring(t, at + len(verb), F.length(t)), edge, ""))]
    named = "(?:" + "|".join(markers.ENTITY_ENDINGS) + ")$"
    return F.array_distinct(F.filter(F.array(*sides), lambda s: s.isNotNull() & (F.length(s) >= 2) & s.rlike(named)))


NAMES = 10


def entity_names(text: Column) -> Column:
    """The first ten valid names of a text (the feature's own limit); words that are none are split at verbs."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([一-鿿A-Za-z0-9]{2,})"), F.lit(1)))
    phrase = lambda t: F.when(t.rlike("|".join(markers.ENTITY_VERBS)), F.filter(entity_parts(t), valid_entity))
    each = F.filter(F.transform(found, lambda t: F.when(valid_entity(t), F.array(t)).otherwise(phrase(t))), lambda a: a.isNotNull())
    return F.slice(F.array_distinct(F.flatten(each)), 1, NAMES)


def asked_relation(question: Column, content: Column) -> Column:
    """The relation that a question asks for, given what was found."""
    q, c = F.coalesce(question, F.lit("")), F.coalesce(content, F.lit(""))
    low = F.lower(q)
    return (
        F.when(q.contains("引用") | low.contains("reference"), "references").when(q.contains("修订") | low.contains("amend") | c.contains("替代"), "amends")
        .when(q.contains("负责") | c.contains("审批") | c.contains("负责人"), "manages").when(tx.any_of(q, ("上级", "下级")) | c.contains("汇报"), "reports_to").otherwise("related_to")
    )


@query(
    rf"""WITH {LIBRARY_SQL}, e AS (SELECT doc_id, unnest(regexp_extract_all(content, '[一-鿿A-Za-z0-9]{{2,}}')) AS t, generate_subscripts(regexp_extract_all(content, '[一-鿿A-Za-z0-9]{{2,}}'), 1) AS i FROM lib),
  f AS (SELECT doc_id, t, min(i) AS i FROM e GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f WHERE NOT regexp_matches(t, '^([0-9]{{2,}}|[0-9]{{4}}年)$') AND NOT regexp_matches(t, '[一-鿿]'))
SELECT doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY n) AS names FROM v WHERE n <= {NAMES} GROUP BY doc_id"""
)
def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names in each document that has one."""
    named = library(spark, sf_dir).select("doc_id", entity_names(F.col("content")).alias("names")).filter(F.size("names") > 0)
    return named.select("doc_id", F.size("names").cast("long").alias("n"), F.array_join("names", " ").alias("names"))
