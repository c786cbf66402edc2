"""Questions that lean on earlier turns: their subject, their rewriting, the state that a conversation carries, and checks of answers.

Null and empty texts lean on nothing and have no subject. Every rule is decided by its words in markers; model calls are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markers
from ..functions import text as tx
from ..plans.registry import query
from ..plans.session import table
from .documents import any_sql
from .rules import version_scope

SUBJECT_CHARS, SHORT_QUESTION = 60, 16
USER_TURNS, MESSAGES = 4, 5


def _some(text: Column) -> Column:
    """The text trimmed, or null where nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def named_titles(text: Column) -> Column:
    """Titles between title marks, each once, in order, with the marks."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("《([^》]{2,80})》"), F.lit(1)), lambda x: F.trim(x))
    return F.transform(F.array_distinct(F.filter(found, lambda t: t != "")), lambda t: F.concat(F.lit("《"), t, F.lit("》")))


def referenced_titles(text: Column) -> Column:
    """Titles that an answer lists as its sources."""
    inside = F.regexp_extract(F.coalesce(text, F.lit("")), r"\[参考文档:\s*([^\]]+)\]", 1)
    found = F.filter(F.transform(F.split(inside, "[、,，]"), lambda t: F.regexp_replace(F.trim(t), "^《+|》+$", "")), lambda t: t != "")
    return F.transform(F.array_distinct(found), lambda t: F.concat(F.lit("《"), t, F.lit("》")))


def compact_subject(text: Column) -> Column:
    """The first sentence, at most 60 characters."""
    return F.rtrim(F.substring(F.trim(F.get(F.split(F.trim(F.coalesce(text, F.lit(""))), "[。！？\n；;]", 2), F.lit(0))), 1, SUBJECT_CHARS))


def subject_of(text: Column) -> Column:
    """What a question is about: the last title it names, a phrase that ends like a rule's name, or its first sentence; null without text."""
    phrase = F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), markers.SUBJECT, 1), "^[：。；; ]+|[：。；; ]+$", "")
    return F.coalesce(F.try_element_at(named_titles(text), F.lit(-1)), _some(phrase), _some(compact_subject(text)))


def follow_up(text: Column) -> Column:
    """Words that ask for a detail, a start that points back, or a short question."""
    q = F.trim(F.coalesce(text, F.lit("")))
    return tx.any_of(q, markers.FOLLOW_UP_WORDS) | q.rlike("^(?:" + "|".join(markers.FOLLOW_UP_STARTS) + ")") | ((F.length(q) <= SHORT_QUESTION) & q.rlike("[?？]$"))


def leans(text: Column) -> Column:
    """A follow-up, or a question with a word that stands for an earlier subject or version."""
    q = F.trim(F.coalesce(text, F.lit("")))
    return follow_up(q) | tx.any_of(q, markers.AMBIGUOUS_WORDS) | tx.any_of(q, markers.VERSION_WORDS)


def _bare(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(title), "^《+|》+$", ""))


def _terms(q: Column, mode: Column, rules) -> Column:
    """The search terms of the first rule that the question's words or its mode call for; null without one."""
    out = F.lit(None).cast("string")
    for name, words, terms in reversed(rules):
        out = F.when(tx.any_of(q, words) | (mode == name), terms).otherwise(out)
    return out


def by_title(text: Column, mode: Column) -> Column:
    """A question that names a document as a search for that document; null for other questions."""
    title = _some(_bare(F.try_element_at(named_titles(text), F.lit(-1))))
    return F.concat(title, F.lit(" "), _terms(F.coalesce(text, F.lit("")), mode, markers.TITLE_REWRITES))


def with_subject(text: Column, subject: Column, mode: Column) -> Column:
    """A question together with the subject it leans on."""
    q, title = F.trim(F.coalesce(text, F.lit(""))), _some(_bare(subject))
    searched = F.concat(F.lit("《"), title, F.lit("》 "), _terms(q, mode, markers.SUBJECT_REWRITES), F.lit("；补充问题："), q)
    return F.coalesce(searched, F.when(q.contains(F.trim(subject)), q), F.concat(F.trim(subject), F.lit("；补充问题："), q))


def valid_rewrite(text: Column) -> Column:
    """Whether a model's rewriting is a question: one line of 3 to 120 characters, no list, no answer, no traces of a broken encoding."""
    t = F.trim(F.coalesce(text, F.lit("")))
    broken = (F.regexp_count(t, F.lit(r"\?")) >= 3) | t.contains("锟") | t.rlike(r"[\n\r]") | t.rlike(r"^(?:#|-|\*|[123]\.)") | tx.any_of(t, markers.NOT_REWRITE)
    return F.length(t).between(3, 120) & ~broken & (t.rlike("[一-鿿]") | (F.regexp_count(t, F.lit(r"[\p{L}\p{N}]")) >= 6))


@query(
    rf"""WITH u AS (SELECT *, trim(text) AS q, nullif(rtrim(substr(trim(string_split_regex(trim(text), '[。！？\n；;]')[1]), 1, {SUBJECT_CHARS})), '') AS s FROM conversations WHERE role = 'user' AND text IS NOT NULL),
  c AS (SELECT conv_id, turn, q, last_value(s IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {USER_TURNS} PRECEDING AND 1 PRECEDING) AS near,
    last_value(s IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS any_before,
    last_value(nullif(regexp_extract(text, '(20[0-9]{{2}}年|20[0-9]{{2}}-[0-9]{{1,2}}-[0-9]{{1,2}}|上一版|前一版|新版|旧版)', 1), '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS version,
    {any_sql("q", markers.FOLLOW_UP_WORDS + markers.AMBIGUOUS_WORDS + markers.VERSION_WORDS)} OR (length(q) <= {SHORT_QUESTION} AND regexp_matches(q, '[?？]$')) OR regexp_matches(q, '^(那|这个|该制度|它)') AS leaning FROM u),
  d AS (SELECT *, coalesce(near, any_before) AS subject FROM c)
SELECT conv_id, turn, leaning, subject, coalesce(version, '') AS version, CASE WHEN leaning AND subject IS NOT NULL THEN 'context_fallback' ELSE 'passthrough' END AS source,
  CASE WHEN NOT leaning OR subject IS NULL OR contains(q, subject) THEN q ELSE subject || '；补充问题：' || q END AS rewritten FROM d"""
)
def rewritten_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question as a search sees it, with the subject and the version that the conversation carries to it.

    The subject is a title in the last answer that names one among the five messages before, else that of the last of four user turns, else
    what the conversation carried.
    """
    said = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    turns, before = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id", "role").orderBy("turn")
    cited = F.when(F.col("role") == "assistant", F.get(F.concat(referenced_titles(F.col("text")), named_titles(F.col("text"))), F.lit(0)))
    asked = said.withColumn("cited", F.last(cited, ignorenulls=True).over(turns.rowsBetween(-MESSAGES, -1))).filter("role = 'user'")
    asked = asked.withColumns({"own": subject_of(F.col("text")), "scope": F.nullif(version_scope(F.col("text")), F.lit(""))})
    asked = asked.withColumns({
        "near": F.coalesce("cited", F.last("own", ignorenulls=True).over(before.rowsBetween(-USER_TURNS, -1))),
        "version": F.coalesce(F.last("scope", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0)), F.lit("")),
        "carried": F.last(F.coalesce("cited", "own"), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)),
    }).withColumns({"subject": F.coalesce("near", "carried"), "leaning": leans(F.col("text")), "titled": by_title(F.col("text"), F.lit("qa"))})
    context = F.when(F.col("leaning") & F.col("subject").isNotNull(), with_subject(F.col("text"), F.col("subject"), F.lit("qa")))
    source = F.when(F.col("titled").isNotNull(), "explicit_title").when(context.isNotNull(), "context_fallback").otherwise("passthrough")
    return asked.select("conv_id", "turn", "leaning", "subject", "version", source.alias("source"), F.coalesce("titled", context, F.trim("text")).alias("rewritten"))


# Answers ---------------------------------------------------------------------------------------------------------------


def structure_problem(agent: Column, intent: Column, answer: Column) -> Column:
    """Which part an answer of this kind lacks: summary, conclusion or comparison; null for none."""
    a = F.coalesce(answer, F.lit(""))
    no_table = ~a.contains(markers.COMPARE_HEADING) & ~a.contains(markers.NO_COMPARISON)
    summary, policy = F.trim(agent) == "summary", (F.trim(agent) == "compliance") & (F.trim(intent) == "qa")
    return F.when(summary & ~a.contains(markers.SUMMARY_HEADING), "summary").when(policy & ~a.contains(markers.CONCLUSION), "conclusion").when((F.trim(intent) == "compare") & no_table, "comparison")


def evidence_fields(text: Column) -> Column:
    """Labelled lines of values found in evidence, at most five values each (the feature's own limit)."""
    t, lines = F.coalesce(text, F.lit("")), []
    for label, pattern in markers.EVIDENCE_FIELDS:
        values = F.slice(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda v: F.regexp_replace(v, r"\s+", " "))), 1, 5)
        lines.append(F.when(F.size(values) > 0, F.concat(F.lit(f"- {label}："), F.array_join(values, "、"))))
    return F.array_compact(F.array(*lines))


def degenerate(real: dict[str, Column], heuristic: dict[str, Column]) -> Column:
    """A measured result of zero where the heuristic says otherwise (faithfulness, relevancy, precision); null counts as zero."""
    r, h = ({k: F.coalesce(v, F.lit(0.0)) for k, v in m.items()} for m in (real, heuristic))
    return ((r["relevancy"] == 0) & (h["relevancy"] >= 0.6)) | ((r["faithfulness"] == 0) & (h["faithfulness"] >= 0.6) & (r["precision"] >= 0.8))
