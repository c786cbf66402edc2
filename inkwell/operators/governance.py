"""Personal data, guards, hidden marks, and the export of training corpora with a reason for every excluded row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markers
from ..functions import text as tx
from ..plans.registry import query
from ..plans.session import table
from .documents import FINGERPRINT_SQL, any_sql

EMAIL, NUMBER = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"(?<![0-9])[0-9]{12,19}(?![0-9])"
CARD_SQL = r"regexp_matches(text, '(^|[^0-9])[0-9]{12,19}($|[^0-9])')"
EMAIL_SQL = r"regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')"


@query(f"SELECT doc_id, {EMAIL_SQL} AS has_email, {CARD_SQL} AS has_number, regexp_matches(text, '(^|[^0-9])1[0-9]{{10}}($|[^0-9])') AS has_phone, {any_sql('lower(text)', markers.DANGER_PHRASES)} AS dangerous FROM documents")
def pii_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.rlike(EMAIL).alias("has_email"), text.rlike(NUMBER).alias("has_number"),
        text.rlike(r"(?<![0-9])1[0-9]{10}(?![0-9])").alias("has_phone"), tx.any_of(F.lower(text), markers.DANGER_PHRASES).alias("dangerous"),
    )


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE {EMAIL_SQL}) AS emails, count(*) FILTER (WHERE {CARD_SQL}) AS numbers, lang FROM documents GROUP BY lang")
def leak_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many outputs a guard would stop, by language."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(text.rlike(EMAIL)).alias("emails"), F.count_if(text.rlike(NUMBER)).alias("numbers"))


INJECTIONS = (*markers.INJECTION_PHRASES, "secret")


@query(f"SELECT doc_id, length(translate(text, '{markers.INVISIBLE}', '')) AS n_chars FROM documents WHERE NOT {any_sql(f'''lower(translate(text, '{markers.INVISIBLE}', ''))''', INJECTIONS)}")
def injection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without phrases that give orders to a model, invisible characters removed first."""
    clean = F.translate("text", markers.INVISIBLE, "")
    return table(spark, sf_dir, "documents").filter(tx.let(F.lower(clean), lambda t: ~tx.any_of(t, INJECTIONS))).select("doc_id", F.length(clean).cast("long").alias("n_chars"))


@query(r"SELECT doc_id, length(text) >= 30 AND length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) < 0.5 * length(regexp_replace(text, '\s', '', 'g')) AS garbled FROM documents")
def garbled_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.garbled(F.col("text")).alias("garbled"))


@query("SELECT doc_id, source, left(md5(source || ':' || doc_id), 16) AS code, doc_id % 3 > 0 AS found FROM documents")
def leak_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hides a code in two of three texts, reads what is there and looks up who received the copy; unmarked copies trace to nobody."""
    docs = table(spark, sf_dir, "documents")
    sent = docs.select("doc_id", "source", tx.mark_code(F.col("source"), F.col("doc_id").cast("string")).alias("code"), "text")
    leaked = sent.select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.concat("text", tx.mark_hidden(F.col("code")))).otherwise(F.col("text")).alias("marked"))
    read = leaked.select("doc_id", tx.mark_read(F.col("marked")).alias("read"))
    return sent.drop("text").join(read, "doc_id").select("doc_id", "source", "code", F.coalesce(F.col("read") == F.col("code"), F.lit(False)).alias("found"))


PATTERNS = (("PHONE", markers.PHONE), ("ID", markers.ID_CARD), ("MONEY", markers.MONEY), ("EMAIL", markers.EMAIL), ("BANK", markers.BANK), ("ADDRESS", markers.ADDRESS), ("NAME", markers.PERSON))


def mask_pii(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, masked, found): personal data replaced by numbered placeholders, and a map from placeholder to value.

    Overlaps go to the earliest start, then the longest, then the label; numbers count from the end of the text back, past
    placeholders that the text itself holds, so that restoring is exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        compiled = [(label, re.compile(p)) for label, p in PATTERNS]
        phone, card = (re.compile(p) for p in (markers.PHONE, markers.ID_CARD))

        def mask(value: str | None) -> tuple[str | None, dict[str, str]]:
            if not value:
                return value, {}
            spans = []
            for label, pattern in compiled:
                for m in pattern.finditer(value):
                    if label == "BANK" and (phone.fullmatch(m[1]) or card.fullmatch(m[1])):
                        continue
                    spans.append((m.start(1), -m.end(1), label))
            kept, to = [], 0
            for start, neg_end, label in sorted(spans):
                if start >= to:
                    kept.append((start, -neg_end, label))
                    to = -neg_end
            out, numbers, found = value, {}, {}
            for start, end, label in reversed(kept):
                numbers[label] = numbers.get(label, 0) + 1
                while f"[{label}_{numbers[label]}]" in value:  # a text that holds such a name itself keeps it
                    numbers[label] += 1
                name = f"[{label}_{numbers[label]}]"
                found[name] = value[start:end]
                out = out[:start] + name + out[end:]
            return out, found

        for batch in batches:
            pairs = [mask(v) for v in batch.column(1).to_pylist()]
            found = pa.array([list(p[1].items()) for p in pairs], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[0] for p in pairs], pa.string()), found], [id_col, "masked", "found"])

    slim = docs.select(id_col, text)
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[id_col].dataType.simpleString()}, masked string, found map<string,string>")


def restore_pii(masked: Column, found: Column) -> Column:
    return F.aggregate(F.map_entries(found), masked, lambda text, e: F.replace(text, e["key"], e["value"]))


@query(f"SELECT doc_id, sha256(text) AS restored_sha256, {EMAIL_SQL} AS had_email, regexp_matches(text, '(^|[^0-9])1[0-9]{{10}}($|[^0-9])') AS had_phone, false AS email_left, false AS phone_left FROM documents")
def pii_mask_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text masked and restored: the digest must be that of the text itself, and no address or number may be left in between."""
    masked = mask_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    has = lambda label: F.exists(F.map_keys("found"), lambda k: k.startswith(f"[{label}_"))
    return masked.select(
        "doc_id", F.sha2(restore_pii(F.col("masked"), F.col("found")), 256).alias("restored_sha256"), has("EMAIL").alias("had_email"), has("PHONE").alias("had_phone"),
        F.col("masked").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("email_left"), F.col("masked").rlike(r"(?<![0-9])1[0-9]{10}(?![0-9])").alias("phone_left"),
    )


@query(
    f"""SELECT doc_id, CASE WHEN n_chars < 200 THEN 'too_short' WHEN n_chars > 20000 THEN 'too_long' WHEN first > 1 THEN 'duplicate' WHEN {any_sql("lower(text)", ("secret", "password"))} THEN 'sensitive' ELSE 'kept' END AS outcome,
  3 * (text LIKE '%the %')::INTEGER + (effective IS NOT NULL)::INTEGER AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY {FINGERPRINT_SQL.format("text")} ORDER BY doc_id) AS first, nullif(regexp_extract(text, '(20[0-9]{{2}})', 1), '') AS effective FROM documents)"""
)
def corpus_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its outcome: kept, or why it is left out; and a score for ranking.

    The first of equal fingerprints comes from a grouped minimum, so no group of copies is gathered in one task.
    """
    text = F.col("text")
    score = 3 * text.contains("the ").cast("int") + text.rlike("20[0-9]{2}").cast("int")
    # All that the rules need of a text is worked out before the join, so no text is shuffled.
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", tx.fingerprint(text).alias("fp"), tx.any_of(F.lower(text), ("secret", "password")).alias("sensitive"), score.alias("score"))
    firsts = docs.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rows = docs.join(firsts, "fp")
    outcome = (
        F.when(F.col("n_chars") < 200, "too_short").when(F.col("n_chars") > 20000, "too_long").when(F.col("doc_id") != F.col("first"), "duplicate")
        .when(F.col("sensitive"), "sensitive").otherwise("kept")
    )
    return rows.select("doc_id", outcome.alias("outcome"), "score")


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN n_chars < 200 THEN 'too_short' WHEN n_chars > 20000 THEN 'too_long' ELSE 'kept' END AS outcome FROM documents) GROUP BY outcome")
def excluded_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("n_chars") < 200, "too_short").when(F.col("n_chars") > 20000, "too_long").otherwise("kept")
    return table(spark, sf_dir, "documents").groupBy(reason.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, count(*) AS n_messages, md5(string_agg('<' || role || '>' || chr(10) || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def sft_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one training text."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(F.lit("<"), x["role"], F.lit(">\n"), x["text"])), "\n")
    return rows.select("conv_id", F.size("t").cast("long").alias("n_messages"), F.md5(text).alias("digest"))


@query("SELECT part, count(*) AS n FROM (SELECT CASE WHEN ('0x' || left(md5('42:' || doc_id), 8))::BIGINT < 0.8 * 4294967296 THEN 'train' ELSE 'eval' END AS part FROM documents) GROUP BY part")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded split by hash, which needs no global order and gives every row the same side on every run."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double")
    return table(spark, sf_dir, "documents").groupBy(F.when(u < 0.8 * 4294967296, "train").otherwise("eval").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, text AS question, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'")
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer pairs of adjacent turns."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("text").over(w).alias("answer"), F.lead("role").over(w).alias("next_role"))
    return rows.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", "question", "answer")
