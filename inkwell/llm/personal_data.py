"""Personal data: base patterns, and terms that give a protected value away by corpus co-occurrence; DataFrame functions only.

Protected values are what the base patterns find (e-mail addresses, IP addresses, card and phone numbers, each in normal form). A
term is a run of at least three letters. For a value v and a term t among the CONTEXT terms next to v on either side, over distinct texts:
information content IC(v) = log2(N / n(v)), pointwise mutual information PMI(v, t) = log2(N * n(v, t) / (n(v) * n(t))). Knowing t reveals the
share PMI / IC of v. From REMOVE on the term is removed and from GENERALISE on it is replaced by its class, everywhere in the
documents where it stands next to v; values and pairs found in fewer than MIN_TEXTS distinct texts tell nothing and are left alone. So documents without
personal data stay as they are, and exact copies do not turn chance into evidence.

Work is linear: a value meets only its neighbours, never all words of its document or all documents of its terms.
Places come from the lengths of matches and of the gaps between them; no text is matched twice per kind. Patterns are possessive and anchored to the
start of a run (or the end of the last match), so no run is scanned from each of its places and no group recurses.

Defined cases: null text is empty and has no spans; null doc_id and repeated rows are kept, each with its own text's spans; spans of different
kinds may overlap, also with equal starts; terms inside base spans are not marked again; no rows give no rows; texts of any length are worked on
whole; extra columns are passed through, and those called like an added one (base, spans, sanitised) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let, table, unused, written
from .line_dedup import halving_steps, holds

#: Kinds in the order in which spans of equal start are listed.
EMAIL, IP, CARD, PHONE, REMOVED, GENERALISED = KINDS = ("email", "ip", "card", "phone", "removed", "generalised")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    EMAIL: rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    IP: r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Chains of fewer than 12 digits fail anyway and are not cut out.
    CARD: r"[0-9](?:[\x20-]?[0-9]){11,}+",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap sign that a text may hold the kind.
SIGNS = {EMAIL: "@", IP: r"[0-9]\.[0-9]++\.[0-9]", CARD: r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", PHONE: r"\+[0-9]"}
TERM = r"\p{L}{3,}+"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CONTEXT = 10
MIN_TEXTS = 3
REMOVE, GENERALISE = 0.9, 0.7
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
_STEP = 256


def normal(kind: str, value: Column) -> Column:
    """One spelling for each protected value."""
    return ascii_lower(value) if kind == EMAIL else F.regexp_replace(value, r"(?<![0-9])0+(?=[0-9])", "") if kind == IP else F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == CARD:
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15) if kind == PHONE else value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$") if kind == IP else F.lit(True)


def before(sizes: Column) -> Column:
    """The sum of all earlier sizes for each place. By blocks of _STEP, so that n sizes cost n * _STEP / 2 additions."""
    add = lambda a, x: a + x
    total = lambda part: F.aggregate(part, F.lit(0), add)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / _STEP).cast("int")), lambda b: total(F.slice(sizes, b * _STEP + 1, F.lit(_STEP))))
    heads = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return let(heads, lambda h: F.transform(sizes, lambda _, i: F.get(h, F.floor(i / _STEP).cast("int")) + total(F.slice(sizes, F.floor(i / _STEP).cast("int") * _STEP + 1, i % _STEP))))


def matches(text: Column, pattern: str, rank: int) -> Column:
    """All matches with their places in code points, end exclusive."""

    def placed(gaps: Column, hits: Column) -> Column:
        sizes = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))
        return let(before(sizes), lambda at: F.transform(hits, lambda h, i: let(F.get(at, i) + F.length(F.get(gaps, i)), lambda s: F.struct(s.alias("start"), F.lit(rank).alias("kind"), (s + F.length(h)).alias("end"), h.alias("value")))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), lambda gaps: placed(gaps, hits))).otherwise(F.array().cast(SPAN)))


def base_spans(text: Column) -> Column:
    """What the base patterns find, sorted by start and kind."""
    text = F.coalesce(text, F.lit(""))

    def found(rank: int, kind: str) -> Column:
        return F.when(text.rlike(SIGNS[kind]), F.filter(matches(text, PATTERNS[kind], rank), lambda s: valid(kind, s["value"]))).otherwise(F.array().cast(SPAN))

    return F.array_sort(F.concat(*[found(i, k) for i, k in enumerate(PATTERNS)]))


def neighbours(text: Column, kind: str, context: int = CONTEXT) -> Column:
    """Each valid value of a kind in its normal form, with the terms next to it (up to the next match of the kind)."""

    def of(gaps: Column, hits: Column) -> Column:
        terms = F.transform(gaps, lambda g: F.regexp_extract_all(ascii_lower(g), F.lit(TERM), F.lit(0)))
        near = lambda t, i: F.array_distinct(F.concat(F.reverse(F.slice(F.reverse(F.get(t, i)), 1, context)), F.slice(F.get(t, i + 1), 1, context)))
        pairs = lambda t: F.transform(hits, lambda h, i: F.when(valid(kind, h), F.struct(F.lit(kind).alias("kind"), normal(kind, h).alias("value"), near(t, i).alias("terms"))))
        return F.filter(let(terms, pairs), lambda x: x.isNotNull())

    empty = F.array().cast("array<struct<kind:string,value:string,terms:array<string>>>")
    return F.when(text.rlike(SIGNS[kind]), let(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, of(F.split(text, PATTERNS[kind], -1), hits)).otherwise(empty))).otherwise(empty)


def _share() -> Column:
    """PMI over IC; null where a value is in every text."""
    content = F.log2(F.col("n") / F.col("n_v"))
    return F.when(content > 0, F.log2(F.col("n") * F.col("n_vt") / (F.col("n_v") * F.col("n_t"))) / content)


def disclosing(texts: DataFrame, context: int = CONTEXT, least: int = MIN_TEXTS, generalise: float = GENERALISE) -> DataFrame:
    """t, u, term, share: the terms that reveal a value next to them in the text of hash (t, u), and the greatest share revealed.

    texts: t, u, body (never null).
    """
    values = F.explode(F.concat(*[neighbours(F.col("body"), k, context) for k in PATTERNS])).alias("v")
    facts = written(texts.select("t", "u", values).select("t", "u", "v.kind", "v.value", F.explode_outer("v.terms").alias("term")).distinct())
    total = texts.select("t", "u").distinct().agg(F.count(F.lit(1)).alias("n"))
    by_value = facts.select("t", "u", "kind", "value").distinct().groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_v")).filter(F.col("n_v") >= least)
    by_pair = facts.filter("term IS NOT NULL").groupBy("kind", "value", "term").agg(F.count(F.lit(1)).alias("n_vt")).filter(F.col("n_vt") >= least)
    # A term is in at least as many texts as stand in facts, so pairs whose share is too small even then need no count over all texts:
    # these are the common words, which most rows of that count would be for.
    known = facts.filter("term IS NOT NULL").select("t", "u", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    pairs = by_pair.join(by_value, ["kind", "value"]).join(known, "term").crossJoin(F.broadcast(total))
    pairs = written(pairs.filter(_share() >= generalise - 1e-9).drop("n_t"))
    asked = pairs.select("term").distinct()
    held = texts.select("t", "u", F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("body")), F.lit(TERM), F.lit(0)))).alias("term")).join(asked, "term", "left_semi")
    by_term = held.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    told = pairs.join(by_term, "term").select("kind", "value", "term", _share().alias("share")).filter(F.col("share") >= generalise)
    return facts.join(told, ["kind", "value", "term"]).groupBy("t", "u", "term").agg(F.max("share").alias("share"))


def term_spans(texts: DataFrame, told: DataFrame, remove: float = REMOVE) -> DataFrame:
    """t, u, more: the places of disclosing terms outside base spans, once for each text."""
    names = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("term"))))
    terms = told.groupBy("t", "u").agg(names(F.col("share") >= remove).alias("gone"), names(F.col("share") < remove).alias("wide"))
    inside = lambda base, s: F.exists(base, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    rank = lambda v: F.when(holds(F.col("gone"), F.col("gone_steps"), v), KINDS.index(REMOVED)).when(holds(F.col("wide"), F.col("wide_steps"), v), KINDS.index(GENERALISED))
    marked = F.transform(matches(ascii_lower(F.col("body")), TERM, -1), lambda s: F.struct(s["start"].alias("start"), rank(s["value"]).alias("kind"), s["end"].alias("end"), F.lit(None).cast("string").alias("value")))
    more = let(F.filter(marked, lambda s: s["kind"].isNotNull()), lambda found: F.when(F.size(found) > 0, let(base_spans(F.col("body")), lambda base: F.filter(found, lambda s: ~inside(base, s)))).otherwise(found))
    rows = texts.join(terms, ["t", "u"]).withColumns({"gone_steps": halving_steps(F.col("gone")), "wide_steps": halving_steps(F.col("wide"))})
    return rows.select("t", "u", more.alias("more")).groupBy("t", "u").agg(F.first("more").alias("more"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def cleaned(text: Column, spans: Column) -> Column:
    """The text with base spans and generalised terms replaced by their class, and removed terms left out. Of spans that overlap the first counts."""
    text = F.coalesce(text, F.lit(""))
    class_of = F.array(*[F.lit(f"[{k}]") for k in (EMAIL, IP, CARD, PHONE)], F.lit(""), F.lit("[term]"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.element_at(class_of, s["kind"] + 1))
        return F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(piece)).alias("out")))

    return F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, text: str = "text", context: int = CONTEXT, least: int = MIN_TEXTS, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """docs with base and spans (arrays of start, kind, end, value) and the sanitised text."""
    docs = docs.drop("base", "spans", "sanitised")
    t, u, base, more = unused(docs, "_t", "_u", "_base", "_more")
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.xxhash64(body).alias("t"), F.xxhash64(F.lit(1), body).alias("u"), body.alias("body"))
    found = term_spans(texts, written(disclosing(texts, context, least, generalise)), remove)
    rows = docs.withColumns({t: F.xxhash64(body), u: F.xxhash64(F.lit(1), body), base: base_spans(F.col(text))})
    rows = rows.join(found.select(F.col("t").alias(t), F.col("u").alias(u), F.col("more").alias(more)), [t, u], "left")
    spans = F.when(F.col(more).isNull(), F.col(base)).otherwise(F.array_sort(F.concat(base, more)))
    rows = rows.withColumns({"base": F.col(base), "spans": spans}).drop(t, u, base, more)
    return rows.withColumn("sanitised", cleaned(F.col(text), F.col("spans")))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS body FROM documents
), texts AS (
  SELECT DISTINCT body FROM docs
), kinds AS (
  SELECT * FROM (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
                        (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')) k(rank, kind, pattern)
), cut AS (
  SELECT body, 0 AS rank, 'email' AS kind, regexp_extract_all(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS hits, string_split_regex(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS gaps FROM texts
  UNION ALL SELECT body, 1, 'ip', regexp_extract_all(body, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), string_split_regex(body, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') FROM texts
  UNION ALL SELECT body, 2, 'card', regexp_extract_all(body, '[0-9](?:[\x20-]?[0-9]){11,}'), string_split_regex(body, '[0-9](?:[\x20-]?[0-9]){11,}') FROM texts
  UNION ALL SELECT body, 3, 'phone', regexp_extract_all(body, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(body, '\+[0-9][\x20().0-9-]+[0-9]') FROM texts
), hits AS (
  SELECT body, rank, kind, i, hits[i] AS value, gaps[i] AS before, gaps[i + 1] AS after, regexp_replace(hits[i], '[^0-9]', '', 'g') AS digits,
         list_sum(list_transform(gaps[: i], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(hits[: i - 1], lambda h: length(h))), 0)::BIGINT AS start
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM cut WHERE len(hits) > 0)
), base AS (
  SELECT *, CASE kind WHEN 'email' THEN translate(value, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                      WHEN 'ip' THEN array_to_string(list_transform(string_split(value, '.'), lambda p: CASE WHEN ltrim(p, '0') = '' THEN '0' ELSE ltrim(p, '0') END), '.') ELSE digits END AS v
  FROM hits WHERE CASE kind WHEN 'email' THEN true WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS HUGEINT), 0) > 255)) = 0
    ELSE length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k: CASE WHEN (length(digits) - k) % 2 = 0 THEN digits[k]::INT ELSE digits[k]::INT * 2 - CASE WHEN digits[k]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0 END
), facts AS (
  SELECT DISTINCT body, kind, v, unnest(list_concat(b[greatest(len(b) - 9, 1) :], a[: 10])) AS term
  FROM (SELECT body, kind, v, regexp_extract_all(translate(before, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\p{L}{3,}') AS b, regexp_extract_all(translate(after, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\p{L}{3,}') AS a FROM base)
), words AS (
  SELECT DISTINCT body, unnest(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\p{L}{3,}')) AS term FROM texts
), share AS (
  SELECT kind, v, term, log2((SELECT count(*) FROM texts)::DOUBLE * n_vt / (n_v * n_t)) / log2((SELECT count(*) FROM texts)::DOUBLE / n_v) AS share
  FROM (SELECT kind, v, term, count(*) AS n_vt FROM facts GROUP BY ALL HAVING count(*) >= 3)
  JOIN (SELECT kind, v, count(DISTINCT body) AS n_v FROM base GROUP BY ALL HAVING count(DISTINCT body) >= 3) USING (kind, v)
  JOIN (SELECT term, count(*) AS n_t FROM words GROUP BY ALL) USING (term) WHERE n_v < (SELECT count(*) FROM texts)
), told AS (
  SELECT body, term, max(share) AS share FROM facts JOIN share USING (kind, v, term) WHERE share >= 0.7 GROUP BY ALL
), runs AS (
  SELECT body, hits[i] AS term, list_sum(list_transform(gaps[: i], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(hits[: i - 1], lambda h: length(h))), 0)::BIGINT AS start
  FROM (SELECT body, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
        FROM (SELECT body, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\p{L}{3,}') AS hits, string_split_regex(body, '\p{L}{3,}') AS gaps FROM texts WHERE body IN (SELECT body FROM told)))
), spans AS (
  SELECT body, rank, kind, start, start + length(value) AS stop FROM base
  UNION ALL
  SELECT body, CASE WHEN share >= 0.9 THEN 4 ELSE 5 END, CASE WHEN share >= 0.9 THEN 'removed' ELSE 'generalised' END, start, start + length(term)
  FROM runs r JOIN told USING (body, term) WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.body = r.body AND b.start < r.start + length(r.term) AND b.start + length(b.value) > r.start)
)
SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 4), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans
FROM docs LEFT JOIN spans USING (body) GROUP BY row_id, doc_id
"""
