"""Chunking, tagging and fingerprinting of documents; consistency joins between tables."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markers
from ..functions import text as tx
from ..plans.registry import query
from ..plans.session import LIBRARY_SQL, kept, library, table

CHUNK_WORDS, OVERLAP = 128, 0.15
STRIDE = max(1, int(CHUNK_WORDS * (1 - OVERLAP)))
WORDS_SQL = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"
TOKENS_SQL = r"regexp_extract_all(lower({}), '[\x{{4e00}}-\x{{9fff}}A-Za-z0-9]+')"


def any_sql(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def rule_sql(column: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql(column, words)} THEN '{name}'" for name, words in rules) + f" ELSE '{default}' END"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def sliding(words: Column, size: int = CHUNK_WORDS, stride: int = STRIDE) -> Column:
    """Windows of size words every stride words; the last one reaches the end."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(words) - size) / stride)).cast("int") * stride, F.lit(stride))
    return F.when(F.size(words) > 0, F.transform(starts, lambda s: F.slice(words, s + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


@query(
    f"""SELECT doc_id, s // {STRIDE} AS chunk, len(ws[s + 1 : s + {CHUNK_WORDS}]) AS n_words, md5(array_to_string(ws[s + 1 : s + {CHUNK_WORDS}], ' ')) AS digest FROM
  (SELECT doc_id, ws, unnest(range(0, greatest(0, ceil((len(ws) - {CHUNK_WORDS}) / {STRIDE}))::BIGINT * {STRIDE} + 1, {STRIDE})) AS s FROM (SELECT doc_id, {WORDS_SQL.format("text")} AS ws FROM documents) WHERE len(ws) > 0)"""
)
def sliding_word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", words_of(F.col("text")).alias("ws"))
    chunks = docs.select("doc_id", F.posexplode(sliding(F.col("ws"))).alias("chunk", "ws"))
    return chunks.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("ws").cast("long").alias("n_words"), F.md5(F.array_join("ws", " ")).alias("digest"))


def block_type(text: Column) -> Column:
    """heading, table or paragraph."""
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when((F.length(text) <= 40) & text.rlike(r"^(?:[0-9]+[.)]|[A-Z][a-z]+$)"), "heading").when(pipes >= 2, "table").otherwise("paragraph")


@query(
    r"""SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (WHERE t = 'heading') AS n_headings, count(*) FILTER (WHERE t = 'table') AS n_tables, sum(length(b))::BIGINT AS chars FROM (
  SELECT doc_id, b, CASE WHEN length(b) <= 40 AND regexp_matches(b, '^(?:[0-9]+[.)]|[A-Z][a-z]+$)') THEN 'heading' WHEN length(b) - length(replace(b, '|', '')) >= 2 THEN 'table' ELSE 'paragraph' END AS t
  FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS b FROM documents) WHERE length(b) >= 8) GROUP BY doc_id"""
)
def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of eight characters or more, by type; without exploding, as counts per document need no shuffle."""
    blocks = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 8)
    docs = table(spark, sf_dir, "documents").select("doc_id", blocks.alias("b"))
    types = docs.select("doc_id", "b", F.transform("b", block_type).alias("t")).filter(F.size("b") > 0)
    of = lambda name: F.size(F.filter("t", lambda x: x == name)).cast("long")
    chars = F.aggregate("b", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
    return types.select("doc_id", F.size("b").cast("long").alias("n_blocks"), of("heading").alias("n_headings"), of("table").alias("n_tables"), chars.alias("chars"))


@query(r"SELECT doc_id, len(s) AS n_sentences, list_max(list_transform(s, lambda x: length(x))) AS longest FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([。！？；.!?;])', '\1' || chr(10), 'g'), '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0) AS s FROM documents) WHERE len(s) > 0")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s")).filter(F.size("s") > 0)
    return docs.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


HIGH_WORDS = (*markers.HIGH_SENSITIVITY, "secret", "password")
MEDIUM_WORDS = (*markers.MEDIUM_SENSITIVITY, "Licensed", "token")


@query(
    f"""WITH {LIBRARY_SQL} SELECT doc_id, {rule_sql("lower(title)", markers.DEPARTMENT_WORDS, "public")} AS department,
  CASE WHEN {any_sql("content", HIGH_WORDS)} THEN 'high' WHEN {any_sql("content", MEDIUM_WORDS)} THEN 'medium' ELSE 'low' END AS sensitivity,
  {rule_sql("lower(title)", markers.CATEGORY_WORDS, "general")} AS category,
  nullif(regexp_extract(content, '(20[0-9]{{2}}(?:[-/.年][0-9]{{1,2}})?(?:[-/.月][0-9]{{1,2}})?)', 1), '') AS effective_date FROM lib"""
)
def tag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Department and category by title, sensitivity and date by content; the word lists are parameters."""
    docs = library(spark, sf_dir)
    title, content = F.lower("title"), F.col("content")
    sensitivity = F.when(tx.any_of(content, HIGH_WORDS), "high").when(tx.any_of(content, MEDIUM_WORDS), "medium").otherwise("low")
    return docs.select(
        "doc_id", tx.first_rule(title, markers.DEPARTMENT_WORDS, "public").alias("department"), sensitivity.alias("sensitivity"),
        tx.first_rule(title, markers.CATEGORY_WORDS, "general").alias("category"), tx.effective_date(content).alias("effective_date"),
    )


@query(
    r"""WITH r AS (SELECT doc_id, regexp_extract_all(text, '[\x{4e00}-\x{9fff}A-Za-z0-9]{2,}') AS ts FROM documents), e AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM r),
  f AS (SELECT doc_id, arg_min(t, i) AS t, min(i) AS i FROM e GROUP BY doc_id, lower(t)), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
  SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS keywords FROM k WHERE n <= 12 GROUP BY doc_id"""
)
def tag_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve distinct keywords in their first spelling."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.keywords(F.col("text")).alias("k"))
    return docs.filter(F.size("k") > 0).select("doc_id", F.array_join("k", " ").alias("keywords"))


@query(
    rf"""SELECT doc_id, greatest(1, ceil(length(text) / 4))::BIGINT AS by_length,
  greatest(len({WORDS_SQL.format("text")}), len(regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}]{{1,2}}|[A-Za-z0-9]+'))) AS by_units, greatest(1, length(text) // 2) AS for_history,
  len(list_distinct({TOKENS_SQL.format("text")})) AS distinct_terms FROM documents"""
)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = table(spark, sf_dir, "documents"), F.col("text")
    return docs.select(
        "doc_id", tx.tokens_by_length(text).alias("by_length"), tx.tokens_by_units(text).alias("by_units"), tx.tokens_for_history(text).alias("for_history"),
        F.size(F.array_distinct(tx.tokens(text))).cast("long").alias("distinct_terms"),
    )


@query(f"SELECT doc_id, term, round(count(*) / any_value(n), 6) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM (SELECT doc_id, {TOKENS_SQL.format('text')} AS ts FROM documents)) GROUP BY doc_id, term")
def sparse_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term shares of each document; partial sums before the shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("ts"))
    shares = docs.select("doc_id", F.size("ts").alias("n"), F.explode("ts").alias("term")).groupBy("doc_id", "term", "n").agg(F.count(F.lit(1)).alias("c"))
    return shares.select("doc_id", "term", F.round(F.col("c") / F.col("n"), 6).alias("tf"))


FINGERPRINT_SQL = r"left(sha256(left(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), 4000)), 24)"


@query(f"SELECT fp AS fingerprint, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, {FINGERPRINT_SQL.format('text')} AS fp FROM documents) GROUP BY fp")
def fingerprint_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are equal up to case and blanks in their first 4000 characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.fingerprint(F.col("text")).alias("fingerprint"))
    return docs.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(
    """SELECT doc_id, left(md5(source || ':' || lang), 16) AS mark, sha256('cache::' || doc_id) AS cache_key, sha1(source || '|' || doc_id) AS sample_id,
  (('0x' || left(sha256('seed:' || doc_id), 8))::BIGINT % 100)::INTEGER AS bucket FROM documents"""
)
def sha_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    return docs.select(
        "doc_id", tx.mark_code(F.col("source"), F.col("lang")).alias("mark"), F.sha2(F.concat(F.lit("cache::"), key), 256).alias("cache_key"),
        F.sha1(F.concat_ws("|", "source", key)).alias("sample_id"), tx.canary_bucket(key, "seed").alias("bucket"),
    )


SIMHASH_SQL = f"""sh AS (
  SELECT d.doc_id, coalesce(h, 0) AS h FROM documents d LEFT JOIN (
    SELECT doc_id, sum(CASE WHEN 2 * ones > n THEN 1::HUGEINT << i ELSE 0 END)::UBIGINT AS h FROM (
      SELECT doc_id, i, count(*) AS n, sum((h >> i) & 1) AS ones FROM (SELECT doc_id, ('0x' || right(md5(unnest({TOKENS_SQL.format("text")})), 16))::UBIGINT AS h FROM documents), range(0, 64) r(i) GROUP BY doc_id, i
    ) GROUP BY doc_id) b USING (doc_id)
)"""


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, h): SimHash over all terms of the whole text; repeated terms count each time, no terms give 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            coded = lists.flatten().dictionary_encode()  # each term of a batch is hashed once
            known = np.array([tx.term_hash(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64).view(np.int64)
            hashes = known[coded.indices.to_numpy()]
            h = [tx.majority_bits(hashes[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.int64())], ["doc_id", "h"])

    found = tx.tokens(F.col("text"))
    terms = F.when(F.col("text").rlike(f"[{tx.CJK}]"), tx.with_bigrams(found)).otherwise(found)
    return docs.select("doc_id", terms).mapInArrow(run, "doc_id bigint, h bigint")


@query(f"WITH {SIMHASH_SQL} SELECT doc_id, lpad(bin(h), 64, '0') AS bits FROM sh")
def simhash_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of each document as 64 binary digits."""
    return hashed(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.bin("h"), 64, "0").alias("bits"))


BLOCKS = (11, 11, 11, 11, 10, 10)
#: Rows of a task on average, hashes of a run up to which all runs are compared together, and hashes compared with as many others at a time.
TASK_ROWS, SHORT_RUN, SQUARE = 500_000, 32, 1_024
Met = tuple[np.ndarray, np.ndarray, np.ndarray]


def _met(key: np.ndarray, h: np.ndarray, most: int) -> Iterator[Met]:
    """(place, place, distance) of the pairs of hashes with one key that differ in at most most bits, for rows in order of key; see near_pairs."""
    width = sum(sorted(BLOCKS)[most:])
    choices = list(itertools.combinations(range(len(BLOCKS)), len(BLOCKS) - most))
    # By which blocks are equal (a bit each): the first choice of them.
    first = np.array([next((k for k, chosen in enumerate(choices) if all(equal >> i & 1 for i in chosen)), -1) for equal in range(1 << len(BLOCKS))])
    masks = [np.uint64((1 << n) - 1 << sum(BLOCKS[:i])) for i, n in enumerate(BLOCKS)]

    def counted(at: np.ndarray, other: np.ndarray, differ: np.ndarray) -> Met:
        """Of the pairs that are near enough those that count here."""
        equal = sum(((differ & m) == 0).astype(np.int64) << i for i, m in enumerate(masks))
        some = (first[equal] == key[at] >> width) & (differ != 0)
        return at[some], other[some], np.bitwise_count(differ[some])

    edges = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)] if len(key) else np.zeros(1, dtype=np.int64)
    size = np.diff(edges)
    short = (size > 1) & (size <= SHORT_RUN)
    at = np.flatnonzero(np.repeat(short, size))
    end = np.repeat(edges[1:], size)[at]
    for step in range(1, SHORT_RUN):
        at, end = at[at + step < end], end[at + step < end]
        differ = h[at] ^ h[at + step]
        near = np.bitwise_count(differ) <= most
        if near.any():
            yield counted(at[near], at[near] + step, differ[near])
    for run in np.flatnonzero(size > SHORT_RUN):
        a, b = int(edges[run]), int(edges[run + 1])
        for i in range(a, b, SQUARE):
            for j in range(i, b, SQUARE):
                differ = h[i : min(i + SQUARE, b), None] ^ h[None, j : min(j + SQUARE, b)]
                row, column = np.nonzero(np.bitwise_count(differ) <= most)
                row, column = (row[row < column], column[row < column]) if i == j else (row, column)
                if len(row):
                    yield counted(row + i, column + j, differ[row, column])


def _near(hashes: DataFrame, most: int, made: Callable[[np.ndarray, Iterator[Met]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What made makes of the hashes of each task (in order of key) and the pairs found there; see near_pairs."""
    first = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    width = sum(sorted(BLOCKS)[most:])
    block = lambda i: F.call_function("shiftrightunsigned", F.col("h"), F.lit(first[i])).bitwiseAND(F.lit((1 << BLOCKS[i]) - 1))

    def key(k: int, chosen: tuple[int, ...]) -> Column:
        """The number of the choice and its blocks, side by side."""
        places = list(itertools.accumulate((BLOCKS[i] for i in chosen), initial=0))
        return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(block(i), at) for i, at in zip(chosen, places, strict=False)], F.lit(k << width).cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if rows:
            keys, h = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.lexsort((h, keys))
            keys, h = keys[order], h[order].view(np.uint64)
            yield from made(h, _met(keys, h, most))

    choices = itertools.combinations(range(len(BLOCKS)), len(BLOCKS) - most)
    keys = [key(k, chosen) for k, chosen in enumerate(choices)]
    hashes = hashes.filter("h IS NOT NULL")
    each = hashes.select("h", F.explode(F.array(*keys)).alias("key")).select("key", "h")
    tasks = max(hashes.sparkSession.sparkContext.defaultParallelism, -(-hashes.count() * len(keys) // TASK_ROWS))
    return each.repartition(tasks, "key").mapInArrow(run, schema)


def near_pairs(hashes: DataFrame, most: int = 3) -> DataFrame:
    """(a, b, distance) of different 64-bit hashes (column h, one row each) that differ in at most most bits.

    At most most of the six blocks of bits can differ, so the others are equal: to compare those that are equal in each choice of 6 - most blocks (32 bits
    or more at 3) is exact, and rows that share nothing are not paired. A pair meets on each choice of its equal blocks; it counts where the first of them are
    chosen, so no pair has to be remembered.
    """

    def made(h: np.ndarray, met: Iterator[Met]) -> Iterator[pa.RecordBatch]:
        signed = h.view(np.int64)
        for a, b, distance in met:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(signed[a], signed[b])), pa.array(np.maximum(signed[a], signed[b])), pa.array(distance.astype(np.int32))], ["a", "b", "distance"])

    return _near(hashes, most, made, "a bigint, b bigint, distance int")


def near_counts(hashes: DataFrame, most: int = 3) -> DataFrame:
    """(h, n): with how many others each hash is in near_pairs, where it is with any. Each task adds up its own, so there is no row for a pair."""

    def made(h: np.ndarray, met: Iterator[Met]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(h), dtype=np.int64)
        for a, b, _ in met:
            for at in (a, b):
                np.add.at(n, at, 1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)[some]), pa.array(n[some])], ["h", "n"])

    return _near(hashes, most, made, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


@query(f"""WITH {SIMHASH_SQL}, c AS (SELECT h, min(doc_id) AS class_id FROM sh GROUP BY h), l AS (SELECT x.h, count(*) AS n FROM c x, c y WHERE x.h != y.h AND bit_count(xor(x.h, y.h)) <= 3 GROUP BY x.h)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM sh JOIN c USING (h) LEFT JOIN l USING (h)""")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the class of equal SimHashes that it belongs to, and how many other classes are within a distance of 3."""
    docs = kept(hashed(table(spark, sf_dir, "documents")))
    classes = kept(docs.groupBy("h").agg(F.min("doc_id").alias("class_id")))
    links = near_counts(classes.select("h"))
    # Merged, as classes and links grow with the documents and would pass whole through the driver to be broadcast.
    return docs.join(classes.join(links.hint("merge"), "h", "left").hint("merge"), "h").select("doc_id", "class_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id) AND NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = documents.doc_id)")
def consistency_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that neither labels nor the vector index know."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("SELECT vec_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, coalesce(quality, -1) AS quality FROM embeddings LEFT JOIN documents ON vec_id = doc_id LEFT JOIN labels USING (doc_id) WHERE source IS NOT NULL OR quality IS NOT NULL")
def hydrate_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows with what the tables know of them; rows that no table knows go."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").alias("doc_id"))
    full = rows.join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", "left").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    full = full.filter(F.col("source").isNotNull() | F.col("quality").isNotNull())
    return full.select("vec_id", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("SELECT source, count(*) AS n_ready, count(vec_id) AS n_vectors, sum(n_chars)::BIGINT AS chars FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE n_chars >= 200 GROUP BY source")
def reindex_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rebuild of a tenant's indexes would write."""
    docs = table(spark, sf_dir, "documents").filter("n_chars >= 200").select("doc_id", "source", "n_chars")
    rows = docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("vec_id")), "doc_id", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_ready"), F.count("vec_id").alias("n_vectors"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, quality, toxic, copy FROM (SELECT *, row_number() OVER (PARTITION BY source, n_chars ORDER BY doc_id) AS copy FROM documents JOIN labels USING (doc_id)) WHERE copy <= 2")
def best_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two rows of each (source, size), the first by id."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    place = F.row_number().over(Window.partitionBy("source", "n_chars").orderBy("doc_id"))
    return rows.withColumn("copy", place).filter("copy <= 2").select("doc_id", "quality", "toxic", "copy")
