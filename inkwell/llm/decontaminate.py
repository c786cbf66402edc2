"""Benchmark decontamination as a prefix-filtered set join in DataFrame functions.

Benchmark items are cut to windows (13 words; a shorter item is one window). A document contains a window only if it
contains every shingle of the window, so one shingle of each window is a sufficient prefix: the one that is rarest
in the documents. Documents meet the windows on these prefix shingles only. The place of the shingle fixes where the
window would have to start (positional bound), the start and end must lie in the document (length bound), and
what is left is verified word by word.

The documents' words are cut once, for shingles of all lengths: they are hashed and probed in place against the benchmark's
shingles and compared word for word, and only the (document, place, shingle) rows that stand are kept, beside one row with
each document's number of words. Rarity, prefix join and the verification of whole windows work on these. Each table of the
benchmark is broadcast only if its own counted rows are at most BROADCAST_ROWS; otherwise shingles are joined by a shuffle on 128
bits of hash, where a passage found very often is split by adaptive execution.

Defined cases: null or empty text has no words, is never hit and not contaminated; items without words are never
found; a null item_id counts as one item, listed as the empty string; rows that repeat doc_id and text get equal
results; null doc_id is kept; an empty benchmark leaves every document clean; no rows give no rows; extra columns are passed
through, except that n_words, n_hit, items and contaminated are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, named, table, unused, whole, written

WINDOW = 13
SHINGLE = 3
#: Rows up to which a table of the benchmark (its windows, or the shingles of its windows) is broadcast (about 200 bytes each).
BROADCAST_ROWS = 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingles(words: Column, size: int) -> Column:
    """Hashes of the runs of size words in order."""
    return F.when(F.size(words) < size, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0))), lambda i: shingle(words, i, size, 0))
    )


def shingle(words: Column, at: Column, size: int, seed: int) -> Column:
    return F.xxhash64(F.lit(size), F.lit(seed), *[F.get(words, at + k) for k in range(size)])


def windows_of(items: DataFrame, text: str, item_id: str) -> DataFrame:
    """(w, words, item): each window of each item, w being its content's hash."""
    words = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), item_words(F.col(text)).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - WINDOW + 1, F.lit(1)))
    cut = words.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), F.lit(WINDOW)).alias("words"))
    return cut.select(F.xxhash64("words").alias("w"), "words", "item")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", percent: int = 5) -> DataFrame:
    """docs with n_words, n_hit (words inside a found window), items (sorted ids) and contaminated; columns of these names are replaced."""
    docs = docs.drop("n_words", "n_hit", "items", "contaminated")
    t, u = unused(docs, "_t", "_u")
    keyed = docs.withColumns({t: F.xxhash64(text, id_col), u: F.xxhash64(F.lit(1), F.col(text), F.col(id_col))})
    worded = keyed.select(F.col(t).alias("t"), F.col(u).alias("u"), item_words(F.col(text)).alias("words"))
    wins = written(windows_of(items, item_text, item_id).distinct())
    # At most SHINGLE lengths: windows shorter than a shingle are shingles of their own length.
    length = F.least(F.size("words"), F.lit(SHINGLE))
    sizes = sorted(r[0] for r in wins.select(length.alias("n")).distinct().collect())
    runs = F.coalesce(*[F.when(length == size, shingles(F.col("words"), size)) for size in sizes], F.array().cast("array<bigint>"))
    tokens = wins.select("w", "words").distinct().select("w", F.size("words").alias("len"), length.alias("size"), F.posexplode(runs).alias("off", "s"), "words")
    tokens = written(tokens.withColumn("run", F.slice("words", F.col("off") + 1, F.col("size"))).drop("words"))
    small = max(tokens.count(), wins.count()) <= BROADCAST_ROWS
    near = F.broadcast if small else lambda df: df
    places = written(standing(worded, tokens.select("s", "run").distinct(), sizes, small))
    stands = places.filter("at >= 0").select("t", "u", "at", "s")
    sized = places.filter("at < 0").groupBy("t", "u").agg(F.max("s").alias("n_words"))  # rows that repeat id and text are one

    # Order by rarity: how often each shingle stands in the documents. A window with a shingle that stands nowhere is out.
    counts = stands.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    ranked = tokens.join(counts, "s").groupBy("w", "len").agg(F.count(F.lit(1)).alias("have"), F.min_by(F.struct("s", "off"), F.struct("n", "off")).alias("first"))
    complete = tokens.groupBy("w").agg(F.count(F.lit(1)).alias("need")).join(ranked, "w").filter("have = need")
    prefix = complete.select("w", "len", "need", "first.s", "first.off")
    # The prefix shingle fixes the window's start; every other shingle must stand at its own place from there.
    met = stands.join(near(prefix), "s").withColumn("start", F.col("at") - F.col("off")).filter("start >= 0").select("t", "u", "w", "len", "need", "start")
    wanted = met.join(near(tokens.select("w", "off", "s")), "w").withColumn("at", F.col("start") + F.col("off"))
    found = wanted.join(stands, ["t", "u", "at", "s"]).groupBy("t", "u", "w", "start", "len", "need").agg(F.count_distinct("at").alias("have")).filter("have = need")

    hits = found.join(near(wins.select("w", "item")), "w")
    spans = F.array_sort(F.collect_set(F.struct("start", "len")))
    per_doc = hits.groupBy("t", "u").agg(spans.alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    per_doc = sized.join(per_doc.select("t", "u", "items", covered(F.col("spans")).alias("n_hit")), ["t", "u"], "left")
    out = keyed.join(per_doc.withColumnsRenamed({"t": t, "u": u}), [t, u])
    return (
        out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(100) * F.col("n_hit") >= F.lit(percent) * F.col("n_words")))
        .select(*named(docs), "n_words", "n_hit", "items", "contaminated")
    )


def standing(worded: DataFrame, wanted: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """(t, u, at, s): the places of documents where a wanted shingle stands, and a row of each document with at -1 and its number of words as s; wanted: s, run (its words)."""
    place = lambda at, size, s: F.struct(at.cast("int").alias("at"), size.alias("size"), s.cast("bigint").alias("s"))
    count = F.array(place(F.lit(-1), F.lit(0), F.size("words")))

    def of(size: int) -> Column:
        return F.transform(shingles(F.col("words"), size), lambda s, i: place(i, F.lit(size), s))

    exploded = worded.select("t", "u", "words", F.explode(F.concat(count, *map(of, sizes))).alias("p")).select("t", "u", "words", "p.at", "p.size", "p.s")
    if small:
        met = exploded.join(F.broadcast(wanted), "s", "left")
        return met.filter((F.col("at") < 0) | (F.slice("words", F.greatest("at", F.lit(0)) + 1, F.greatest("size", F.lit(1))) == F.col("run"))).select("t", "u", "at", "s")
    second = F.when(F.col("at") >= 0, F.xxhash64(F.lit(1), F.slice("words", F.greatest("at", F.lit(0)) + 1, F.greatest("size", F.lit(1)))))
    slim = exploded.select("t", "u", "at", "s", second.alias("s2"))
    found = slim.filter("at >= 0").join(wanted.select("s", F.xxhash64(F.lit(1), F.col("run")).alias("s2")), ["s", "s2"]).select("t", "u", "at", "s")
    return found.unionByName(worded.select("t", "u", F.lit(-1).alias("at"), F.size("words").cast("bigint").alias("s")))


def covered(places: Column) -> Column:
    """How many positions the (start, len) of a sorted array cover together."""
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(acc["to"], x["start"]))).alias("n"), F.greatest(acc["to"], x["start"] + x["len"]).alias("to")
    )
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda acc: acc["n"])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are not contaminated, with their own columns."""
    wide = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), whole(docs).alias("_row"))
    judged = decontaminate(wide, table(spark, sf_dir, "benchmark").select("item_id", "text"), "_text", "_id")
    return judged.filter(~F.col("contaminated")).select("_row.*")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(ws), {WINDOW}) AS n, array_to_string(ws[i : i + {WINDOW} - 1], ' ') AS w
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)
), hit AS (
  SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.w = bw.w AND dw.n = bw.n
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
