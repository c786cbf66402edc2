"""Line dedup: lines whose key is found in many documents go from every document; DataFrame functions only.

A document's keys are hashed to 128 bits and made distinct by sorting inside its row, so counting needs one small row for
each (document, key) and partial sums before the shuffle. Text is never exploded into the shuffle: what meets the documents
again is, for each document, the sorted hashes of the keys it loses; each line looks itself up there by binary search, and
what stays is joined again by position. A text of n lines costs about n log n. Keys that hold more than 1 / HOT_PARTS of all
(document, key) rows, of which there can be HOT_PARTS at most, are broadcast and take no part in the shuffled join.

Defined cases: null or empty text is one empty line; every row counts as a document of its own, also when it
repeats another row; null doc_id is kept; no rows give no rows; texts of any length are worked on whole (200,000 distinct lines
take seconds); extra columns are passed through, except that kept_text, n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, ascii_lower, let, table, unused, written

MIN_DOCS = 10
MIN_KEY_CHARS = 1
#: Keys with more than this share of all (document, key) rows are joined by broadcast: fewer than HOT_PARTS keys of 16 bytes.
HOT_PARTS = 10_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return let(F.trim(line, F.lit(BLANKS)), ascii_lower)


def key_hash(key: Column) -> Column:
    """128 bits of a key."""
    return let(key, lambda k: F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b")))


def distinct_sorted(values: Column) -> Column:
    """The distinct values in order. array_distinct compares all pairs of structs; this sorts them."""
    return let(F.array_sort(values), lambda v: F.filter(v, lambda x, i: (i == 0) | (F.get(v, i - 1) != x)))


def holds(ordered: Column, steps: Column, value: Column) -> Column:
    """Whether a sorted array holds value, by binary search; steps: halving_steps(ordered)."""
    step = lambda at, width: F.when(F.coalesce(F.get(ordered, at + width) <= value, F.lit(False)), at + width).otherwise(at)
    return F.get(ordered, F.aggregate(steps, F.lit(0), step)) == value


def halving_steps(ordered: Column) -> Column:
    """The powers of two up to the array's size, from the greatest on."""
    top = F.floor(F.log2(F.greatest(F.size(ordered), F.lit(1)).cast("double"))).cast("int")
    return F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))


def drop_common_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped.

    Rows that repeat id and text have the same lines, so they share one entry of lost lines.
    """
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    t, u, lost_keys, parts_col = unused(docs, "_t", "_u", "_lost", "_parts")
    keyed = docs.withColumns({t: F.xxhash64(text, id_col), u: F.xxhash64(F.lit(1), F.col(text), F.col(id_col))})
    hashes = distinct_sorted(F.transform(F.filter(F.transform(lines_of(F.col(text)), line_key), lambda k: F.length(k) >= min_chars), key_hash))
    # Written once, as the counts and the joins read it: the lines of a text are hashed once.
    found = written(keyed.select(t, u, F.explode(hashes).alias("h")).select(t, u, "h.a", "h.b"))
    common = written(found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs))
    rows = found.count()
    hot = common.filter(F.col("n") * HOT_PARTS > rows).select("a", "b", F.lit(True).alias("hot"))
    marked = found.join(F.broadcast(hot), ["a", "b"], "left")
    rare = common.filter(F.col("n") * HOT_PARTS <= rows).select("a", "b")
    gone = marked.filter("hot").select(t, u, "a", "b").unionByName(marked.filter("hot IS NULL").drop("hot").join(rare, ["a", "b"]))
    lost = gone.groupBy(t, u).agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias(lost_keys))
    out = keyed.join(lost, [t, u], "left")

    def kept(line_list: Column) -> Column:
        return let(halving_steps(F.col(lost_keys)), lambda steps: F.filter(line_list, lambda x: let(key_hash(line_key(x)), lambda h: ~holds(F.col(lost_keys), steps, h))))

    parts = F.when(F.col(lost_keys).isNull(), F.struct(F.size(lines_of(F.col(text))).alias("n"), F.lit(0).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("k"))).otherwise(
        let(lines_of(F.col(text)), lambda ls: let(kept(ls), lambda k: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(k)).alias("d"), F.array_join(k, "\n").alias("k"))))
    )
    part = lambda name: F.col(parts_col)[name]
    return (
        out.withColumn(parts_col, parts)
        .withColumns({"kept_text": part("k"), "n_lines": part("n").cast("long"), "n_dropped": part("d").cast("long")})
        .drop(parts_col, t, u, lost_keys)
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH lines AS (
  SELECT row_id, doc_id, i, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT row_id, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
        FROM (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), common AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT row_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common c ON lines.k = c.k
GROUP BY row_id, doc_id
"""
