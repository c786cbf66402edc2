"""Spelling variants: words that differ by one code point, found by dense comparison of padded code-point matrices.

Words are cut and counted by DataFrame functions. Two words of lengths m and m (or m and m + 1) are near if their common prefix
and common suffix together reach the longer length minus one. So near words share the first half of m characters or
the rest of them from the end: each word joins the blocks of its halves, as the shorter and as the longer partner. A block of over
BLOCK words is split in the same way within the part that its words do not share, until it is small or one character is
left, so a block never holds more than BLOCK words or what one character allows; nothing is capped or dropped. Inside
blocks, tiles of TILE by TILE words are compared column by column in numpy; a pair is reported in exactly one block, the one that its common
prefix picks at each split. Only sums and the best partner of each word leave a task.

Defined cases: null or empty texts have no words; a null doc_id counts as an empty one; every row counts, also when it repeats another
row; of partners with equal counts the smallest in code-point order is the form; no rows give no rows; texts and
words of any length are worked on whole; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

MIN_CHARS = 7
MIN_COUNT = 2
#: One run in so many is garbled by deleting a code point.
GARBLE_EVERY = 31
#: A form occurs at least so many times as often as its variant.
FORM_RATIO = 10
#: Words of a block from which on it is split, if the part that is not shared has two characters or more.
BLOCK = 1024
TILE = 128
#: Rows and matrix cells that a task compares at once, blocks being kept whole.
CHUNK_ROWS, CHUNK_CELLS = 1 << 16, 1 << 26


def garbled(run: Column, doc_id: Column, every: int = GARBLE_EVERY) -> Column:
    """The run, without one code point where its hash with the document's id is a multiple of every."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    k = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), k), F.substring(run, k + 2, F.length(run)))).otherwise(run)


def counted_words(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = GARBLE_EVERY) -> DataFrame:
    """word, n: the runs of letters of at least min_chars after garbling. Shorter runs cannot become words and are never cut out."""
    runs = F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(rf"[a-zÀ-ÿ]{{{min_chars},}}+"), F.lit(0))
    words = docs.select(F.col(id_col).alias("d"), F.explode(runs).alias("run")).select(garbled(F.col("run"), F.col("d"), every).alias("word"))
    return words.filter(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def halves(rows: DataFrame) -> DataFrame:
    """Each row twice: in the block that shares the first half of the open part too, and in the one that shares the second half.

    m: length of the shorter partner; lo, hi: characters shared at both ends; cap: pairs with a common prefix of cap or more
    belong to another block.
    """
    first = F.floor((F.col("m") - F.col("lo") - F.col("hi")) / 2).cast("int")
    middle = F.col("lo") + first
    parts = F.array(F.struct(middle.alias("lo"), F.col("hi").alias("hi"), F.col("cap").alias("cap")), F.struct(F.col("lo").alias("lo"), (F.col("m") - middle).alias("hi"), middle.alias("cap")))
    keyed = rows.withColumn("part", F.explode(parts)).select("word", "n", "m", "part.lo", "part.hi", "part.cap")
    shared = F.struct("m", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.when(F.col("hi") > 0, F.right("word", F.col("hi"))).otherwise(""))
    return keyed.withColumn("block", F.xxhash64(shared))


def blocks(words: DataFrame, min_chars: int = MIN_CHARS, limit: int = BLOCK) -> DataFrame:
    """Rows (word, n, m, lo, hi, cap, block) of all blocks that can hold a pair."""
    size = F.length("word")
    roles = words.withColumn("m", F.explode(F.when(size > min_chars, F.array(size, size - 1)).otherwise(F.array(size))))
    rows = roles.withColumns({"lo": F.lit(0), "hi": F.lit(0), "cap": F.lit(2**31 - 1)})
    done: DataFrame | None = None
    while True:
        rows = written(halves(rows))
        sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.length("word") == F.col("m")).alias("short")).filter("size > 1 AND short > 0")
        sized = written(rows.join(sizes, "block"))
        large = (F.col("size") > limit) & (F.col("m") - F.col("lo") - F.col("hi") > 1)
        small = sized.filter(~large).drop("size", "short")
        done = small if done is None else done.unionByName(small)
        rows = sized.filter(large).drop("size", "short", "block")
        if rows.isEmpty():
            return done


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and the words' code points (all below 256) one word a column, aligned left and right, padded with 0."""
    raw = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    at = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
    column, width = np.repeat(np.arange(len(words)), size), int(size.max())
    left, right = np.zeros((width, len(words)), np.uint8), np.zeros((width, len(words)), np.uint8)
    left[at, column] = raw
    right[np.repeat(size, size) - 1 - at, column] = raw
    return size, left, right


def _common(side: np.ndarray, rows: slice, columns: slice) -> np.ndarray:
    """For each pair of a tile, how many leading code points agree."""
    alive = np.ones((rows.stop - rows.start, columns.stop - columns.start), dtype=bool)
    out = np.zeros(alive.shape, dtype=np.int32 if len(side) > 250 else np.uint8)
    for line in side:
        alive &= line[rows, None] == line[None, columns]
        if not alive.any():
            break
        out += alive
    return out.astype(np.int32)


def _pairs(words: list[str], block: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray, cap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of near pairs among rows that are sorted by block."""
    size, left, right = _matrices(words)
    ends = np.append(np.flatnonzero(np.diff(block)) + 1, len(block))
    end = ends[np.searchsorted(ends, np.arange(len(block)), side="right")]
    one, two = [], []
    for a in range(0, len(words), TILE):
        i = slice(a, min(a + TILE, len(words)))
        for b in range(a, int(end[i.stop - 1]), TILE):
            j = slice(b, min(b + TILE, int(end[i.stop - 1])))
            p, s = _common(left, i, j), _common(right, i, j)
            long, short = np.maximum(size[i, None], size[None, j]), np.minimum(size[i, None], size[None, j])
            near = (p + s >= long - 1) & (long - short <= 1) & (short == m[i, None]) & (block[i, None] == block[None, j]) & (m[i, None] == m[None, j])
            near &= (p < cap[i, None]) & (p >= lo[i, None]) & (s >= hi[i, None]) & (np.arange(i.start, i.stop)[:, None] < np.arange(j.start, j.stop)[None, :])
            x, y = np.nonzero(near)
            one.append(x + a)
            two.append(y + b)
    return np.concatenate(one), np.concatenate(two)


NEAR = "word string, n_near long, form_n long, form string"
_NEAR_ARROW = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


def _compared(words: list[str], n: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """For each row with a near word in its block: how many, and the best of them."""
    one, two = _pairs(words, *columns)
    at, other = np.concatenate([one, two]), np.concatenate([two, one])
    names = np.array(words, dtype=object)
    rank = np.argsort(np.argsort(names, kind="stable"), kind="stable") if len(at) else np.zeros(0, np.int64)
    order = np.lexsort((rank[other], -n[other], at))
    at, other = at[order], other[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    return pa.RecordBatch.from_arrays([pa.array(names[at[first]], pa.string()), pa.array(np.diff(np.append(first, len(at)))), pa.array(n[other[first]]), pa.array(names[other[first]], pa.string())], schema=_NEAR_ARROW)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words inside the blocks of a partition that is sorted by m and block."""
    kept: list[pa.RecordBatch] = []

    def chunk(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal kept
        rows = pa.Table.from_batches(kept).combine_chunks()
        block = rows["block"].to_numpy()
        stop = len(block) if last else int(np.searchsorted(-(block != block[-1]).astype(np.int8), 0))
        if stop:
            done = rows.slice(0, stop)
            yield _compared(done["word"].to_pylist(), *(done[c].to_numpy().astype(np.int64) for c in ("n", "block", "m", "lo", "hi", "cap")))
        kept = rows.slice(stop).to_batches()

    for batch in batches:
        kept.append(batch)
        count = sum(b.num_rows for b in kept)
        if count >= CHUNK_ROWS or count and count * (int(batch.column(batch.schema.get_field_index("m"))[-1].as_py()) + 1) >= CHUNK_CELLS:
            yield from chunk(False)
    if sum(b.num_rows for b in kept):
        yield from chunk(True)


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, limit: int = BLOCK) -> DataFrame:
    """word, n_near, form_n, form: the number of near words and the one of largest count, for words that have any."""
    rows = blocks(words, min_chars, limit).select("block", "m", "lo", "hi", "cap", "word", "n")
    found = rows.repartition("block").sortWithinPartitions("m", "block").mapInArrow(compare, NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def roots(links: DataFrame) -> DataFrame:
    """word, root: links (word, form) followed to their end. Counts grow by FORM_RATIO at each link, so there is no circle and
    the chains are short; each round doubles the distance covered."""
    now = written(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        step = written(now.join(ahead, "root", "left"))
        if step.filter("ahead IS NOT NULL").isEmpty():
            return now
        now = step.select("word", F.coalesce("ahead", "root").alias("root"))


def spelling_variants(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = GARBLE_EVERY, ratio: int = FORM_RATIO, limit: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n; a word's form is its near word of largest n, where that n is at least ratio times the word's."""
    words = written(counted_words(docs, text, id_col, min_chars, min_count, every))
    near = words.join(near_words(words, min_chars, limit), "word", "left")
    fits = F.col("form_n") >= F.col("n") * ratio
    forms = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")))
    ends = roots(forms.filter("form IS NOT NULL"))
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE crc_steps AS (
  SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), hashed AS (
  SELECT run, length(run) AS len, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(encode(d || ':' || run)), '(..)', '\1 ', 'g'), ' ')[:-2], lambda b: ('0x' || b)::BIGINT)),
                                      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
  FROM runs, crc WHERE length(run) >= 7
), words AS (
  SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % len)::INT) || substr(run, (h % len)::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)
), pairs AS (
  SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cuts a JOIN words b ON a.rest = b.word
), near AS (
  SELECT w.word, w.n, count(x.word) AS n_near, (list(x.word ORDER BY x.n DESC, x.word))[1] AS best, max(x.n) AS best_n
  FROM words w LEFT JOIN pairs p ON p.a = w.word LEFT JOIN words x ON x.word = p.b GROUP BY w.word, w.n
), forms AS (
  SELECT word, n, n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM near
), chain AS (
  SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL
)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN ends e ON e.word = f.word
"""
