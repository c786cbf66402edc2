"""Phrase collocations of each language: best-first growth with admissible bounds.

A phrase's score is at most 1000 * n / f of its first word and of its last word, as the rest occurs at least as often as the phrase. The
frontier is therefore opened from rare words to common ones, in waves: a wave opens the words of f up to GROWTH times the last
bound and grows phrases from them, to the right and to the left, as long as their end pairs reach the least count.
Phrases with both ends opened are then scored exactly. A language is settled when its score at rank TOP is above the bound of every word not
yet opened (ties are inside); its texts take no part in later waves. Most words of a text are common ones, and in a large
language they are never opened.

Texts are cut and hashed by numpy inside tasks; counts meet in Spark by the 64-bit hashes of their words (which include
the language). What a task must know of opened words is a bit table of BITS bits, whatever the input: a false hit there only counts
phrases that the exact tables drop again, and the same table decides in the next wave what was counted before.

Defined cases: null text is empty; null lang is `und`; every row counts, also when it repeats another; pieces never cross rows; equal scores and counts rank by phrase;
no rows, or no phrase of the least count, give no rows; texts of any length are worked on whole; columns other than text and lang are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .textops import byte_table, mix, pieces, run_hashes

MOST_WORDS = 5
MIN_COUNT = 100
TOP = 2000
#: The bound of a wave is so many times the last one's.
GROWTH = 16
BITS = 1 << 26

_BREAKS, _ENDS = re.compile(rb"[.,;:!?\n-\r]"), re.compile(rb"[ \t.,;:!?\n-\r]")
_BREAK, _BLANK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK[list(b" \t")] = True
_VALUES = byte_table(lower=True, outside=b" \t.,;:!?\n\x0b\x0c\r")
#: Bytes of text whose counts are summed in a task before they leave it.
_PIECE = 4 << 20
_PLACES = [f"w{i}" for i in range(1, MOST_WORDS + 1)]
_COUNTS = pa.schema([*((p, pa.int64()) for p in _PLACES), ("c", pa.int64())])
_WORDS = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("word", pa.string()), ("c", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema)


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _parts(batch: pa.RecordBatch, step: int = 1 << 20) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts in parts of about step bytes, cut where pieces end: bytes, word hashes, word starts, piece of each word, row of each word.

    batch: columns lang, text.
    """
    texts = batch.column(1).cast(pa.binary()).to_pylist()
    salts = np.array([_salt(x) for x in batch.column(0).to_pylist()], dtype=np.uint64)
    joined = b"\n".join(t or b"" for t in texts) + b"\n"
    ends = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts)))
    at = 0
    while at < len(joined):
        cut = _BREAKS.search(joined, min(at + step, len(joined) - 1)).end()
        part = joined[at:cut]
        raw = np.frombuffer(part, dtype=np.uint8)
        breaks = _BREAK[raw]
        hashes, starts = run_hashes(raw, ~(breaks | _BLANK[raw]), _VALUES)
        rows = np.searchsorted(ends, starts + at, side="right")
        with np.errstate(over="ignore"):
            yield part, mix(hashes + salts[rows]), starts, np.cumsum(breaks)[starts] if len(starts) else starts, rows
        at = cut


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1, limit=_PIECE):
        langs, found = batch.column(0).to_pylist(), []
        for part, hashes, starts, _, rows in _parts(batch):
            h, first, c = np.unique(hashes, return_index=True, return_counts=True)
            words = [part[s : _ENDS.search(part, s).start()].lower() for s in starts[first]]
            found.append((h, c, np.array(words, dtype=object), rows[first]))
        if not found:
            continue
        hashes, counts, words, rows = (np.concatenate([f[i] for f in found]) for i in range(4))
        h, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.bincount(inverse, counts, len(h)).astype(np.int64)
        columns = [pa.array([langs[r] for r in rows[first]], pa.string()), pa.array(h.view(np.int64)), pa.array(words[first], pa.binary()).cast(pa.string()), pa.array(total)]
        yield pa.RecordBatch.from_arrays(columns, schema=_WORDS)


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _joined(hashes: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """One hash for the size words from each start on."""
    with np.errstate(over="ignore"):
        out = hashes[start]
        for k in range(1, size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[start + k])
    return out


def _counter(sizes: range, words: Broadcast, now: Broadcast, before: Broadcast, pairs: Broadcast | None) -> Callable:
    """Counts phrases of the sizes with an end opened in this wave and none opened before; pairs: a bit table of frequent pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, opened, earlier = words.value, now.value, before.value
        for batch in pieces(batches, 1, limit=_PIECE):
            for size in sizes:
                found = []
                for _, h, _, piece, _ in _parts(batch):
                    if len(h) < size:
                        continue
                    known = _has(frequent, h)
                    runs = np.concatenate([[0], np.cumsum(known)])
                    start = np.flatnonzero((piece[: len(h) - size + 1] == piece[size - 1 :]) & (runs[size:] - runs[:-size] == size))
                    first, last = h[start], h[start + size - 1]
                    left, right, old = _has(opened, first), _has(opened, last), _has(earlier, first) | _has(earlier, last)
                    if pairs is not None:
                        left &= _has(pairs.value, _joined(h, start, 2))
                        right &= _has(pairs.value, _joined(h, start + size - 2, 2))
                    start = start[(left | right) & ~old]
                    key, index, c = np.unique(_joined(h, start, size), return_index=True, return_counts=True)
                    found.append((key, c, h[start[index][:, None] + np.arange(size)]))
                if found:
                    keys, counts, parts = (np.concatenate([f[i] for f in found]) for i in range(3))
                    _, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
                    total, rows = np.bincount(inverse, counts, len(index)).astype(np.int64), parts[index].view(np.int64)
                    columns = [pa.array(np.ascontiguousarray(rows[:, i])) if i < size else pa.nulls(len(index), pa.int64()) for i in range(MOST_WORDS)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(total)], schema=_COUNTS)

    return count


def _bits(hashes: DataFrame, size: int) -> Broadcast:
    """The bit table of column h: size bits (a power of two), so what reaches the driver and is broadcast has a fixed size."""
    at = F.col("h").bitwiseAND(F.lit(size - 1))
    cells = hashes.select(F.shiftright(at, 6).cast("int").alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, dtype=np.uint64)
    out[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out)


def _pair_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = np.stack([batch.column(i).to_numpy().view(np.uint64) for i in (0, 1)], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(_joined(w, np.arange(0, len(w), 2), 2).view(np.int64))], ["h"])


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame, bound: int) -> DataFrame:
    """lang, w, a, l, r, n, score of the surviving phrases whose ends both occur at most bound times.

    phrases: w (array of word hashes), f; words: lang, h, word, f; totals: lang, n.
    """
    ends = words.filter(F.col("f") <= bound)
    first, last = ends.select(F.col("h").alias("one"), "lang"), ends.select(F.col("h").alias("two"))
    found = phrases.withColumns({"one": F.element_at("w", 1), "two": F.element_at("w", -1)}).join(first, "one").join(last, "two").select("lang", "w", F.col("f").alias("a"))
    known = phrases.unionByName(words.select(F.array("h").alias("w"), "f"))
    size = F.size("w")
    cut = found.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select("*", F.slice("w", F.lit(1), F.col("k")).alias("head"), F.slice("w", F.col("k") + 1, size - F.col("k")).alias("tail"))
    cut = cut.join(known.select(F.col("w").alias("head"), F.col("f").alias("l")), "head").join(known.select(F.col("w").alias("tail"), F.col("f").alias("r")), "tail").join(totals, "lang")
    # Decimals of scale 0: exact far beyond 64 bits.
    score = F.expr("(CAST(a AS DECIMAL(18, 0)) * CAST(n AS DECIMAL(18, 0)) * 1000BD) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    best = cut.withColumn("score", score).groupBy("lang", "w", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # A phrase inside any longer one of the same count is inside one that is longer by one word.
    inside = F.explode(F.array(F.slice("w", F.lit(1), size - 1), F.slice("w", F.lit(2), size - 1)))
    closed = phrases.filter(size > 2).select(inside.alias("w"), F.col("f").alias("a")).distinct()
    return best.join(closed, ["w", "a"], "left_anti").select("lang", "w", "a", "best.l", "best.r", "n", "best.score")


def ranked(rows: DataFrame, top: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, growth: int = GROWTH, bits: int = BITS) -> DataFrame:
    """Each language's first top phrases: lang, rank, phrase, a, l, r, n, score."""
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counts = written(source.mapInArrow(count_words, _ddl(_WORDS)).groupBy("lang", "h", "word").agg(F.sum("c").alias("f")))
    totals = written(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    words = written(counts.filter(F.col("f") >= min_count))
    phrases = docs.sparkSession.createDataFrame([], "w array<long>, f long")
    settled = found = scored(phrases, words, totals, 0)
    # frontier: the words that are not opened yet, of languages that are not settled.
    frontier, bound, before = words, min_count, _bits(words.filter("f < 0").select("h"), bits)
    frequent = _bits(words.select("h"), bits)
    while (least := frontier.agg(F.min("f")).first()[0]) is not None:
        bound *= growth
        while bound < least:
            bound *= growth
        open_langs = frontier.select("lang").distinct()
        texts = source.join(F.broadcast(open_langs) if open_langs.count() <= 10_000 else open_langs, "lang", "left_semi").select("lang", "text")
        # Of all languages, also settled ones, so that what a table says yes to, the next ones do too.
        now = _bits(words.filter(F.col("f") <= bound).select("h"), bits)

        def wave(sizes: range, pairs: Broadcast | None = None, now: Broadcast = now, before: Broadcast = before, texts: DataFrame = texts) -> DataFrame:
            rows = texts.mapInArrow(_counter(sizes, frequent, now, before, pairs), _ddl(_COUNTS)).groupBy(*_PLACES).agg(F.sum("c").alias("f")).filter(F.col("f") >= min_count)
            return written(rows.select(F.array_compact(F.array(*_PLACES)).alias("w"), "f"))

        phrases = phrases.unionByName(wave(range(2, 3)))
        two = phrases.filter(F.size("w") == 2).select(F.element_at("w", 1).alias("a"), F.element_at("w", 2).alias("b"))
        phrases = phrases.unionByName(wave(range(3, MOST_WORDS + 1), _bits(two.mapInArrow(_pair_hash, "h long"), bits)))
        found = written(ranked(scored(phrases, words, totals, bound).join(open_langs, "lang", "left_semi"), top, F.desc("score"), F.desc("a")))
        lowest = found.groupBy("lang").agg(F.count(F.lit(1)).alias("many"), F.min("score").alias("lowest"))
        rest = words.filter(F.col("f") > bound).join(open_langs, "lang", "left_semi").join(totals, "lang").join(lowest, "lang", "left")
        # An unopened word's phrases score at most 1000 * n / f, f > bound.
        unsettled = F.coalesce((F.col("many") < top) | (F.col("lowest") <= F.expr(f"(1000BD * CAST(n AS DECIMAL(18, 0))) div {bound + 1}BD")), F.lit(True))
        frontier = written(rest.filter(unsettled).select("lang", "h", "word", "f"))
        done = found.join(frontier.select("lang").distinct(), "lang", "left_anti").drop("rank")
        settled, before = settled.unionByName(done), now
    names = settled.select("*", F.posexplode("w").alias("at", "h")).join(words.select("h", "word"), "h")
    named = names.groupBy("lang", "w", "a", "l", "r", "n", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return named.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), grams AS (
  SELECT lang, k, ws[i : i + k - 1] AS w, count(*) AS f
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, range(1, 6) t(k)) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, w, f AS a FROM grams WHERE k > 1 AND f >= 100
), cuts AS (
  SELECT c.lang, c.k, c.w, c.a, x.f AS l, y.f AS r, n, cut, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c JOIN totals USING (lang)
  JOIN grams x ON x.lang = c.lang AND x.w = c.w[1 : cut] JOIN grams y ON y.lang = c.lang AND y.w = c.w[cut + 1 : c.k]
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1
), kept AS (
  SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, n, score FROM best b
  WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.lang = b.lang AND c.k > b.k AND c.a >= b.a
                    AND contains(' ' || array_to_string(c.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
