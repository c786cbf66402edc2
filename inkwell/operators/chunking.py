"""Parent segments, packed paragraphs and sentence groups: folds along one document's pieces, in its own row.

A fold with a resetting sum has no window form; each is a small loop over one row's array inside mapInArrow, so
documents stay where they are and nothing is shuffled. A document's pieces are bounded by the document.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.session import table

PARENT_TOKENS, PAGE_LINES = 2048, 40
PACK_MOST, PACK_LEAST = 1400, 180
GROUP_TOKENS, GROUP_LIKENESS, GROUP_OVERLAP = 512, 0.72, 0.15
WORD, UNIT = re.compile("[一-鿿A-Za-z0-9]+"), re.compile("[一-鿿]{1,2}|[A-Za-z0-9]+")


def segments(lines: list[str], most: int = PARENT_TOKENS, page: int = PAGE_LINES) -> list[tuple[int, int, int]]:
    """(first line, lines, tokens) of parents: a new one at a heading after content, at a page's end, or over the budget."""
    out, first, chars = [], 0, 0
    for i, line in enumerate(lines):
        heading = len(line) <= 40 and not line.endswith((".", "!", "?", ";", ","))
        grown = chars + len(line) + (i > first)
        if i > first and (heading or i % page == 0 or -(-grown // 4) > most):
            out.append((first, i - first, -(-chars // 4)))
            first, chars = i, len(line)
        else:
            chars = grown
    if lines:
        out.append((first, len(lines) - first, -(-chars // 4)))
    return out


def packed(lines: list[str], most: int = PACK_MOST, least: int = PACK_LEAST) -> list[tuple[int, int, int]]:
    """(first line, lines, characters) of paragraphs packed up to most characters; short packs go unless nothing else is left."""
    out, first, chars = [], 0, 0
    for i, line in enumerate(lines):
        if i > first and chars + 2 + len(line) > most:
            out.append((first, i - first, chars))
            first, chars = i, len(line)
        else:
            chars = chars + 2 + len(line) if i > first else len(line)
    if lines:
        out.append((first, len(lines) - first, chars))
    return [x for x in out if x[2] >= least] or ([(0, len(lines), sum(map(len, lines)) + 2 * (len(lines) - 1))] if lines else [])


#: Runs up to an end or a line break, and what (?U)\s of the column form takes for blank.
SENTENCE = re.compile(r"[^\n。！？；.!?;]*[。！？；.!?;]|[^\n。！？；.!?;]+")
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def sentences_of(text: str) -> list[str]:
    """The same as functions.text.sentences, which goes through a regular expression for each sentence."""
    return [s for x in SENTENCE.findall(text) if (s := x.strip(BLANK))]


#: Words whose sums a task remembers; common words make up most of a text.
WORDS_KEPT = 1 << 16


@lru_cache(maxsize=WORDS_KEPT)
def word_bytes(word: str) -> bytes:
    return hashlib.sha256(word.encode()).digest()


def sentence_bytes(words: list[list[str]]) -> np.ndarray:
    """Of each sentence's words the sum of the bytes of their SHA-256 sums, 32 numbers."""
    out = np.zeros((len(words), 32))
    some = np.flatnonzero([len(w) > 0 for w in words])
    if len(some):
        digests = np.frombuffer(b"".join([word_bytes(x) for w in words for x in w]), dtype=np.uint8).reshape(-1, 32)
        starts = np.r_[0, np.cumsum([len(words[i]) for i in some])[:-1]]
        out[some] = np.add.reduceat(digests, starts, axis=0, dtype=np.int64)
    return out


def sentence_vector(sentence: str) -> np.ndarray:
    """The hashed embedding of a sentence's words: bytes of their SHA-256 sums, twice in a row, summed."""
    return np.tile(sentence_bytes([WORD.findall(sentence.lower())])[0], 2)


def grouped(sentences: list[str], most: int = GROUP_TOKENS, least: float = GROUP_LIKENESS, overlap: float = GROUP_OVERLAP) -> list[tuple[int, int, int]]:
    """(first sentence, sentences, tokens): a new group over the budget, or where two neighbours' cosine is under least.

    A new group starts with the last sentences of the one before, as many as hold overlap of the budget.
    """
    out, first, found = [], 0, [WORD.findall(s.lower()) for s in sentences]
    sums = sentence_bytes(found)
    # In ASCII each unit is a word.
    words, units = [0, *accumulate(len(s.split()) for s in sentences)], [0, *accumulate(len(w) if s.isascii() else len(UNIT.findall(s)) for s, w in zip(sentences, found, strict=True))]
    size = lambda a, b: max(words[b] - words[a], units[b] - units[a])
    tail = max(1, math.floor(most * overlap))
    # Half of a vector repeats the other half, so products are twice those of the sums; all are whole numbers.
    square, product = 2 * np.einsum("ij,ij->i", sums, sums), 2 * np.einsum("ij,ij->i", sums[:-1], sums[1:])
    norm = np.sqrt(square[:-1] * square[1:])
    like = (product / np.where(norm == 0, 1.0, norm)).tolist()
    for i in range(1, len(sentences)):
        if size(first, i + 1) > most or like[i - 1] < least:
            out.append((first, i - first, size(first, i)))
            start = i - 1
            while start > first and size(start, i) < tail:
                start -= 1
            first = start
    if sentences:
        out.append((first, len(sentences) - first, size(first, len(sentences))))
    return out


def folded(docs: DataFrame, pieces: str, fold: Callable[[list[str] | str], list[tuple[int, int, int]]]) -> DataFrame:
    """(doc_id, part, first, n, size): fold over each row's array of pieces, or its text; [] where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, *x) for i, p in enumerate(batch.column(1).to_pylist()) for k, x in enumerate(fold(p or []))]
            if rows:
                which, *columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "part", "first", "n", "size"])

    return docs.select("doc_id", pieces).mapInArrow(run, "doc_id bigint, part bigint, first bigint, n bigint, size bigint")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("pieces"))


@query()
def parent_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(lines(spark, sf_dir), "pieces", segments)


@query()
def packed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(lines(spark, sf_dir), "pieces", packed)


@query()
def sentence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(table(spark, sf_dir, "documents"), "text", lambda text: grouped(sentences_of(text or "")))


@query(r"SELECT doc_id, i AS row_no, trim(cells[1]) AS subject, trim(cells[2]) AS value FROM (SELECT doc_id, generate_subscripts(ls, 1) AS i, string_split(unnest(ls), '|') AS cells FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')) AS ls FROM documents)) WHERE len(cells) >= 2 AND trim(cells[1]) <> ''")
def table_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject and value of each table row in a text, as material for questions."""
    rows = F.filter(F.split("text", "\n"), lambda x: x.contains("|"))
    cells = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(rows).alias("i", "line")).select("doc_id", (F.col("i") + 1).cast("long").alias("row_no"), F.split("line", r"\|").alias("c"))
    return cells.filter((F.size("c") >= 2) & (F.trim(F.get("c", F.lit(0))) != "")).select("doc_id", "row_no", F.trim(F.get("c", F.lit(0))).alias("subject"), F.trim(F.get("c", F.lit(1))).alias("value"))
