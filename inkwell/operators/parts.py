"""Exact top-k by sums over shared keys, one part of the documents and one block of the queries at a time.

Documents are dealt into parts and queries into blocks by hashes of their ids. A task takes the postings of one part, adds them up for one query
after another and keeps k documents of each, so no row is made for a query and a posting that meet: what is shuffled are the
postings (once for each block), the queries (once for each part) and k rows of each query and part. With vectors, a document's cosine takes part in its score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import matrix

#: Postings and documents of a part, and rows of a block of queries, on average. They bound what a task holds.
PART_ROWS, PART_DOCS, BLOCK_ROWS = 2_000_000, 16_384, 500_000
#: Keys that more than one in so many documents of a part has are kept as whole columns, up to DENSE of them.
COMMON, DENSE = 12, 512
#: Queries whose cosines are worked out together.
TOGETHER = 128


def numbers(n_postings: int, n_docs: int, n_asked: int) -> tuple[int, int]:
    """How many parts of the documents and blocks of the queries."""
    return max(1, math.ceil(n_postings / PART_ROWS), math.ceil(n_docs / PART_DOCS)), max(1, math.ceil(n_asked / BLOCK_ROWS))


def key(*of: Column) -> Column:
    """A posting's key; equal for different terms with a probability of 3e-10 among 100,000 terms."""
    return F.xxhash64(*of)


class Part:
    """The postings of some documents. A document's place goes by tie and id, so of equal scores the first places count."""

    def __init__(self, rows: pa.Table) -> None:
        found = rows["key"].combine_chunks()
        whole = found.is_null().to_numpy(zero_copy_only=False)
        ids, w = rows["doc_id"].to_numpy(), rows["w"].to_numpy()
        order = np.lexsort((ids[whole], w[whole]))
        self.ids, self.tie = ids[whole][order], w[whole][order]
        self.v = matrix(rows["v"].filter(pa.array(whole)).take(pa.array(order))) if "v" in rows.column_names else None
        self.n = len(self.ids)
        sort = np.argsort(self.ids, kind="stable")
        doc = ids[~whole]
        near = np.minimum(np.searchsorted(self.ids, doc, sorter=sort), max(self.n - 1, 0))
        at = sort[near] if self.n else np.zeros(len(doc), dtype=np.int64)
        there = self.ids[at] == doc if self.n else np.zeros(len(doc), dtype=bool)
        keys = found.fill_null(0).to_numpy(zero_copy_only=False)[~whole][there]
        by = np.argsort(keys, kind="stable")
        self.at, self.w, keys = at[there][by].astype(np.int32), w[~whole][there][by], keys[by]
        self.keys, self.first = np.unique(keys, return_index=True)
        self.last = np.append(self.first[1:], len(keys))
        self.common: dict[int, np.ndarray] = {}

    def sums(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of each document the weights of the keys that it has, times its own."""
        out, places, values = np.zeros(self.n), [], []
        slot = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        for j, k, x in zip(slot.tolist(), keys.tolist(), weights.tolist(), strict=True):
            if not len(self.keys) or self.keys[j] != k:
                continue
            a, b = self.first[j], self.last[j]
            if (b - a) * COMMON > self.n and (j in self.common or len(self.common) < DENSE):
                if j not in self.common:
                    self.common[j] = np.bincount(self.at[a:b], self.w[a:b], minlength=self.n)
                out += self.common[j] if x == 1 else x * self.common[j]
            else:
                places.append(self.at[a:b])
                values.append(self.w[a:b] if x == 1 else x * self.w[a:b])
        return out + np.bincount(np.concatenate(places), np.concatenate(values), minlength=self.n) if places else out

    def best(self, score: np.ndarray, met: np.ndarray, k: int) -> np.ndarray:
        """The places of the k best of those met, by score rounded to six digits and place."""
        some = np.nonzero(met)[0]
        if len(some) <= k:
            return some
        value = np.floor(score[some] * 1e6 + 0.5)
        least = np.partition(value, -k)[-k]
        over = some[value > least]
        return np.concatenate([over, some[value == least][: k - len(over)]])


class Asked:
    """Some queries (item_id, field, key, w, and q with vectors), in order of item, field and key."""

    def __init__(self, q: pa.Table) -> None:
        coded = q["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")  # a query may have no id
        item, field = coded.indices.to_numpy(), q["field"].to_numpy()
        bare = q["key"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        keys, weights = q["key"].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False), q["w"].to_numpy()
        order = np.lexsort((keys, field, ~bare, item))
        self.items = coded.dictionary
        self.item, self.field, self.keys, self.weights, self.bare = (x[order] for x in (item, field, keys, weights, bare))
        self.starts = np.flatnonzero(np.r_[True, self.item[1:] != self.item[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
        self.vectors = q["q"].take(pa.array(order[self.starts])) if "q" in q.column_names else None

    def best(self, part: Part | None, k: int, blend: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> pa.Table:
        """(item_id, doc_id, score, tie) of the k best documents of the part for each query."""
        names = ["item_id", "doc_id", "score", "tie"]
        if not len(self.item) or part is None or not part.n:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (self.items.type, pa.int64(), pa.float64(), pa.float64()), strict=True)})
        item, field, bare = self.item, self.field, self.bare
        where, docs_at, scores = [], [], []
        asks = matrix(self.vectors) if blend else None
        for i, (a, b) in enumerate(zip(self.starts.tolist(), [*self.starts[1:].tolist(), len(item)], strict=True)):
            if blend and i % TOGETHER == 0:
                cosines = asks[i : i + TOGETHER] @ part.v.T
            cut = [a + int(bare[a:b].sum()), *(a + 1 + np.flatnonzero((field[a + 1 : b] != field[a : b - 1]) & ~bare[a : b - 1])).tolist(), b]
            score = np.zeros(part.n)
            for s, e in zip(cut, cut[1:], strict=False):
                if e > s:
                    score = np.maximum(score, part.sums(self.keys[s:e], self.weights[s:e]))
            met = score > 0
            if blend:
                score, met = blend(score, cosines[i % TOGETHER]), np.ones(part.n, dtype=bool)
            found = part.best(score, met, k)
            where.append(np.full(len(found), item[a]))
            docs_at.append(found)
            scores.append(score[found])
        at = np.concatenate(docs_at)
        return pa.table([self.items.take(pa.array(np.concatenate(where))), part.ids[at], np.concatenate(scores), part.tie[at]], names=names)


class Running:
    """The k best documents of each query of one field, over one part after another: by score rounded to six digits, tie and id."""

    def __init__(self, asked: Asked, k: int) -> None:
        self.asked, self.k = asked, k
        self.ranges = list(zip(asked.starts.tolist(), [*asked.starts[1:].tolist(), len(asked.item)], strict=len(asked.starts) > 0))
        none = np.zeros(0)
        self.found = [(none, none, none, none.astype(np.int64))] * len(self.ranges)  # score, its rounded value, tie, id

    def add(self, part: Part) -> None:
        for i, (a, b) in enumerate(self.ranges):
            score = part.sums(self.asked.keys[a:b], self.asked.weights[a:b])
            held = self.found[i]
            full = len(held[3]) >= self.k
            some = part.best(score, score >= held[1][-1] / 1e6 - 1e-6 if full else score > 0, self.k)
            new = score[some], np.floor(score[some] * 1e6 + 0.5), part.tie[some], part.ids[some]
            if full:
                _, value, tie, ids = (x[-1] for x in held)
                better = (new[1] > value) | (new[1] == value) & ((new[2] < tie) | (new[2] == tie) & (new[3] < ids))
                new = tuple(x[better] for x in new)
            if len(new[3]):
                both = [np.concatenate(x) for x in zip(held, new, strict=True)]
                order = np.lexsort((both[3], both[2], -both[1]))[: self.k]
                self.found[i] = tuple(x[order] for x in both)

    def table(self) -> pa.Table:
        """(item_id, doc_id, score, tie)."""
        score, _, tie, ids = (np.concatenate([f[j] for f in self.found] or [np.zeros(0)]) for j in range(4))
        items = self.asked.items.take(pa.array(np.repeat(self.asked.item[self.asked.starts], [len(f[3]) for f in self.found])))
        return pa.table([items, ids.astype(np.int64), score, tie], names=["item_id", "doc_id", "score", "tie"])


def top(postings: DataFrame, docs: DataFrame, asked: DataFrame, k: int, sizes: tuple[int, int], blend: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(item_id, doc_id, score, tie): the best documents of each query by score (rounded to six digits), tie and doc_id; k rows of each part.

    postings: doc_id, key, w; docs: doc_id, tie of the documents that may be found; asked: item_id, field, key, w. A score is the sum of
    the products of weights for one field, the best field counts. With blend, docs have a vector v and each query has one row without key and with its vector q; the
    score is blend(sum, cosine), and every document is found.
    """
    parts, blocks = sizes
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    kind = asked.schema["item_id"].dataType
    rows = postings.select("doc_id", "key", F.col("w").cast("double").alias("w"))
    whole = docs.select("doc_id", F.lit(None).cast("bigint").alias("key"), F.col("tie").cast("double").alias("w"), *([F.col("v").cast("array<double>").alias("v")] if blend else []))
    rows = (rows.withColumn("v", F.lit(None).cast("array<double>")) if blend else rows).unionByName(whole)
    right = rows.withColumn("part", place("doc_id", parts)).withColumn("block", upto(blocks))
    left = asked.withColumn("block", place("item_id", blocks)).withColumn("part", upto(parts))

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        return Asked(q).best(Part(r) if len(r) else None, k, blend)

    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(run, f"item_id {kind.simpleString()}, doc_id bigint, score double, tie double")


def top_in_place(rows: DataFrame, postings: Callable[[pa.RecordBatch], pa.Table], asked: pa.Table, kind: str, k: int) -> DataFrame:
    """The same for few queries on rows that hold a document with all its postings: each task adds up its own rows, so only k rows of each query and part are left.

    postings makes of some rows what Part takes; asked: item_id (of the SQL type kind), field, key, w. No document has two rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, held, n_docs, n_rows = Asked(asked), [], 0, 0
        for batch in batches:
            for i in range(0, batch.num_rows, PART_DOCS):
                some = batch.slice(i, PART_DOCS)
                made = postings(some)
                if held and (n_docs + some.num_rows > PART_DOCS or n_rows + len(made) > PART_ROWS):
                    yield from queries.best(Part(pa.concat_tables(held)), k).to_batches()
                    held, n_docs, n_rows = [], 0, 0
                held, n_docs, n_rows = [*held, made], n_docs + some.num_rows, n_rows + len(made)
        if held:
            yield from queries.best(Part(pa.concat_tables(held)), k).to_batches()

    return rows.mapInArrow(run, f"item_id {kind}, doc_id bigint, score double, tie double")
