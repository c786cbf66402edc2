"""MinHash near-dedup by an LSH forest.

Each tree is a signature order: DEPTH min-hashes of its own, compared from the first on. Documents that share a prefix
form a region; a region of more than CROWD documents is looked at again at the next depth of DEPTHS, so crowded
regions get longer prefixes and sparse ones short. Candidates are

* in every region at every depth, each member with the region's most central document (a star: as many pairs as rows), and
* in regions of up to CROWD members, the neighbours in the sorted order; what is still crowded at the last depth is
  dealt into salted parts of about CROWD rows, in another way for each tree.

Candidates whose sizes or whole signatures rule a link out go; the others are confirmed on the full shingle sets. The
star is confirmed first; of the neighbours, only pairs that are not yet in one component are confirmed at all. Last,
every pair that shares a region of more than CROWD documents at the first depth and is not yet in one component is
compared on the full sets, in blocks. So each pair that shares a prefix of the first depth in any tree is
decided, and only pairs that share none are missed. A crowd that the first two rounds join costs about its size; one that stays apart
costs the square of its size in set comparisons, and its size to the power of 1.5 in rows.
Documents with equal sets are one node from the start. Components come from edges by alternating stars in Spark.

Defined cases: null or empty text has an empty set, links with nothing and is kept; rows with null doc_id can be
copies of others but never stand for a component: with no other row in their component they have component_id null
and are kept; rows that repeat a doc_id
are one document, linked by any of their texts; no rows give no rows; extra
columns take no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, unused, whole, written
from .textops import gram_hashes, mix, pieces, word_hashes

TREES = 16
DEPTH = 8
DEPTHS = (3, 5, 8)
CROWD = 16
#: Probability with which a pair just at the threshold may be dropped for its signatures.
DROPPED = 1e-12
SHINGLE, PERCENT = 3, 85
CHUNK = 1 << 15


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    words, at = word_hashes(texts, lower=True)
    grams = gram_hashes(words, size)
    out = []
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        out.append(np.unique(grams[a : b - size + 1]) if b - a >= size else gram_hashes(words[a:b], int(b - a)) if b > a else grams[:0])
    return out


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """Min-hashes (32 bits) of each set, a row each; empty sets have zeros."""
    out = np.zeros((len(sets), hashes), dtype=np.uint32)
    with np.errstate(over="ignore"):
        odd = mix(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        add = mix(np.arange(1001, hashes + 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        i = 0
        while i < len(sets):
            j, total = i, 0
            while j < len(sets) and (j == i or total + len(sets[j]) <= CHUNK):
                total += len(sets[j])
                j += 1
            full = [k for k in range(i, j) if len(sets[k])]
            if full:
                flat = np.concatenate([sets[k] for k in full])
                starts = np.cumsum([0] + [len(sets[k]) for k in full[:-1]])
                for h in range(hashes):
                    out[full, h] = np.minimum.reduceat((flat * odd[h] + add[h]) >> np.uint64(32), starts)
            i = j
    return out


def least_agreement(percent: int, hashes: int) -> int:
    """The most min-hashes for which a pair at percent agrees in fewer with a probability of at most DROPPED."""
    p, below = percent / 100, 0.0
    for k in range(hashes + 1):
        below += math.comb(hashes, k) * p**k * (1 - p) ** (hashes - k)
        if below > DROPPED:
            return k
    return hashes


def sketch(docs: DataFrame, text: str, id_col: str, size: int) -> DataFrame:
    """doc_id, tk (hash of the text), n (size of the set), a and b (hash of the set), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            sets = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), size)
            sigs = signatures(sets, TREES * DEPTH).view(np.int32)
            whole = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64) for s in sets]
            flat = pa.array(sigs.reshape(-1))
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, TREES * DEPTH, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([int(w[0]) for w in whole], pa.int64()), pa.array([int(w[1]) for w in whole], pa.int64()), sig],
                ["doc_id", "tk", "n", "a", "b", "sig"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tk"))
    return slim.mapInArrow(run, "doc_id bigint, tk bigint, n bigint, a bigint, b bigint, sig array<int>")


def prefix(depth: int) -> Column:
    return F.xxhash64("k", *[F.get("rest", F.lit(i)) for i in range(depth - DEPTHS[0])]) if depth > DEPTHS[0] else F.col("k")


def alike_in_size(x: Column, y: Column, percent: int) -> Column:
    return F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)


def pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("x"), F.greatest(x, y).alias("y")]


def candidates(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(star pairs, neighbour pairs, nodes in any region, rows of crowded regions at the first depth) as (x, y), x < y, (node) and (key, node, rows); nodes: node, n, sig."""
    tree = lambda t: F.struct(F.xxhash64(t, *[F.get("sig", t * DEPTH + i) for i in range(DEPTHS[0])]).alias("k"), F.slice("sig", t * DEPTH + DEPTHS[0] + 1, DEPTH - DEPTHS[0]).alias("rest"))
    rows = nodes.select("node", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), tree)).alias("r")).select("node", "n", "r.k", "r.rest")
    levels = []
    for depth in DEPTHS:
        keyed = rows.withColumn("key", prefix(depth))
        # One row a region, from partial sums; regions of one member end here.
        regions = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
        levels.append(written(keyed.join(regions, "key")))
        rows = levels[-1].filter(F.col("rows") > CROWD).select("node", "n", "k", "rest")
    members = levels[0].select("node").distinct()
    # A document is central if its regions are large over all trees and depths: of copies that each differ from one text
    # in places of their own, that text. The star around it links copies that are not linked to each other.
    placed = reduce(DataFrame.unionByName, (m.select("key", "node", "n", "rows", "rest", F.lit(d).alias("depth")) for m, d in zip(levels, DEPTHS, strict=True)))
    central = placed.groupBy("node").agg(F.sum("rows").alias("weight"))
    weighed = placed.select("depth", "key", "node", "n").join(central, "node")
    hubs = weighed.groupBy("depth", "key").agg(F.max(F.struct(F.col("weight"), (-F.col("node")).alias("least"), "n")).alias("hub")).select("depth", "key", (-F.col("hub.least")).alias("hub"), F.col("hub.n").alias("hub_n"))
    star = placed.select("depth", "key", "node", "n").join(hubs, ["depth", "key"])
    star = star.filter((F.col("node") != F.col("hub")) & alike_in_size(F.col("n"), F.col("hub_n"), percent)).select(*pair(F.col("node"), F.col("hub"))).distinct()
    salt = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("rows") / CROWD))
    parts = placed.filter((F.col("rows") <= CROWD) | (F.col("depth") == DEPTHS[-1])).select(F.when(F.col("rows") <= CROWD, F.col("key")).otherwise(F.xxhash64("key", salt)).alias("key"), "rest", "node", "n")
    order = Window.partitionBy("key").orderBy("rest", "node").rowsBetween(1 - CROWD, -1)
    near = parts.withColumn("before", F.collect_list(F.struct("node", "n")).over(order))
    near = near.select("node", "n", F.explode("before").alias("o")).filter((F.col("node") != F.col("o.node")) & alike_in_size(F.col("n"), F.col("o.n"), percent))
    return star, near.select(*pair(F.col("node"), F.col("o.node"))).distinct(), members, levels[0].filter(F.col("rows") > CROWD).select("key", "node", "rows")


def confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets are linked; nodes: node, sig; texts: node, text."""
    agree = F.size(F.filter(F.zip_with("sx", "sy", lambda p, q: p == q), lambda e: e))
    sigs = nodes.select("node", "sig")
    likely = (
        pairs.join(sigs.toDF("x", "sx"), "x").join(sigs.toDF("y", "sy"), "y").filter(agree >= least_agreement(percent, TREES * DEPTH)).select("x", "y")
    )
    both = likely.join(texts.toDF("x", "tx"), "x").join(texts.toDF("y", "ty"), "y").select("x", "y", "tx", "ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2, 3):
            left, right = (shingle_sets(batch.column(c).cast(pa.binary()).to_pylist(), size) for c in (2, 3))
            shared = [len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(left, right, strict=True)]
            linked = [100 * s >= percent * (len(p) + len(q) - s) for p, q, s in zip(left, right, shared, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(run, "x bigint, y bigint")


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """For rows left and right of sets: a matrix of which pairs are linked, from exact counts of shared shingles."""
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    row = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle of one set alone is shared by no pair; the others are numbered anew and counted a slice at a time.
    row, column = row[often[column] > 1], column[often[column] > 1]
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(left), len(right)))
    width = max(64, (1 << 22) // len(sets))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (at, at + width))
        has = np.zeros((len(sets), width), dtype=np.float32)
        has[row[a:b], column[a:b] - at] = 1
        shared += has[left] @ has[right].T
    return 100 * shared >= percent * (sizes[left][:, None] + sizes[right][None, :] - shared)


def crowd_edges(crowded: DataFrame, roots: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(x, y): roots to join, from all linked pairs of crowded regions that are apart; crowded: key, node, rows; roots: node, root; texts: node, text."""
    # The regions of one crowd differ from tree to tree; under the name of their most central document they are one
    # group, so that a pair is compared about once. Pairs of one region are always in one group.
    weight = crowded.groupBy("node").agg(F.sum("rows").alias("weight"))
    hubs = crowded.select("key", "node").join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    groups = crowded.select("key", "node").join(hubs, "key").select("hub", "node").distinct().join(roots, "node", "left").select("hub", "node", F.coalesce("root", "node").alias("root"))
    groups = written(groups)
    apart = groups.groupBy("hub").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("hub", F.ceil(F.sqrt("rows") / 4).cast("int").alias("blocks"))
    groups = groups.join(apart, "hub").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            sets = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set"])

    sets = written(texts.join(groups.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(cut, "node bigint, set binary"))
    each = groups.select("hub", "node", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    each = each.select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root").join(sets, "node")

    def run(group: pa.Table) -> pa.Table:
        block, root = group["block"].to_numpy(), group["root"].to_numpy()
        whole = [np.frombuffer(s, dtype=np.uint64) for s in group["set"].to_pylist()]
        left, right = np.flatnonzero(block == group["i"][0].as_py()), np.flatnonzero(block == group["j"][0].as_py())
        found = {}

        def top(r: int) -> int:
            while found.get(r, r) != r:
                r = found[r]
            return r

        edges = []
        if len(left) and len(right):
            x, y = np.nonzero(links(whole, left, right, percent) & (root[left][:, None] != root[right][None, :]))
            for a, b in np.unique(np.sort(np.stack([root[left[x]], root[right[y]]], axis=1), axis=1), axis=0).tolist():
                a, b = top(a), top(b)
                if a != b:  # a forest of the joined roots says as much as all their pairs
                    found[max(a, b)] = min(a, b)
                    edges.append((min(a, b), max(a, b)))
        return pa.table({"x": pa.array([e[0] for e in edges], pa.int64()), "y": pa.array([e[1] for e in edges], pa.int64())})

    return each.groupBy("hub", "i", "j").applyInArrow(run, "x bigint, y bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for all nodes of edges (x, y); by alternating large and small stars."""
    edges = written(edges.filter("x != y").select(*pair(F.col("x"), F.col("y"))).distinct())
    state = None
    while True:
        # Large star: every larger neighbour of a node moves to the least one around it.
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("m").alias("x"), "y").filter("x != y").distinct()
        # Small star: every smaller neighbour, and the node itself, move to the least one.
        least = large.groupBy("y").agg(F.min("x").alias("m"))
        joined = large.join(least, "y")
        small = joined.select(F.col("m").alias("x"), F.col("x").alias("y")).unionByName(least.select(F.col("m").alias("x"), "y"))
        edges = written(small.filter("x != y").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("y").alias("node"), F.col("x").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, tk, n_shingles, component_id, kept) of each row."""
    rows = written(sketch(docs, text, id_col, size))
    full = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # Equal sets are one node; partial minima, so a large group of copies is one row a task.
    classes = written(full.groupBy("a", "b").agg(F.min_by(F.struct("tk", "n", "sig"), "doc_id").alias("r"), F.min("doc_id").alias("node")).select("a", "b", "node", "r.*"))
    star, near, members, crowded = candidates(classes.select("node", "n", "sig"), percent)
    wanted = classes.join(members, "node").select("node", "tk")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.xxhash64(text).alias("tk"), F.col(text).alias("text"))
    texts = written(texts.join(wanted, ["node", "tk"], "left_semi").select("node", "text"))
    first = written(confirmed(star, classes, texts, size, percent))
    so_far = components(first)
    root = lambda c: so_far.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    apart = near.join(root("x"), "x", "left").join(root("y"), "y", "left").filter(F.coalesce("rx", "x") != F.coalesce("ry", "y")).select("x", "y")
    second = written(confirmed(written(apart), classes, texts, size, percent))
    roots = so_far.select(F.col("root").alias("x"), F.col("node").alias("y"))
    final = roots if second.isEmpty() else components(roots.unionByName(second)).select(F.col("root").alias("x"), F.col("node").alias("y"))
    third = written(crowd_edges(crowded, final.select(F.col("y").alias("node"), F.col("x").alias("root")), texts, size, percent))
    final = final if third.isEmpty() else components(final.unionByName(third)).select(F.col("root").alias("x"), F.col("node").alias("y"))
    named = classes.select("a", "b", "node").join(final.select(F.col("y").alias("node"), F.col("x").alias("root")), "node", "left").select("a", "b", F.coalesce("root", "node").alias("component"))
    judged = rows.select("doc_id", "tk", F.col("n").alias("n_shingles"), "a", "b").join(named, ["a", "b"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return judged.select("doc_id", "tk", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, size=SHINGLE, percent=PERCENT).drop("tk")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the document with the smallest doc_id, by five-word shingles at 0.8, with its own columns.

    Rows that repeat a doc_id are one document, of which one row stays: the one whose columns have the least hash (of their
    JSON form, so columns may be maps or nested), so reruns agree. Extra columns of any name and type are kept.
    Rows without a doc_id go only if a document with one is in their group.
    """
    judged = near_duplicates(docs.select("doc_id", "text"))
    own_id, own_tk, tk = unused(docs, "_id", "_gone", "_tk")
    gone = judged.filter(~F.col("kept")).select(F.col("doc_id").alias(own_id), F.col("tk").alias(own_tk)).distinct()
    row = docs.withColumn(tk, F.xxhash64("text"))
    left = row.join(gone, row["doc_id"].eqNullSafe(gone[own_id]) & (row[tk] == gone[own_tk]), "left_anti").drop(tk)
    again = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    if again.isEmpty():
        return left
    row = whole(docs)
    one = left.join(again, "doc_id", "left_semi").groupBy(F.col("doc_id").alias(own_id)).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*")
    return left.join(again, "doc_id", "left_anti").unionByName(one)
