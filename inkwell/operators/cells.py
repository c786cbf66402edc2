"""An index of vectors on disk in cells around centres, and exact top-k search by cosine that leaves cells out.

Angles obey the triangle inequality: if a query is a away from a centre and all rows of the cell are between r and R away from it, no row is nearer
to the query than the larger of a - R and r - a. The k-th best cosine that a query has found so far is a floor, and of the cells not visited yet only those whose
bound reaches it can hold more. So the result is exact; the centres, which come from a bounded sample, decide only how much work is left out.

A search deals the rows into parts and the queries into blocks by hashes of their ids. A task holds one part and one block and multiplies a tile of at most CHUNK
rows by at most BLOCK queries at a time, so what is shuffled are the rows (once for each block), the queries (once for each part) and k rows of each query and part, whatever
the number of cells that a query visits or of rows that share a cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import BLOCK, CHUNK
from ..plans.snapshots import Snapshots

#: Rows that the centres are fitted on (those of least hash), and the most cells. Both bound what reaches the driver.
SAMPLE, CELLS, ROUNDS = 20_000, 1_024, 8
#: Tiles of CHUNK rows in a part and of BLOCK queries in a block, at most. They bound what a task holds.
PART_TILES, BLOCK_TILES = 16, 16
#: Rows from which on a tile ends where its cell does.
TILE = 256
#: Rounded to six digits, equal cosines differ by less.
SLACK = 2e-6
#: The cell of rows without length; their cosine is 0.
NOWHERE = -1


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    if flat.null_count or column.null_count:
        return unit(np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1))
    return unit(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1 if len(flat) else 0))


def centres_of(rows: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from the first rows on."""
    rows = unit(rows)
    rows = rows[(rows != 0).any(axis=1)]
    centres = rows[:cells]
    for _ in range(rounds if len(rows) > cells else 0):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where((sums != 0).any(axis=1, keepdims=True), unit(sums), centres)
    return centres


def lowest(rows: DataFrame, n: int, some: int) -> DataFrame:
    """Of n rows those that the some of least hash are among: a fourth more than some, as otherwise each task would send some rows of its own to the driver."""
    return rows.filter(F.xxhash64("id") < int(2**64 * 1.25 * some / n) - 2**63) if n > 2 * some else rows


def tiles_of(cell: np.ndarray) -> list[tuple[int, int]]:
    """Where tiles of rows in order of cell begin and end: whole cells of TILE rows or more together, larger ones in steps of CHUNK."""
    edges = [0]
    for edge in [*np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)]:
        if edge - edges[-1] >= min(TILE, CHUNK) or edge == len(cell):
            edges += [*range(edges[-1] + CHUNK, edge, CHUNK), int(edge)]
    return list(zip(edges, edges[1:], strict=False))


class Found:
    """The k best rows of each of n queries so far, by score and id."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k, self.waiting = n, k, 0
        self.floor, self.last = np.full(n, -np.inf), np.full(n, -1)  # score and id of the k-th, where there is one
        self.rows = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]

    def add(self, asks: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score: of these queries, in order, and rows."""
        floor = self.floor[asks]
        none = np.isinf(floor)
        if score.shape[1] > self.k and none.any():  # those that reach the k-th of this tile
            floor[none] = np.partition(score[none], -self.k, axis=1)[:, -self.k]
        at, row = np.nonzero(score >= floor[:, None] - SLACK)
        at, ids, value = asks[at], ids[row], np.round(score[at, row], 6) + 0.0
        better = (value > self.floor[at]) | ((value == self.floor[at]) & (ids < self.last[at]))
        if better.any():
            self.rows.append((at[better], ids[better], value[better]))
            self.waiting += int(better.sum())
        if none.any() or self.waiting > self.n * self.k / 4:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, ids, value = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((ids, -value, at))
        at, ids, value = at[order], ids[order], value[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        last = place == self.k - 1
        self.floor[at[last]], self.last[at[last]] = value[last], ids[last]
        self.rows, self.waiting = [(at[place < self.k], ids[place < self.k], value[place < self.k])], 0
        return self.rows[0]


def nearest(asks: np.ndarray, rows: np.ndarray, ids: np.ndarray, cell: np.ndarray, k: int, bounds: Callable[[np.ndarray], np.ndarray], label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score) of the k best rows of each query, by cosine rounded to six digits and id; all vectors have length 1 or 0.

    label: the cells in order; bounds: of some queries the best cosine that a row of each cell can have.
    """
    order = np.lexsort((ids, cell))
    rows, ids, cell = rows[order], ids[order], cell[order]
    slot = np.searchsorted(label, cell)
    tiles = tiles_of(cell)
    near = np.concatenate([np.argmax(bounds(asks[i : i + BLOCK]), axis=1) for i in range(0, len(asks), BLOCK)])
    asking = np.argsort(near, kind="stable")  # so that queries of a tile have near cells in common
    out = []
    for i in range(0, len(asks), BLOCK):
        some = asking[i : i + BLOCK]
        q, found, bound = asks[some], Found(len(some), k), bounds(asks[some])
        reach = np.stack([bound[:, slot[a] : slot[b - 1] + 1].max(axis=1) for a, b in tiles])
        for t in np.argsort(-reach.sum(axis=1), kind="stable"):
            a, b = tiles[t]
            those = np.flatnonzero(reach[t] >= found.floor - SLACK)
            if len(those):
                found.add(those, q[those] @ rows[a:b].T, ids[a:b])
        at, best, value = found.settle()
        out.append((some[at], best, value))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class VectorIndex:
    def __init__(self, store: Snapshots) -> None:
        self.store = store

    def write(self, rows: DataFrame, cells: int | None = None) -> int:
        """rows: id (bigint, unique), v (arrays of one length). Null ids and vectors are left out. cells: by default the root of the number of rows."""
        rows = rows.filter("id IS NOT NULL AND v IS NOT NULL").select("id", F.col("v").cast("array<double>").alias("v"))
        n = rows.count()
        wanted = cells or min(CELLS, max(1, int(n**0.5)))
        sample = [r["v"] for r in lowest(rows, n, SAMPLE).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
        centres = centres_of(np.array(sample, dtype=np.float64).reshape(len(sample), -1), wanted) if sample else np.zeros((0, 1))
        centred = self.store.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        placed = self._placed(rows, centres)
        self.store.commit({"centres": centred, "rows": placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")})
        return self._counted()

    def add(self, rows: DataFrame) -> int:
        """Adds rows, in place of those with the same ids, around the centres that are there."""
        rows = rows.filter("id IS NOT NULL AND v IS NOT NULL").select("id", F.col("v").cast("array<double>").alias("v"))
        if not len(self._centres()):
            return self.write(self.store.read("rows").select("id", "v").unionByName(rows))
        kept = self.store.read("rows").join(rows.select("id"), "id", "left_anti").select("id", "v", "cell", "angle")
        self.store.commit({"rows": kept.unionByName(self._placed(rows, self._centres())).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")})
        return self._counted()

    def delete(self, ids: DataFrame) -> int:
        self.store.commit({"rows": self.store.read("rows").join(ids.select("id"), "id", "left_anti").select("id", "v", "cell", "angle")})
        return self._counted()

    def _counted(self) -> int:
        cells = self.store.read("rows").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"))
        return self.store.commit({"cells": cells}, notes={"counted": self.store.version()})

    def _centres(self) -> np.ndarray:
        found = sorted((r["cell"], r["centre"]) for r in self.store.read("centres").collect())  # at most CELLS rows
        return np.array([c for _, c in found], dtype=np.float64) if found else np.zeros((0, 1))

    @staticmethod
    def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
        """rows with their cell and the angle to its centre."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = matrix(batch.column("v"))
                if not len(v):
                    continue
                near = v @ centres.T if len(centres) else np.zeros((len(v), 1))
                cell, some = near.argmax(axis=1), (v != 0).any(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(v)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(np.where(some, cell, NOWHERE), pa.int32()), pa.array(np.where(some, angle, 0.0))], ["id", "v", "cell", "angle"])

        return rows.mapInArrow(run, "id bigint, v array<double>, cell int, angle double")

    def top(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score): for each query at least its k best rows, by cosine rounded to six digits and id.

        queries: id, v; allowed: id of the rows that may be found.
        """
        queries = queries.filter("id IS NOT NULL AND v IS NOT NULL").select(F.col("id").alias("query_id"), F.col("v").cast("array<double>").alias("q"))
        rows = self.store.read("rows").select("cell", "id", "v")
        rows = rows if allowed is None else rows.join(allowed.select("id").distinct(), "id", "left_semi")
        stats = {r["cell"]: r for r in self.store.read("cells").collect()}  # at most CELLS + 1 rows
        names = sorted(stats)
        centres = self._centres()
        middle = np.array([centres[c] if c >= 0 else np.zeros(centres.shape[1]) for c in names]).reshape(len(names), centres.shape[1])
        least, most = (np.array([stats[c][f] for c in names], dtype=np.float64) for f in ("least", "most"))
        label, nowhere = np.array(names, dtype=np.int32), np.array([c < 0 for c in names], dtype=bool)

        def bounds(q: np.ndarray) -> np.ndarray:
            """The best cosine that a row of each cell can have."""
            angle = np.arccos(np.clip(q @ middle.T, -1, 1))
            best = np.cos(np.clip(np.maximum(angle - most, least - angle), 0, np.pi))
            return np.where(nowhere[None, :] | ~(q != 0).any(axis=1, keepdims=True), 0.0, best)

        def run(q: pa.Table, r: pa.Table) -> pa.Table:
            if not len(q) or not len(r):
                return pa.table({n: pa.array([], t) for n, t in (("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64()))})
            at, ids, value = nearest(matrix(q["q"]), matrix(r["v"]), r["id"].to_numpy(), r["cell"].to_numpy(), k, bounds, label)
            return pa.table({"query_id": q["query_id"].to_numpy()[at], "id": ids, "score": value})

        n, cores = sum(r["n"] for r in stats.values()), self.store.spark.sparkContext.defaultParallelism
        blocks = max(1, math.ceil(queries.count() / (BLOCK_TILES * BLOCK)))
        parts = max(1, math.ceil(n / (PART_TILES * CHUNK)), min(math.ceil(n / CHUNK), math.ceil(cores / blocks)))
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        place = lambda i, n: F.pmod(F.xxhash64(i), F.lit(n)).cast("int")
        # Dealt by a number given here, as Spark would put several of these parts, which are small but take long, into one task.
        dealt = lambda df: df.repartition(4 * parts * blocks, "block", "part").groupBy("block", "part")
        left = queries.select("query_id", "q", place("query_id", blocks).alias("block")).select("*", upto(parts).alias("part"))
        right = rows.select("cell", "id", "v", place("id", parts).alias("part")).select("*", upto(blocks).alias("block"))
        return dealt(left).cogroup(dealt(right)).applyInArrow(run, "query_id bigint, id bigint, score double")
