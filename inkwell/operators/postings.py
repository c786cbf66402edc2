"""An inverted index on disk, and exact top-k search on it.

A posting is (term, field, class, document, tf, length); documents of like length share a class. Beside the postings stands one row
for each (term, field, class) with the number of postings, their greatest tf and their smallest length. Postings are stored by a hash of the term and sorted by term, so a search reads the folders of its terms only.

A search that meets many postings goes in parts of the documents (parts.py): the postings of its terms are read once and each task adds up
those of one part, query by query. A document that shares no term with a query is never kept.

A single search for few terms needs no index: TextScan counts these terms in one pass over the texts and searches what it found. Where all queries together fit a task and a
posting's weight needs no counts, scan_top searches in the same pass and keeps no posting at all.

Texts are cut to tokens once, when they are written. Adding documents writes a segment; replaced or deleted ones are left out by the list of live
documents and taken off the counts, until compact() rewrites the postings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..plans.session import BROADCAST_ROWS, kept, small
from ..plans.snapshots import Snapshots
from . import parts

K1, B = 1.2, 0.75
BUCKETS = 16
#: Classes of length for each doubling.
STEPS = 4
#: Up to so many postings of all queries' terms together every one of them meets its queries in a join.
WHOLE_ROWS = 50_000_000
#: Not used since searches go in parts; still here, as it can be set from outside.
SEED_ROWS = 50


POSTINGS = "term string, field string, class int, doc_id bigint, segment int, tf int, len int, bucket int"


def counted(tokens: Column) -> Column:
    """Each distinct token with its number, by sorting (a text of n tokens costs n log n)."""

    def of(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda p, j: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - p).alias("tf"))))

    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), of)).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


class TextIndex:
    """docs given to it: doc_id (bigint), tie (bigint, smaller is better), fields (a struct of token arrays, by field)."""

    def __init__(self, store: Snapshots, buckets: int = BUCKETS) -> None:
        self.store, self.buckets = store, buckets

    def _analysed(self, docs: DataFrame, path: str) -> DataFrame:
        """doc_id, tie, sizes, class, terms of each field; written, as postings and the list of documents both come from it. No token array is stored."""
        names = docs.schema["fields"].dataType.names
        # Through explode, so that Spark does not work the fields out anew wherever they are named.
        once = docs.filter("doc_id IS NOT NULL").select("doc_id", "tie", F.explode(F.array("fields")).alias("fields"))
        each = F.array(*[F.struct(F.lit(n).alias("field"), F.size(F.col("fields")[n]).alias("len"), counted(F.col("fields")[n]).alias("terms")) for n in names])
        rows = once.select("doc_id", "tie", F.explode(F.array(each)).alias("f"))
        length = F.aggregate("f", F.lit(0), lambda a, x: a + x["len"])
        sizes = F.map_from_arrays(F.transform("f", lambda x: x["field"]), F.transform("f", lambda x: x["len"]))
        rows.select("doc_id", "tie", "f", sizes.alias("sizes"), F.floor(F.log2(length + 1.0) * STEPS).cast("int").alias("class")).write.parquet(path)
        return self.store.spark.read.parquet(path)

    def add(self, docs: DataFrame) -> int:
        """Adds documents, in place of those with the same ids. Of rows that repeat an id one must be chosen before."""
        since, old = self.store.version(), self.store.names()
        draft = f"{self.store.root}/draft-{uuid.uuid4().hex}"
        rows = self._analysed(docs, draft)
        each = rows.select("doc_id", "class", F.explode("f").alias("f")).select("doc_id", "class", "f.field", "f.len", F.explode("f.terms").alias("t"))
        new = rows.select("doc_id", F.lit(since + 1).alias("segment"), "tie", "sizes")
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        postings = each.select("t.term", "field", "class", "doc_id", F.lit(since + 1).alias("segment"), "t.tf", "len").withColumn("bucket", bucket)
        postings = postings.repartitionByRange("bucket", "term", "field", "class").sortWithinPartitions("term", "field", "class", "doc_id")
        path = f"{self.store.root}/segment-{since + 1}"
        postings.write.mode("overwrite").partitionBy("bucket").parquet(path)
        postings = self._segment(path)
        ids, notes = new.select("doc_id"), self.store.manifest(since)["notes"]
        segments = [*notes.get("segments", []), path]
        if not old:
            version = self.store.commit({"docs": new}, {"blocks": self._blocks(postings), "totals": self._totals(new, 1)}, since, {"segments": segments, "dead": False})
            self.store.drop(draft)
            return version
        gone = self.store.read("docs").join(ids, "doc_id", "left_semi")
        live = self.store.read("docs").join(ids, "doc_id", "left_anti").unionByName(new)
        blocks, totals, dead = self._blocks(postings).unionByName(self._taken_off(gone)), self._totals(new, 1).unionByName(self._totals(gone, -1)), not gone.isEmpty()
        version = self.store.commit({"docs": live}, {"blocks": blocks, "totals": totals}, since, {"segments": segments, "dead": dead or notes["dead"]})
        self.store.drop(draft)
        return version

    def delete(self, ids: DataFrame) -> int:
        since = self.store.version()
        gone = self.store.read("docs").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        live = self.store.read("docs").join(ids, "doc_id", "left_anti")
        return self.store.commit({"docs": live}, {"blocks": self._taken_off(gone), "totals": self._totals(gone, -1)}, since, {"dead": True})

    def compact(self) -> int:
        """Rewrites the postings of live documents as one segment."""
        since = self.store.version()
        live = self.postings().join(self.store.read("docs").select("doc_id", "segment"), ["doc_id", "segment"], "left_semi")
        path = f"{self.store.root}/segment-{since + 1}-compact"
        live.repartitionByRange("bucket", "term", "field", "class").sortWithinPartitions("term", "field", "class", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(path)
        blocks = self._blocks(self._segment(path))
        return self.store.commit({"blocks": blocks}, None, since, {"segments": [path], "dead": False})

    @staticmethod
    def _blocks(postings: DataFrame) -> DataFrame:
        return postings.groupBy("term", "field", "class").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("most_tf"), F.min("len").alias("least_len"))

    def _taken_off(self, gone: DataFrame) -> DataFrame:
        """Negative counts for the postings of documents that are no longer live; the bounds stay valid."""
        rows = self.postings().join(gone.select("doc_id", "segment"), ["doc_id", "segment"], "left_semi")
        return rows.groupBy("term", "field", "class").agg((-F.count(F.lit(1))).alias("n"), F.lit(None).cast("int").alias("most_tf"), F.lit(None).cast("int").alias("least_len"))

    @staticmethod
    def _totals(docs: DataFrame, sign: int) -> DataFrame:
        return docs.select(F.explode("sizes").alias("field", "size")).groupBy("field").agg((sign * F.count(F.lit(1))).alias("n"), (sign * F.sum("size")).alias("size"))

    def postings(self) -> DataFrame:
        paths = self.store.manifest()["notes"]["segments"]
        return reduce(lambda a, b: a.unionByName(b), [self._segment(p) for p in paths])

    def live(self, fields: Iterable[str], buckets: Iterable[int] | None = None) -> DataFrame:
        """(term, field, class, doc_id, tf, len) of the postings of these fields and buckets (all if None) of documents that are there."""
        rows = self.postings().filter(F.col("field").isin(list(fields)))
        rows = rows if buckets is None else rows.filter(F.col("bucket").isin(list(buckets)))
        rows = rows.join(self.store.read("docs").select("doc_id", "segment"), ["doc_id", "segment"], "left_semi") if self.store.manifest()["notes"]["dead"] else rows
        return rows.drop("bucket", "segment")

    def _segment(self, path: str) -> DataFrame:
        return self.store.spark.read.schema(POSTINGS).parquet(path)

    def top(self, asked: DataFrame, weights: Mapping[str, float], k: int, bm25: bool = True, best_field: bool = True, allowed: DataFrame | None = None, ties: bool = True) -> DataFrame:
        """(item_id, doc_id, score, rank) of the k best documents of each query: by score (rounded to six digits), tie (if ties) and doc_id.

        asked: item_id, term (distinct). A posting weighs its field's weight times, if bm25, its BM25 weight. A document's score is the sum of its
        weights, of its best field only if best_field. allowed: doc_id of the documents that may be found (counts are those of all).
        """
        asked = small(asked.select("item_id", "term"))
        totals = {r["field"]: (r["n"], r["size"]) for r in self.store.read("totals").groupBy("field").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()}
        table = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("field"))
        wanted = [f for f in weights if f in totals]
        buckets = [r[0] for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")).distinct().collect()]  # at most BUCKETS numbers
        postings = self.live(wanted, buckets)
        boost = table({f: float(weights[f]) for f in wanted}) if wanted else F.lit(0.0)
        group = ["item_id", "field"] if best_field else ["item_id"]

        def weight(tf: Column, size: Column) -> Column:
            if not bm25:
                return boost
            mean = table({f: max(totals[f][1] / totals[f][0], 1e-9) if totals[f][0] else 1.0 for f in wanted})
            return boost * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))

        n = table({f: totals[f][0] for f in wanted}) if wanted else F.lit(0)
        blocks = self.store.read("blocks").filter(F.col("field").isin(wanted)).join(asked.select("term").distinct(), "term", "left_semi")
        blocks = blocks.groupBy("term", "field", "class").agg(F.sum("n").alias("n"), F.max("most_tf").alias("most_tf"), F.min("least_len").alias("least_len")).filter("n > 0")
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        readable = (lambda rows: rows) if allowed is None else (lambda rows: rows.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi"))

        def ranked(found: DataFrame) -> DataFrame:
            """The best of (*group, doc_id, score)."""
            placed = found.groupBy("item_id", "doc_id").agg(F.round(F.max("score"), 6).alias("score")).join(self.store.read("docs").select("doc_id", "tie"), "doc_id")
            rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), *(["tie"] if ties else []), "doc_id"))
            return placed.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "doc_id", "score", "rank")

        held = blocks.groupBy("term", "field").agg(F.sum("n").alias("df")).join(asked, "term").select("item_id", "field", "term", "df", idf.alias("idf"))
        met, n_asked = held.agg(F.coalesce(F.sum("df"), F.lit(0)), F.count(F.lit(1))).first()
        if met <= WHOLE_ROWS:
            rows = postings.join(held, ["term", "field"])
            return ranked(readable(rows.groupBy(*group, "doc_id").agg(F.sum(weight(F.col("tf"), F.col("len"))).alias("score"))))
        # Beyond, in parts: the postings of each term are read once, whatever the number of queries that name it.
        terms = held.select("term", "field", "idf").distinct()
        number = parts.key("field", "term").alias("key")
        rows = postings.join(small(terms), ["term", "field"]).select("doc_id", number, weight(F.col("tf"), F.col("len")).alias("w"))
        field = table({f: i for i, f in enumerate(wanted)}) if best_field else F.lit(0)
        sizes = parts.numbers(blocks.agg(F.sum("n")).first()[0] or 0, max(t[0] for t in totals.values()), n_asked)
        docs = readable(self.store.read("docs").select("doc_id", F.col("tie") if ties else F.lit(0).alias("tie")))
        found = parts.top(rows, docs, held.select("item_id", field.alias("field"), number, F.lit(1.0).alias("w")), k, sizes)
        order = Window.partitionBy("item_id").orderBy(F.desc("score"), "tie", "doc_id")
        found = found.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order))
        return found.filter(F.col("rank") <= k).select("item_id", "doc_id", "score", "rank")


_WORD = np.zeros(256, dtype=bool)
_WORD[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
#: Texts that a task cuts to words at a time.
TEXTS = 1_000


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens (functions.text.runs) of all texts in order, and how many each text has; no text is null."""
    texts = texts.cast(pa.large_string())
    _, where, data = texts.buffers()
    at = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at, inside = at - at[0], _WORD[raw]
    # U+4E00 to U+9FFF are the bytes E4 B8 80 to E9 BF BF.
    lead = np.flatnonzero((raw >= 0xE4) & (raw <= 0xE9))
    lead = lead[(raw[lead] > 0xE4) | (raw[lead + 1] >= 0xB8)]
    for i in range(3):
        inside[lead + i] = True
    first = at[:-1][at[:-1] < len(raw)]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    start[first] = inside[first]
    end[:-1] &= ~inside[1:]
    end[first[first > 0] - 1] = inside[first[first > 0] - 1]
    starts = np.flatnonzero(start)
    ends = np.r_[0, np.cumsum(np.flatnonzero(end) - starts + 1)]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(raw[inside])), np.diff(np.searchsorted(starts, at))


def _counts(fields: Sequence[str], shared: Mapping[str, Sequence[str]], terms: pa.Array) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each document the number of tokens of each field and how often it holds each of the terms; see TextScan."""
    n_terms = max(1, len(terms))

    def counted_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, found, lens = batch.num_rows, {}, []
        for field in fields:
            if field in shared:
                pairs = np.intersect1d(*(found[f][0] for f in shared[field]), assume_unique=True)
                found[field] = pairs, np.ones(len(pairs), dtype=np.int64)
                lens.append(np.zeros(n, dtype=np.int64))
                continue
            words, size = cut(batch.column(field))
            no = pc.index_in(words, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
            held = no >= 0
            found[field] = np.unique(np.repeat(np.arange(n), size)[held] * n_terms + no[held], return_counts=True)
            lens.append(size)
        doc = np.concatenate([found[f][0] // n_terms for f in fields])
        key = np.concatenate([found[f][0] % n_terms + i * n_terms for i, f in enumerate(fields)])
        order = np.argsort(doc, kind="stable")
        tf = np.concatenate([found[f][1] for f in fields])[order]
        ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=n))]
        counts = pa.StructArray.from_arrays([pa.array(key[order], pa.int32()), pa.array(tf, pa.int32())], ["key", "tf"])
        size = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(fields), pa.int32()), pa.array(np.stack(lens, 1).ravel(), pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), size, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), counts)], ["doc_id", "tie", "len", "terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                yield counted_terms(batch.slice(i, TEXTS))

    return run


def _weighed(keys: pa.Table, n_fields: int, n_terms: int, bm25: bool) -> Callable[[pa.RecordBatch], pa.Table]:
    """Of rows of TextScan the documents and their weighed postings, as parts.Part takes them; keys: key, boost, mean of those that count."""
    boosts, means = np.zeros(n_fields * n_terms), np.ones(n_fields * n_terms)
    boosts[keys["key"].to_numpy()], means[keys["key"].to_numpy()] = keys["boost"].to_numpy(), keys["mean"].to_numpy()
    counts = np.zeros(len(boosts), dtype=bool)
    counts[keys["key"].to_numpy()] = True

    def weighed(batch: pa.RecordBatch) -> pa.Table:
        ids, terms = batch.column("doc_id").to_numpy(), batch.column("terms")
        flat = terms.flatten()
        key, tf = pc.struct_field(flat, "key").to_numpy(), pc.struct_field(flat, "tf").to_numpy()
        row = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy())
        some = counts[key]
        key, tf, row = key[some], tf[some], row[some]
        w = boosts[key]
        if bm25:
            size = batch.column("len").flatten().to_numpy().reshape(-1, n_fields)[row, key // n_terms]
            w = w * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / means[key]))
        whole = pa.table([batch.column("doc_id"), pa.nulls(len(ids), pa.int64()), batch.column("tie").cast(pa.float64())], names=["doc_id", "key", "w"])
        return pa.concat_tables([whole, pa.table([ids[row], key.astype(np.int64), w], names=["doc_id", "key", "w"])])

    return weighed


class TextScan:
    """Searches for given terms without an index: one pass over the documents counts them, and any number of searches read the counts.

    docs: doc_id, tie, fields (a struct of texts, null as empty); terms: term, as many as a task can hold; fields: those to be searched. A field of
    shared holds the terms that two fields before it in fields have in common; it has no length, so it is for scores without BM25.
    """

    def __init__(self, docs: DataFrame, terms: DataFrame, fields: Sequence[str], shared: Mapping[str, Sequence[str]] | None = None) -> None:
        self.fields, shared, spark = list(fields), shared or {}, docs.sparkSession
        words = pa.array(sorted(r[0] for r in terms.select("term").filter("term IS NOT NULL").distinct().collect()), pa.large_string())
        self.n_terms = max(1, len(words))
        self.terms = F.broadcast(spark.createDataFrame(list(enumerate(words.to_pylist())), "no int, term string"))
        read = docs.filter("doc_id IS NOT NULL").select("doc_id", "tie", *[F.lower(F.coalesce(F.col(f"fields.{f}"), F.lit(""))).alias(f) for f in self.fields if f not in shared])
        self.rows = kept(read.mapInArrow(_counts(self.fields, shared, words), "doc_id bigint, tie bigint, len array<int>, terms array<struct<key:int,tf:int>>"))
        sums = [F.coalesce(F.sum(F.get("len", F.lit(i))), F.lit(0)) for i in range(len(self.fields))]
        self.n, *self.sizes = self.rows.agg(F.count(F.lit(1)), *sums).first()
        self.unique = self.rows.select("doc_id").distinct().count() == self.n  # the postings of an id that comes again are added to the first's
        self.held = kept(self.rows.select(F.explode("terms.key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("df")))

    def top(self, asked: DataFrame, weights: Mapping[str, float], k: int, bm25: bool = True, best_field: bool = True, allowed: DataFrame | None = None, ties: bool = True) -> DataFrame:
        """The same as TextIndex.top; asked: of the given terms."""
        field, by_field = F.floor(F.col("key") / self.n_terms).cast("int"), lambda of: F.get(F.array(*[F.lit(of(i, f)) for i, f in enumerate(self.fields)]), F.col("field"))
        keys = self.held.withColumn("field", field).filter(F.col("field").isin([i for i, f in enumerate(self.fields) if f in weights]))
        keys = keys.withColumns({"boost": by_field(lambda i, f: float(weights.get(f, 0.0))), "mean": by_field(lambda i, f: max(self.sizes[i] / self.n, 1e-9) if self.n else 1.0)})
        keys = small(keys.withColumn("boost", F.col("boost") * F.log(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5))) if bm25 else keys)
        numbered = asked.select("item_id", "term").join(self.terms, "term").select("item_id", "no")
        each = F.explode(F.array(*[F.lit(i) for i, f in enumerate(self.fields) if f in weights])).alias("field")
        numbered = numbered.select("item_id", "no", each).select("item_id", F.col("field") if best_field else F.lit(0).alias("field"), (F.col("no") + F.col("field") * self.n_terms).cast("bigint").alias("key"), F.lit(1.0).alias("w"))
        n_asked = numbered.count()
        tie = F.col("tie") if ties else F.lit(0).cast("bigint").alias("tie")
        readable = (lambda rows: rows) if allowed is None else (lambda rows: rows.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi"))
        if self.unique and n_asked <= min(BROADCAST_ROWS, parts.BLOCK_ROWS):
            few = keys.select("key", "boost", "mean").toArrow()  # at most the given terms of each field
            weigh = _weighed(few, len(self.fields), self.n_terms, bm25)
            found = parts.top_in_place(readable(self.rows.select("doc_id", tie, "len", "terms")), weigh, numbered.toArrow(), numbered.schema["item_id"].dataType.simpleString(), k)
        else:
            met = self.rows.select("doc_id", "len", F.explode("terms").alias("t")).select("doc_id", "len", "t.key", "t.tf").join(keys, "key")
            size = F.get("len", F.col("field"))
            weight = F.col("boost") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * size / F.col("mean"))) if bm25 else F.col("boost")
            sizes = parts.numbers(keys.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0], self.n, n_asked)
            found = parts.top(met.select("doc_id", F.col("key").cast("bigint").alias("key"), weight.alias("w")), readable(self.rows.select("doc_id", tie)), numbered, k, sizes)
        order = Window.partitionBy("item_id").orderBy(F.desc("score"), "tie", "doc_id")
        found = found.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order))
        return found.filter(F.col("rank") <= k).select("item_id", "doc_id", "score", "rank")


def scan_top(docs: DataFrame, asked: DataFrame, fields: Sequence[str], shared: Mapping[str, Sequence[str]], weights: Mapping[str, float], k: int) -> DataFrame | None:
    """The same as TextScan.top without BM25 and with all fields added up, in one pass over the documents that keeps k of each query and task; None if the queries are too many
    for a task or an id comes again.

    docs, fields, shared: as TextScan takes them; asked: item_id, term. Queries of the same terms are searched once.
    """
    each = asked.filter("term IS NOT NULL").groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    once = kept(kept(each.groupBy("terms").agg(F.collect_list(F.struct("item_id")).alias("items"))).withColumn("no", F.monotonically_increasing_id()))
    docs = docs.filter("doc_id IS NOT NULL")
    if (once.agg(F.sum(F.size("terms"))).first()[0] or 0) > parts.BLOCK_ROWS or docs.select("doc_id").distinct().count() < docs.count():
        return None
    queries = once.select("no", F.explode("terms").alias("term")).toArrow()
    words = pc.unique(queries["term"].combine_chunks().cast(pa.large_string()))
    numbered = pa.table({"item_id": queries["no"], "field": np.zeros(len(queries), dtype=np.int32), "key": pc.index_in(queries["term"].cast(pa.large_string()), value_set=words).cast(pa.int64()), "w": np.ones(len(queries))})
    count, boosts = _counts(fields, shared, words), np.array([float(weights.get(f, 0.0)) for f in fields])

    def postings(batch: pa.RecordBatch) -> pa.Table:
        ids, terms = batch.column("doc_id").to_numpy(), batch.column("terms")
        key = pc.struct_field(terms.flatten(), "key").to_numpy()
        row, w = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy()), boosts[key // max(1, len(words))]
        some = w != 0
        whole = pa.table([batch.column("doc_id"), pa.nulls(len(ids), pa.int64()), batch.column("tie").cast(pa.float64())], names=["doc_id", "key", "w"])
        return pa.concat_tables([whole, pa.table([ids[row[some]], (key[some] % max(1, len(words))).astype(np.int64), w[some]], names=["doc_id", "key", "w"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, n_docs, n_rows = parts.Running(parts.Asked(numbered), k), [], 0, 0
        for batch in count(batches):
            made = postings(batch)
            if held and (n_docs + batch.num_rows > parts.PART_DOCS or n_rows + len(made) > parts.PART_ROWS // 2):  # beside the best so far
                best.add(parts.Part(pa.concat_tables(held)))
                held, n_docs, n_rows = [], 0, 0
            held, n_docs, n_rows = [*held, made], n_docs + batch.num_rows, n_rows + len(made)
        if held:
            best.add(parts.Part(pa.concat_tables(held)))
        yield from best.table().to_batches()

    read = docs.select("doc_id", "tie", *[F.lower(F.coalesce(F.col(f"fields.{f}"), F.lit(""))).alias(f) for f in fields if f not in shared])
    # Each task gives k rows of each query, so there are no more tasks than keep all cores at work.
    found = read.coalesce(3 * docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "no bigint, doc_id bigint, score double, tie double")
    order = Window.partitionBy("no").orderBy(F.desc("score"), "tie", "doc_id")
    found = found.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.join(small(once.select("no", "items")), "no").select(F.explode("items.item_id").alias("item_id"), "doc_id", "score", "rank")
