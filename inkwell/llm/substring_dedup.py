"""Substring dedup: words in windows that already stand in an earlier document, by FM-indexes over content shards.

1. Anchors. Each window of WINDOW words has an anchor: its GRAM-word run of least hash. Equal windows have equal
   anchors, so a window whose anchor is one of this document only cannot be shared.
   Anchors are counted over all documents (least and greatest doc_id, partial sums first).
   Documents that repeat an earlier one as a whole are settled by a hash of their text and go no further.
2. Segments. Runs of windows with one shared anchor are cut out of the documents as text and dealt to shards
   by the anchor's hash: all places where a window can be found again are in its own shard, and a document is
   streamed to few shards. Segments with equal text are one row with their least doc_id. Where an anchor has more than
   HOT occurrences, its windows are cut singly and dealt by their own hash, so that no shard holds a hot passage.
3. Each task builds compressed FM-indexes (wavelet matrix) over its segments, MAX_INDEX_WORDS words at a time and never
   splitting a shard key, streams the segments through backward search, and reports the intervals of at least WINDOW
   words that also stand in a document with a smaller doc_id.
4. Intervals meet their documents again by doc_id and text hash; covered words are cut out.

Inside an index words are compared as text. Two things are decided by digests alone: that two whole texts are equal (two
64-bit hashes) and that two segments are equal (128 bits of BLAKE2b). Anchors only route.
Defined cases: null or empty text has no words; texts of fewer than
WINDOW words lose nothing; rows that repeat a doc_id are one document (a window of theirs is not removed for
standing in another such row); null doc_id is neither earlier nor later than any, and such rows lose nothing and take
no part in any exchange; ids are any 64-bit integers; no rows give no rows; extra columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .fm_index import FMIndex, matched_windows
from .textops import gram_hashes, pieces, word_hashes

WINDOW, GRAM = 50, 10
#: Occurrences of an anchor from which its windows are dealt singly.
HOT = 2_000
#: Words of an index that a task builds at once (about 300 bytes each).
MAX_INDEX_WORDS = 400_000
#: The end of a cut that takes the whole text.
WHOLE = 1 << 40


def anchors_of(grams: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window start: the place of its least gram hash (the last of equals)."""
    span = window - gram + 1
    if len(grams) < span:
        return np.zeros(0, dtype=np.int64)
    # Sliding minimum by doubling; places break ties.
    place = np.arange(len(grams), dtype=np.int64)
    best, width = place, 1
    while width * 2 <= span:
        a, b = best[: len(best) - width], best[width:]
        best = np.where(grams[b] <= grams[a], b, a)
        width *= 2
    if width < span:
        shift = span - width
        a, b = best[: len(best) - shift], best[shift:]
        best = np.where(grams[b] <= grams[a], b, a)
    return best


def each_document(texts: list[bytes | None], window: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(row, gram hashes, anchor of each window, words) of the texts with a window at least."""
    words, at = word_hashes(texts, lower=False)
    for i in range(len(texts)):
        n = int(at[i + 1] - at[i])
        if n >= window:
            grams = gram_hashes(words[at[i] : at[i + 1]], gram)
            yield i, grams, anchors_of(grams, window, gram), n


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, h): the hashes of each document's anchors, once each; docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            ids = batch.column(0).to_numpy()
            own, hashes = [], []
            for i, grams, best, _ in each_document(batch.column(1).cast(pa.binary()).to_pylist(), window, gram):
                h = np.unique(grams[np.unique(best)])
                own.append(np.full(len(h), ids[i], dtype=np.int64))
                hashes.append(h.view(np.int64))
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.concatenate(hashes))], ["doc_id", "h"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, h bigint")


def segments(met: DataFrame, window: int, gram: int, with_text: bool) -> DataFrame:
    """(doc_id, tk, starts, size, key, c, d[, text]): runs of windows under one shared anchor, a row for each text that a document has; met: doc_id, tk, text, shared (array of h, hot), copies (tk of texts that are whole copies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            ids, tks = batch.column(0).to_numpy(), batch.column(1).to_numpy()  # without nulls, so exact integers
            texts, shared, copies = batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3), batch.column(4)
            texts = [None if not some or c and tk in c else t for t, tk, some, c in zip(texts, tks.tolist(), shared.is_valid().to_pylist(), copies.to_pylist(), strict=True)]
            rows: list[tuple] = []
            for i, grams, best, n in each_document(texts, window, gram):
                entries = shared[i].values
                if entries is None or not len(entries):
                    continue
                known, hot = entries.field("h").to_numpy(zero_copy_only=False), entries.field("hot").to_numpy(zero_copy_only=False)
                order = np.argsort(known)
                known, hot = known[order], hot[order]
                places = np.unique(best)
                h = grams[places].view(np.int64)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                is_shared, is_hot = known[at] == h, hot[at]
                of_window = np.searchsorted(places, best)
                open_ = is_shared[of_window]  # equal windows have equal anchors; windows under an anchor of this document alone are its own
                if not open_.any():
                    continue
                hot_window = is_hot[of_window]
                cut = np.ones(len(best), dtype=bool)
                cut[1:] = (best[1:] != best[:-1]) | (open_[1:] != open_[:-1]) | hot_window[1:]
                firsts = np.flatnonzero(cut)
                lasts = np.append(firsts[1:], len(best)) - 1
                words = texts[i].split()
                own: dict[bytes, tuple[int, int, list[int], bytes]] = {}
                for a, b in zip(firsts[open_[firsts]].tolist(), lasts[open_[firsts]].tolist(), strict=True):
                    text = b" ".join(words[a : b + window])
                    digest = hashlib.blake2b(text, digest_size=16).digest()
                    if digest in own:
                        own[digest][2].append(a)
                    else:
                        own[digest] = (b - a + window, int(grams[best[a]].view(np.int64)) if not hot_window[a] else None, [a], text)
                for digest, (size, key, starts, text) in own.items():
                    c, d = np.frombuffer(digest, dtype=np.int64).tolist()
                    rows.append((ids[i], tks[i], starts, size, c if key is None else key, c, d, text.decode("utf-8", "surrogatepass") if with_text else ""))
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * 4, pa.string()]
                names = ["doc_id", "tk", "starts", "size", "key", "c", "d", "text"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)][: 8 if with_text else 7], names[: 8 if with_text else 7])

    out = "doc_id bigint, tk bigint, starts array<bigint>, size bigint, key bigint, c bigint, d bigint"
    return met.select("doc_id", "tk", "text", "shared", "copies").mapInArrow(run, out + (", text string" if with_text else ""))


def repeats(classes: DataFrame, window: int, index_words: int) -> DataFrame:
    """(key, c, d, a, b): windows a to b of a segment stand in one with a smaller owner. classes: key, c, d, owner, text."""

    def search(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
        words = [r[4].split() for r in rows]
        ids: dict[bytes, int] = {}
        flat = np.fromiter((ids.setdefault(w, len(ids) + 1) for ws in words for w in ws), dtype=np.int64)
        sizes = np.array([len(ws) for ws in words], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        owners = np.unique(np.array([r[3] for r in rows], dtype=np.int64), return_inverse=True)[1].astype(np.int32)
        index = FMIndex(flat, starts, owners, window + 64)
        found = matched_windows(index, sizes, owners, window)
        offsets = np.concatenate([[0], np.cumsum(sizes - window + 1)])
        which = np.repeat(np.arange(len(rows)), sizes - window + 1)
        edge = np.ones(len(found), dtype=bool)
        edge[1:] = (found[1:] != found[:-1]) | (which[1:] != which[:-1])
        firsts = np.flatnonzero(edge)
        lasts = np.append(firsts[1:], len(found)) - 1
        keep = found[firsts]
        firsts, lasts = firsts[keep], lasts[keep]
        own = which[firsts]
        head = [pa.array(np.array([r[k] for r in rows], dtype=np.int64)[own]) for k in range(3)]
        return pa.RecordBatch.from_arrays([*head, pa.array(firsts - offsets[own]), pa.array(lasts - offsets[own])], ["key", "c", "d", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        n_held = n_group = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4).cast(pa.binary()).to_pylist(), strict=True):
                if group and row[0] != group[0][0]:
                    if len(group) > 1:  # a segment alone under its key has nothing to be found in
                        if held and n_held + n_group > index_words:
                            yield search(held)
                            held, n_held = [], 0
                        held.extend(group)
                        n_held += n_group
                    group, n_group = [], 0
                group.append(row)
                n_group += row[4].count(b" ") + 1
        if len(group) > 1:
            if held and n_held + n_group > index_words:
                yield search(held)
                held = []
            held.extend(group)
        if held:
            yield search(held)

    dealt = classes.select("key", "c", "d", "owner", "text").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key bigint, c bigint, d bigint, a bigint, b bigint")


def dedup_substrings(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, index_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of each row; kept words are joined by one space."""
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), F.col(text).alias("text"))
    slim = every.filter("doc_id IS NOT NULL")
    nameless = every.filter("doc_id IS NULL").withColumn("cuts", F.array().cast("array<struct<tk:bigint,start:bigint,end:bigint>>"))
    # A whole copy of an earlier document loses all windows; only the first of equal texts goes on.
    names = slim.filter("text IS NOT NULL").select("doc_id", "tk", F.xxhash64(F.lit(1), F.col("text")).alias("tk2"))
    firsts = names.groupBy("tk", "tk2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    copies = names.join(firsts, ["tk", "tk2"]).filter("doc_id > first").select("doc_id", "tk")
    found = written(anchors(slim, window, gram))
    shared = found.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").select("h", (F.col("n") >= hot).alias("hot"))
    # As many entries in a row as its own document has anchors.
    known = found.join(shared, "h").groupBy("doc_id").agg(F.collect_set(F.struct("h", "hot")).alias("shared"))
    # The one shuffle of the texts; all that follows meets it by doc_id alone, so that its exchange is used again.
    dealt = slim.repartition("doc_id")
    met = dealt.join(known.join(copies.groupBy("doc_id").agg(F.collect_set("tk").alias("copies")), "doc_id", "left"), "doc_id", "left")
    segs = segments(met, window, gram, True)
    classes = segs.groupBy("key", "c", "d").agg(F.min("doc_id").alias("owner"), F.first("text").alias("text"))
    inner = repeats(classes, window, index_words).groupBy("key", "c", "d").agg(F.collect_list(F.struct("a", "b")).alias("inner"))
    places = segments(met, window, gram, False)
    owners = places.groupBy("key", "c", "d").agg(F.min("doc_id").alias("owner")).join(inner, ["key", "c", "d"], "left")
    owned = places.join(owners, ["key", "c", "d"])
    # A copy of a segment that has an earlier owner goes whole; the owner's own loses what the index reported.
    spans = F.when(F.col("doc_id") > F.col("owner"), F.array(F.struct(F.lit(0).cast("bigint").alias("a"), (F.col("size") - window).alias("b")))).otherwise(F.col("inner"))
    cut = owned.select("doc_id", "tk", "starts", F.explode(spans).alias("s")).select("doc_id", "tk", "s", F.explode("starts").alias("start"))
    cut = cut.select("doc_id", "tk", (F.col("start") + F.col("s.a")).alias("start"), (F.col("start") + F.col("s.b") + window).alias("end"))
    cut = cut.unionByName(copies.select("doc_id", "tk", F.lit(0).cast("bigint").alias("start"), F.lit(WHOLE).alias("end")))
    cuts = cut.groupBy("doc_id").agg(F.collect_set(F.struct("tk", "start", "end")).alias("cuts"))
    return removed(dealt.join(cuts, "doc_id", "left"), window).unionByName(removed(nameless, window))


def removed(met: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text; met: doc_id, tk, text, cuts (tk, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            n_words, n_removed, kept = [], [], []
            for text, tk, cuts in zip(batch.column(1).cast(pa.binary()).to_pylist(), *(batch.column(k).to_pylist() for k in (2, 3)), strict=True):
                words, out, at = (text or b"").split(), [], 0
                for cut in sorted((c["start"], c["end"]) for c in cuts or () if c["tk"] == tk and len(words) >= window):
                    out.extend(words[at : cut[0]])
                    at = max(at, cut[1])
                out.extend(words[at:])
                n_words.append(len(words))
                n_removed.append(len(words) - len(out))
                kept.append(b" ".join(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return met.select("doc_id", "text", "tk", "cuts").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
