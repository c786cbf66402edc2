"""Writes that touch several tables of a document library: chunks replaced by document, cascading deletes, and cached answers with what they cite.

All tables live in one Snapshots store, and each function is one commit: readers never see a document whose chunks are gone while its
vectors or cached answers remain. Tables that a store does not have yet are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mark_strip, squeezed
from ..plans.snapshots import Snapshots

#: What a document leaves behind, all with a doc_id.
OF_DOCUMENTS = ("documents", "chunks", "keyword", "vectors", "edges", "progress")
#: Columns of a chunk that are stored as one JSON text (fixed values).
PACKED = ("access_level", "department", "is_parent", "effective_date", "doc_type", "sensitivity_level", "keywords", "dense_vector", "sparse_vector", "graph_triples")
CACHE_SECONDS = 300


def replace_chunks(store: Snapshots, chunks: DataFrame) -> int:
    """Puts chunks (doc_id, chunk_index, content, and any of PACKED) in place of those of the same documents, numbered anew from 0."""
    since = store.version()
    order = Window.partitionBy("doc_id").orderBy("chunk_index", F.xxhash64("content"))
    packed = [F.col(c) for c in PACKED if c in chunks.columns]
    new = chunks.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), "content", F.to_json(F.struct(*packed)).alias("metadata_json") if packed else F.lit("{}").alias("metadata_json"))
    if "chunks" not in store.names():
        return store.commit({"chunks": new}, None, since)
    kept = store.read("chunks", since).join(new.select("doc_id").distinct(), "doc_id", "left_anti")
    return store.commit({"chunks": kept.unionByName(new)}, None, since)


def _without_cited(store: Snapshots, ids: DataFrame, since: int) -> dict[str, DataFrame]:
    """The cache tables without the answers that cite one of ids."""
    if "cache" not in store.names():
        return {}
    cited = store.read("cited", since)
    gone = cited.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("cache_key").distinct()
    return {"cache": store.read("cache", since).join(gone, "cache_key", "left_anti"), "cited": cited.join(gone, "cache_key", "left_anti")}


def delete_documents(store: Snapshots, ids: DataFrame, tenant: str, user: str, role: str = "EMPLOYEE") -> DataFrame:
    """Deletes documents with all that belongs to them, and cached answers that cite them. Returns the ids that were deleted.

    Only documents of the tenant, and for roles other than ADMIN only the user's own (uploader), are; others stay as they are. documents: doc_id, tenant_id, uploader.
    """
    since = store.version()
    mine = store.read("documents", since).filter(F.col("tenant_id") == tenant)
    mine = mine if role == "ADMIN" else mine.filter(F.col("uploader") == user)
    gone = mine.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id").distinct()
    left = {n: store.read(n, since).join(gone, "doc_id", "left_anti") for n in OF_DOCUMENTS if n in store.names()}
    store.commit({**left, **_without_cited(store, gone, since)}, None, since)
    # The version before still holds them, so the answer does not depend on what was just written.
    return gone


def cache_answers(store: Snapshots, answers: DataFrame, seconds: int = CACHE_SECONDS) -> int:
    """Stores answers (user_id, question, answer, citations: array of doc_id, degraded, at), in place of those of the same key.

    Not stored: degraded answers, and those without text or citations. The key is made of the user and the question in normal form; hidden marks are taken out of the
    answer; an answer lives for seconds after at. Of equal keys the latest counts.
    """
    since = store.version()
    good = answers.filter(~F.coalesce("degraded", F.lit(False)) & (F.length(F.trim(F.coalesce("answer", F.lit("")))) > 0) & (F.size(F.coalesce("citations", F.array())) > 0))
    keyed = good.select(
        F.sha2(F.concat_ws(":", F.coalesce("user_id", F.lit("anonymous")), squeezed(F.col("question"))), 256).alias("cache_key"), "user_id", squeezed(F.col("question")).alias("question"),
        mark_strip(F.col("answer")).alias("answer"), "citations", (F.col("at") + F.make_dt_interval(secs=F.lit(float(seconds)))).alias("expires_at"),
    )
    row = F.struct(*keyed.columns)
    new = keyed.groupBy("cache_key").agg(F.max_by(row, F.struct("expires_at", F.xxhash64(F.to_json(row)))).alias("row")).select("row.*")
    cited = new.select("cache_key", F.explode(F.array_distinct("citations")).alias("doc_id")).filter("doc_id IS NOT NULL")
    if "cache" not in store.names():
        return store.commit({"cache": new, "cited": cited}, None, since)
    keys = new.select("cache_key")
    old, old_cited = (store.read(n, since).join(keys, "cache_key", "left_anti") for n in ("cache", "cited"))
    return store.commit({"cache": old.unionByName(new), "cited": old_cited.unionByName(cited)}, None, since)


def cached(store: Snapshots, asked: DataFrame) -> DataFrame:
    """(user_id, question, at, answer): the living answer to each question that was asked before by the same user; null where there is none."""
    key = F.sha2(F.concat_ws(":", F.coalesce("user_id", F.lit("anonymous")), squeezed(F.col("question"))), 256)
    alive = store.read("cache").select("cache_key", "answer", "expires_at")
    met = asked.withColumn("cache_key", key).join(alive, "cache_key", "left")
    return met.select("user_id", "question", "at", F.when(F.col("expires_at") > F.col("at"), F.col("answer")).alias("answer"))


def invalidate(store: Snapshots, ids: DataFrame) -> int:
    """Deletes all cached answers that cite one of ids (doc_id)."""
    since = store.version()
    return store.commit(_without_cited(store, ids, since), None, since)


def sweep(store: Snapshots, now: str) -> int:
    """Deletes answers that have expired by now, and what they cite."""
    since = store.version()
    left = store.read("cache", since).filter(F.col("expires_at") > F.lit(now).cast("timestamp"))
    return store.commit({"cache": left, "cited": store.read("cited", since).join(left.select("cache_key"), "cache_key", "left_semi")}, None, since)
