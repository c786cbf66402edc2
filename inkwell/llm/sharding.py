"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table; shards take turns claiming their best free
slot until the table is full. A document's slot is its key's hash modulo the table size. The table has SLOTS
rows whatever the input, so it is broadcast, and placing a document is one look-up without a shuffle. When a
shard comes or goes, nearly all other slots keep their owner.

Defined cases: a null key is placed by the text's hash; rows that repeat a key share a shard; null or empty text is
placed like any other; no rows give no rows; extra columns of any name and type are kept, but a column called shard (for place() also slot),
in upper or lower case, is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole

SLOTS = 65_537
SHARDS = 256
SEED = 77


def fill(shards: Sequence[str], slots: int = SLOTS, turns: Sequence[int] | None = None) -> list[int]:
    """The owner (position in shards) of each slot. turns: claims that a shard makes in a round (its weight), 1 by default."""
    if not shards or slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, not smaller than the number of shards, of which there must be one")
    digests = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digests]
    owner, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            for _ in range(turns[i] if turns else 1):
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                owner[at[i]] = i
                left -= 1
                if not left:
                    return owner


def place(docs: DataFrame, key: Column, spare: Column, shards: Sequence[str] | None = None, slots: int = SLOTS, turns: Sequence[int] | None = None) -> DataFrame:
    """docs with slot and shard (position in shards). spare: hashed where key is null."""
    names = shards or [f"shard-{i:05d}" for i in range(SHARDS)]
    # SLOTS rows of two integers: a size fixed by parameters, so a broadcast is safe at every size of input.
    owners = docs.sparkSession.createDataFrame(list(enumerate(fill(names, slots, turns))), "slot int, shard int")
    h = F.when(key.isNotNull(), F.xxhash64(F.lit(SEED), key)).otherwise(F.xxhash64(F.lit(SEED + 1), spare))
    return docs.drop("slot", "shard").withColumn("slot", F.pmod(h, F.lit(slots)).cast("int")).join(F.broadcast(owners), "slot")


def write_shards(placed: DataFrame, path: str, pieces: int = 1) -> None:
    """Writes one folder for each shard. pieces: files that a shard's rows are salted into, for shards beyond one task."""
    salt = F.pmod(F.xxhash64(F.to_json(whole(placed, "shard"))), F.lit(pieces))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return place(docs, F.col("doc_id"), F.col("text")).select("doc_id", "slot", "shard", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents' columns and their shard."""
    return place(docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), whole(docs, "shard").alias("_row")), F.col("_id"), F.col("_text")).select("_row.*", "shard")
