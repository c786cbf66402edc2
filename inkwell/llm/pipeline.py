"""A corpus pipeline over the documents table: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes what its predecessor kept, written as Parquet and read again.

Defined cases: documents without text, with empty text, or without enough words fail the quality rules; rows without a doc_id pass all
stages by their text alone; rows that repeat a doc_id become one at the second stage; columns beyond those of documents are carried
through, whatever they are called; a table without rows gives no rows. Each stage's docstring states its own rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, mixing, near_dedup, quality_rules, sharding
from .common import clean, position, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules.stage),
    ("near_dedup", near_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("mix_sources", mixing.stage),
    ("shard", sharding.stage),
]

#: Expectation-maximisation, min-hash forests and min-cost flow are not expressible in SQL; tests compare with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every earlier stage is written to the shared folder and read back.

    Once a stage is written, its own intermediate tables and its predecessor's rows are deleted.
    """
    docs, start = table(spark, sf_dir, "documents"), position()
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
            clean(spark, start, keep_last=True)
    return docs
