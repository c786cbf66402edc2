"""All registered queries; importing the operator modules registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import analytics, answers, chunking, documents, governance, knowledge, questions, relational, rules, scores, search, sessions  # noqa: F401
from .plans import registry
from .sources import files, html  # noqa: F401
from .streaming import events, state  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permission-filtered keyword and BM25 search, fused by weighted reciprocal rank."""
    return search.rrf_weighted(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
