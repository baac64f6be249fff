"""All registered queries of the core library and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans import answer_queries, composite_queries, corpus_queries, evaluation_queries, index_queries, law_queries, metric_queries, retrieval_queries, routing_queries, scalar_queries  # noqa: F401
from corpusmill.plans.registry import ORACLES, QUERIES

FLAGSHIP = "hybrid_rrf"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
