"""All registered queries of the retrieval, evaluation and records operators, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical search of the benchmark passages over the document lines, measured against the passages' own lines."""
    return QUERIES["e3_retrieval_metrics"](spark, sf_dir)


from tessera.plans import text_queries  # noqa: E402, F401, I001  (light queries are registered first)
from tessera.plans import chunk_queries, evidence_queries, ledger_queries, record_queries, report_queries, retrieval_queries, selection_queries, stream_queries, table_queries  # noqa: E402, F401
