"""Registered queries of the engine, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum import queries_documents, queries_entries, queries_relational, queries_store, queries_versions

_MODULES = (queries_entries, queries_documents, queries_versions, queries_relational, queries_store)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for m in _MODULES for name, q in m.QUERIES.items() if q.sql}
