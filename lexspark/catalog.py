"""All named queries, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import chain, display, names, search, strings, text, vocabulary

_PARTS = (text, chain, vocabulary, names, strings, search, display)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for part in _PARTS for k, s in part.ORACLE_SQL.items()}
