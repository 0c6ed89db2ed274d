"""All queries over text-recognition results, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boxes, corpus, files, logs, planning, running, streams, tensors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _part in (boxes, logs, tensors, planning, corpus, streams, running, files):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
