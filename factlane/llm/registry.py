"""Queries of this subpackage: ``QUERIES[name](spark, sf_dir) -> DataFrame``;
``ORACLE_SQL[name]`` is the DuckDB twin where SQL can express the operator."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco
