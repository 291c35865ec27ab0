"""The library's registered queries, each with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("relational", "dialect", "temporal", "dml", "text", "trend", "resolve", "web", "operations", "evidence", "streams", "watches", "leads", "values")


def _modules():
    return [import_module(f"{__name__}.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["agg_group_having"](spark, sf_dir)
