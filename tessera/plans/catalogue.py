"""The registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

PARTS = ("retrieval", "knowledge", "records", "reviewing", "upkeep", "lifecycle", "general_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for part in PARTS:
        found.update(import_module(f"tessera.plans.{part}").QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for part in PARTS:
        found.update(getattr(import_module(f"tessera.plans.{part}"), "SQL", {}))
    return found
