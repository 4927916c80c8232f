"""Queries of the general data-quality problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import orphans
from tessera.sources.tables import table


def _orphans(spark: SparkSession, sf_dir: str) -> orphans.OrphanState:
    return orphans.orphan_state(*(table(spark, sf_dir, t) for t in ("notes", "sources", "note_sources", "removals")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).references.where("orphan").select("ref_field", "note_id", "target")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.snapshot_counts(_orphans(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p3_found, p3_counts)}
