"""Readers of the parquet tables, with one row per distinct row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as stored; columns and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def distinct_rows(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The chosen columns with exact repeats of a row counted once."""
    df = table(spark, sf_dir, name)
    return (df.select(*columns) if columns else df).distinct()
