"""Reciprocal-rank fusion of keyword and vector results, and the context of a question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lexical import title_boost

RRF = 60


def fuse(keyword: DataFrame, semantic: DataFrame, titles: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(note_id, title, score, match_type) from keyword(note_id, position) and semantic(note_id, position), both cut at their limit.

    positions count from 1. score = title boost, once, plus 1 / (60 + position) of each list.
    """
    k = keyword.select("note_id", F.col("position").alias("kp"))
    s = semantic.select("note_id", F.col("position").alias("sp"))
    both = k.join(s, "note_id", "full_outer").join(titles.select("note_id", "title"), "note_id")
    part = lambda c: F.coalesce(1 / (F.lit(RRF) + F.col(c)), F.lit(0.0))
    kind = F.when(F.col("kp").isNotNull() & F.col("sp").isNotNull(), "both").when(F.col("kp").isNotNull(), "keyword").otherwise("semantic")
    scored = both.select("note_id", "title", (title_boost(F.col("title"), query) + part("kp") + part("sp")).alias("score"), kind.alias("match_type"))
    return scored.orderBy(F.round("score", 12).desc(), "title", "note_id").limit(limit)


def positions(df: DataFrame, *order) -> DataFrame:
    """df with `position` from 1 in the given order; for lists that a limit has already cut."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def question_context(keyword: DataFrame, semantic: DataFrame, edges: DataFrame, seeds: int = 8, pages: int = 12) -> DataFrame:
    """(note_id, position): the first distinct seeds (keyword before semantic), then their explicit neighbours seed by seed.

    keyword and semantic have (note_id, position); edges (source, target, kind). At most `pages` rows.
    """
    ranked = keyword.select("note_id", F.col("position").alias("at"), F.lit(0).alias("list")).unionByName(semantic.select("note_id", F.col("position").alias("at"), F.lit(1).alias("list")))
    first = ranked.groupBy("note_id").agg(F.min(F.struct("list", "at")).alias("o")).orderBy("o", "note_id").limit(seeds)
    top = first.select("note_id", F.row_number().over(Window.orderBy("o", "note_id")).alias("seed"))
    links = edges.where("kind = 'explicit'").select("source", "target")
    both = links.select(F.col("source").alias("a"), F.col("target").alias("b"), "source", "target").unionByName(links.select(F.col("target").alias("a"), F.col("source").alias("b"), "source", "target"))
    hops = both.join(F.broadcast(top), both["a"] == top["note_id"]).select(F.col("b").alias("note_id"), F.lit(1).alias("hop"), "seed", "source", "target")  # at most `seeds` rows
    zero = F.lit(0).cast("bigint")
    everything = top.select("note_id", F.lit(0).alias("hop"), "seed", zero.alias("source"), zero.alias("target")).unionByName(hops)
    order = everything.groupBy("note_id").agg(F.min(F.struct("hop", "seed", "source", "target")).alias("o")).orderBy("o", "note_id").limit(pages)
    return order.select("note_id", F.row_number().over(Window.orderBy("o", "note_id")).alias("position"))
