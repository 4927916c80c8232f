"""Deterministic quality findings on pages, links and provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.validation import PAGE_TYPES

#: The order of severities.
SEVERITY = {"error": 0, "warning": 1, "info": 2}


def _issue(rows: DataFrame, code: str, severity: str, related: Column | None = None) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("note_id").alias("page_id"), F.col("title").alias("page_title"), (F.lit(None).cast("string") if related is None else related).alias("related_title"))


def missing_provenance(pages: DataFrame, sources: DataFrame) -> DataFrame:
    return _issue(pages.join(sources.select("note_id").distinct(), "note_id", "left_anti"), "missing_provenance", "warning")


def recorded_contradiction(pages: DataFrame, sources: DataFrame) -> DataFrame:
    held = sources.where("action = 'contradict'").select("note_id").distinct()
    return _issue(pages.join(held, "note_id", "left_semi"), "recorded_contradiction", "info")


def unreadable(pages: DataFrame) -> DataFrame:
    return _issue(pages.where("body is null"), "unreadable_page", "error")


def legacy_format(pages: DataFrame, types: tuple[str, ...] = PAGE_TYPES) -> DataFrame:
    """Readable pages outside the page format: no text, no title or an unknown type."""
    bad = (F.col("body") == "") | F.col("title").isNull() | ~F.coalesce(F.col("type").isin(*types), F.lit(False))
    return _issue(pages.where(F.col("body").isNotNull() & bad), "legacy_format", "warning")


def parseable(pages: DataFrame, types: tuple[str, ...] = PAGE_TYPES) -> DataFrame:
    return pages.where(F.col("body").isNotNull() & (F.col("body") != "") & F.col("title").isNotNull() & F.col("type").isin(*types))


def duplicate_titles(pages: DataFrame) -> DataFrame:
    """One finding for each page of a title that several share; counted first, so a hot title is only joined back."""
    keyed = pages.withColumn("key", F.lower("title"))
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1 and key is not null").drop("n")
    return _issue(keyed.join(many, "key"), "duplicate_title", "error", F.col("key"))


def _link_occurrences(pages: DataFrame) -> DataFrame:
    return parseable(pages).select("note_id", "title", F.explode("links").alias("link")).where("link is not null and link <> ''").withColumn("key", F.lower("link"))


def broken_links(pages: DataFrame) -> DataFrame:
    """One finding for each link whose title no page has."""
    titles = pages.select(F.lower("title").alias("key")).where("key is not null").distinct()
    return _issue(_link_occurrences(pages).join(titles, "key", "left_anti"), "broken_link", "error", F.col("link"))


def inbound_counts(pages: DataFrame) -> DataFrame:
    """(key, inbound): links to each existing title."""
    titles = pages.select(F.lower("title").alias("key")).where("key is not null").distinct()
    return _link_occurrences(pages).groupBy("key").agg(F.count("*").alias("inbound")).join(titles, "key", "left_semi")


def orphan_pages(pages: DataFrame) -> DataFrame:
    """Parseable pages without an inbound link, if there are at least two of them."""
    known = parseable(pages).withColumn("key", F.lower("title"))
    alone = known.join(inbound_counts(pages).select("key"), "key", "left_anti")
    several = len(known.select("note_id").limit(2).take(2)) > 1
    return _issue(alone if several else alone.limit(0), "orphan_page", "warning")


def report(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """All findings with their severity rank."""
    parts = [
        missing_provenance(pages, sources), recorded_contradiction(pages, sources), unreadable(pages), legacy_format(pages), duplicate_titles(pages), broken_links(pages), orphan_pages(pages),
    ]
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank)


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("rank", F.collate("page_title", "UNICODE_CI_AI"), "code", "page_id", "related_title")


def summary(findings: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(severity, findings, pages, sources): counts by severity next to the totals of the collection."""
    n_pages, n_sources = pages.count(), sources.select("source_id").distinct().count()
    return findings.groupBy("severity").agg(F.count("*").alias("findings")).withColumns({"pages": F.lit(n_pages).cast("bigint"), "sources": F.lit(n_sources).cast("bigint")})
