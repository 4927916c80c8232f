"""The registered training-data queries, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, contamination, near_duplicates, nearest, sentences, splitting, transcripts
from tessera.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.similar_pairs(nearest.most_similar(table(spark, sf_dir, "note_vectors")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.group_pairs(near_duplicates.near_groups(table(spark, sf_dir, "notes")))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each note that is near another: its class and its number of links."""
    return near_duplicates.near_groups(table(spark, sf_dir, "notes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.speaker_turns(table(spark, sf_dir, "ingest_results"), table(spark, sf_dir, "speakers"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_at_boundaries(table(spark, sf_dir, "ingest_results"), "ingest_id", "transcript")


def p5_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_at_landmarks(table(spark, sf_dir, "ingest_results"), "ingest_id", "transcript")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = contamination.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.select("doc_id", "item_id")


def p7_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of which a document holds at least half in tiles of five words or more, in whatever order."""
    return contamination.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), least=5, least_covered=0.5)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_spans(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_groups, p4_found, p5_found, p5_landmarks, p6_ids, p7_found, p7_reordered, p8_found)}


#: Exact neighbours by brute force. The others need NFKC, sequential scanning or a tokenizer, which SQL lacks.
P1_SQL = """WITH v AS (SELECT note_id AS id, min(vector)::DOUBLE[128] AS v FROM note_vectors WHERE note_id IS NOT NULL AND len(vector) = 128
    AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY note_id),
  nn AS (SELECT l.id AS l, r.id AS r FROM v l JOIN v r ON l.id <> r.id QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY round(list_cosine_similarity(l.v, r.v), 14) DESC, r.id) <= 5)
  SELECT DISTINCT least(l, r) AS left_note_id, greatest(l, r) AS right_note_id FROM nn"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL}
