"""Upkeep of derived tables."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import maintenance


def test_upsert_and_identity(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    fresh = spark.createDataFrame([(2, "c"), (3, "d")], "id bigint, v string")
    assert {tuple(r) for r in maintenance.upsert(stored, fresh, "id").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {r["id"] for r in maintenance.without(stored, fresh, "id").collect()} == {1}
    kept, _ = maintenance.activated(stored, stored, "m1", "m1")
    gone, links = maintenance.activated(stored, stored, "m1", "m2")
    assert (kept.count(), gone.count(), links.count()) == (2, 0, 0)
    with pytest.raises(ValueError):
        maintenance.next_to_embed(stored, stored, 0)


def test_small_collections_get_all_pairs(spark):
    pages = spark.createDataFrame([(i,) for i in range(4)], "note_id bigint")
    held = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "note_id bigint, source_id bigint")
    got = {tuple(r) for r in maintenance.small_collection_pairs(pages, held).select("left_id", "right_id").collect()}
    assert got == {(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)}
    many = spark.range(30).select(F.col("id").alias("note_id"))
    assert maintenance.small_collection_pairs(many, held).count() == 0
    assert maintenance.small_collection_pairs(pages.limit(0), held).count() == 0


def test_resume_needs_unchanged_pages(spark):
    gen = spark.createDataFrame([("vault", "m", "1", "s")], "scope string, model string, prompt_version string, page_snapshot_hash string")
    cand = spark.createDataFrame([("queued", 1, 2, "a", "b"), ("reviewed", 1, 3, "a", "old")], "status string, left_note_id bigint, right_note_id bigint, left_hash string, right_hash string")
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "note_id bigint, evidence_hash string")
    assert maintenance.may_resume(gen, cand, now, "vault", "m", "1", "s")
    assert not maintenance.may_resume(gen, cand, now, "vault", "m2", "1", "s")
    assert not maintenance.may_resume(gen, cand, now.where("note_id <> 2"), "vault", "m", "1", "s")


def test_outcomes_are_guarded(spark):
    cand = spark.createDataFrame([("a", "queued", None), ("b", "reviewed", None), ("c", "queued", None)], "fingerprint string, status string, discovery_id bigint")
    out = spark.createDataFrame([("a", "proposed", 5), ("b", "proposed", 6), ("c", "proposed", None)], "fingerprint string, status string, discovery_id bigint")
    assert {tuple(r) for r in maintenance.recorded(cand, out).collect()} == {("a", "proposed", 5), ("b", "reviewed", None), ("c", "queued", None)}


def test_saved_answers_inherit_sources(spark):
    notes = spark.createDataFrame([(1, "A", "concept", "x", None), (2, "B", "entity", "y", None)], "note_id bigint, title string, type string, body string, links array<string>")
    held = spark.createDataFrame([(1, 5, "new"), (2, 5, "merge"), (2, 6, "new")], "note_id bigint, source_id bigint, action string")
    pages, prov = maintenance.saved_answer(notes, held, 9, "Answer", "text", [1, 2])
    assert pages.where("note_id = 9").first()["links"] == ["A", "B"]
    assert {r["source_id"] for r in prov.where("note_id = 9").collect()} == {5, 6}
    with pytest.raises(ValueError):
        maintenance.saved_answer(notes, held, 9, "a", "text", [1])


def test_small_helpers(spark):
    edges = spark.createDataFrame([(1, 2, "explicit"), (2, 3, "semantic")], "source bigint, target bigint, kind string")
    assert {r["node"] for r in maintenance.focus(edges, 2).collect()} == {1, 2, 3}
    old = spark.createDataFrame([(1, "Old page", "text", 4), (2, "Lone", "t", None)], "id bigint, title string, content string, episode_id bigint")
    rows = maintenance.migrated(old, spark.createDataFrame([(4, "https://e.example")], "id bigint, url string")).orderBy("note_id").collect()
    assert [(r["file_path"], r["source_url"]) for r in rows] == [("notes/old-page-1.md", "https://e.example"), ("notes/lone-2.md", None)]
    text = spark.createDataFrame([("## PDF page 1\n\nfirst\n\n## PDF page 2\n\nsecond",), ("none",)], "t string")
    assert [r[0] for r in text.select(maintenance.page_slice(F.col("t"), 2)).collect()] == ["second", None]
    assert text.limit(1).select(maintenance.step_states(F.lit("staged"))["review"]).first()[0] == "current"
