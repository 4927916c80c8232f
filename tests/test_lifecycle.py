"""Approving, undoing, rebuilding, confirming and asking, on small catalogues."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera import api
from tessera.operators import integrity, lifecycle

REL = "array<struct<target:string,type:string,explanation:string,significance:string,pageHashes:array<string>,confirmedAt:string>>"
NOTE = f"note_id bigint, title string, type string, body string, tags array<string>, links array<string>, relationships {REL}, source_url string, source_type string, created_at timestamp"
CHANGE = "change_id bigint, action string, note_id bigint, title string, body string, type string, base_hash string"
AT = dt.datetime(2026, 1, 2)


def sha(spark, text):
    return spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0]


@pytest.fixture(scope="module")
def vault(spark):
    rows = [(1, "One", "concept", "first", [], [], None, None, None, None), (2, "Two", "concept", "second", [], None, None, "u", "text", None), (3, "Three", "entity", "third", [], [], None, None, None, None)]
    return api.Vault(
        spark.createDataFrame(rows, NOTE), spark.createDataFrame([(7, "h7", "S", "url7", "text"), (8, "h8", "T", "url8", "pdf")], "source_id bigint, content_hash string, title string, source_url string, source_type string"),
        spark.createDataFrame([(1, 7, "new"), (2, 7, "merge"), (3, 8, "new")], "note_id bigint, source_id bigint, action string"), spark.createDataFrame([(i, [float(i), 1.0]) for i in (1, 2, 3)], "id bigint, v array<float>"),
        spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.4)], "source_note_id bigint, target_note_id bigint, similarity double"),
    )


def texts(vault):
    return {r["note_id"]: r["body"] for r in vault.notes.collect()}


def test_approve_then_undo_gives_back_the_vault(spark, vault):
    changes = spark.createDataFrame([(1, "merge", 2, "Two", "second and more", "concept", sha(spark, "second")), (2, "new", 9, "Nine", "ninth", "entity", None), (3, "merge", 3, "Three", "no", "entity", sha(spark, "third"))], CHANGE)
    said = spark.createDataFrame([(1, True), (2, True), (3, False)], "change_id bigint, include boolean")
    after, statuses, history = api.approve_proposal(vault, changes, said, 8, "h1", AT)
    assert {r["change_id"]: r["status"] for r in statuses.collect()} == {1: "apply", 2: "apply", 3: "excluded"}
    assert texts(after) == {1: "first", 2: "second and more", 3: "third", 9: "ninth"}
    assert {tuple(r) for r in after.provenance.collect()} == {(1, 7, "new"), (2, 7, "merge"), (3, 8, "new"), (2, 8, "merge"), (9, 8, "new")}
    assert {r["id"] for r in after.vectors.collect()} == {1, 3} and after.links.count() == 0
    assert after.notes.where("note_id = 9").first()["source_url"] == "url8"
    none = history.limit(0).select("history_id")
    back, which, conflicts = api.undo_last(after, history, none)
    assert which == "h1" and conflicts.count() == 0 and texts(back) == texts(vault)
    assert {tuple(r) for r in back.provenance.collect()} == {(1, 7, "new"), (2, 7, "merge"), (3, 8, "new")}
    assert back.notes.where("note_id = 2").first()["source_url"] == "url7"  # the first source that is left
    # A page changed since: nothing is undone.
    moved = lifecycle.replace(api._catalogue(after, history), notes=after.notes.withColumn("body", F.when(F.col("note_id") == 9, "edited").otherwise(F.col("body"))))
    same, conflicts = lifecycle.undo(moved, "h1")
    assert same is moved and [tuple(r) for r in conflicts.collect()] == [("h1", 9, "changed")]
    assert api.undo_last(after, history, history.select("history_id"))[1] is None


def test_a_stale_change_stops_all(spark, vault):
    changes = spark.createDataFrame([(1, "merge", 2, "Two", "x", "concept", "old"), (2, "new", 9, "one", "y", "entity", None)], CHANGE)
    said = spark.createDataFrame([(1, True), (2, True)], "change_id bigint, include boolean")
    after, statuses, history = api.approve_proposal(vault, changes, said, 8, "h1", AT)
    assert {r["status"] for r in statuses.collect()} == {"stale", "title_taken"} and texts(after) == texts(vault) and history is None
    with pytest.raises(ValueError):
        api.approve_proposal(vault, changes, said.limit(0), 8, "h1", AT)


def page(title, hashes):
    claims = f"\n<!-- page-claim:{','.join(hashes)} -->" if hashes else ""
    sources = "\n\n## Sources\n\n" + "\n".join(f"- S; SHA-256: `{h}` <!-- page-source:{h} -->" for h in hashes) if hashes else ""
    return f"---\ntitle: {json.dumps(title)}\ntype: concept\ntags: []\nlinks: []\n---\n\n# {title}\n\nText of {title}{claims}{sources}\n"


def test_rebuild_from_files(spark, vault):
    a, b = "a" * 64, "b" * 64
    files = spark.createDataFrame([("notes/z.md", page("Zed", [b, a])), ("notes/a.md", page("Ay", []))], "path string, markdown string")
    archive = spark.createDataFrame([(a, "A", "ua", "text", AT), (b, "B", "ub", "pdf", None)], "content_hash string, title string, source_url string, source_type string, archived_at timestamp")
    actions = spark.createDataFrame([("notes/z.md", b, "new")], "path string, content_hash string, action string")
    after = api.rebuild(files, archive, actions, vault)
    assert {(r["note_id"], r["title"], r["body"], r["source_url"]) for r in after.notes.collect()} == {(1, "Ay", "Text of Ay", None), (2, "Zed", "Text of Zed", "ub")}
    assert {tuple(r) for r in after.provenance.collect()} == {(2, 2, "new"), (2, 1, "reference")}
    assert after.vectors.count() == 0 and after.links.count() == 0
    bad = files.unionByName(spark.createDataFrame([("notes/b.md", page("zed", ["c" * 64])), ("notes/c.md", "no page")], "path string, markdown string"))
    found = lifecycle.rebuild_problems(lifecycle.parsed_files(bad), archive)
    assert {tuple(r) for r in found.collect()} == {("notes/c.md", "unreadable"), ("notes/z.md", "duplicate_title"), ("notes/b.md", "duplicate_title"), ("notes/b.md", "unknown_source")}
    with pytest.raises(ValueError):
        api.rebuild(bad, archive, actions, vault)
    assert [r["content_hash"] for r in lifecycle.awaiting(archive, archive.where("title = 'A'")).collect()] == [b]
    assert api.restage_source(vault, archive, a).count() == 1


def test_legacy_links(spark):
    rows = [(2, 1, 0.4), (1, 2, None), (1, 2, 0.3), (3, 3, 0.1), (None, 1, 0.1), (5, 4, None)]
    got = lifecycle.migrated_links(spark.createDataFrame(rows, "source_note_id bigint, target_note_id bigint, similarity double"))
    assert {tuple(r) for r in got.collect()} == {(1, 2, 0.3), (4, 5, None)}


def test_discoveries_are_confirmed_together(spark, vault):
    stored = spark.createDataFrame([(1, "pending", [1, 3], "supports"), (2, "rejected", [2, 3], "temporal")], "id bigint, status string, page_ids array<bigint>, type string")
    assert [r["pages"][0]["title"] for r in api.discoveries(stored, vault, "open").collect()] == ["One"]
    after, left = api.confirm_discoveries(vault, stored, [1], "CONFIRM 1 LINKS", "because", "2026-01-01T00:00:00Z")
    one = after.notes.where("note_id = 1").first()
    assert one["links"] == ["Three"] and one["relationships"][0]["target"] == "Three" and one["relationships"][0]["explanation"] == "because"
    assert after.notes.where("note_id = 2").first()["links"] is None
    assert {r["id"]: r["status"] for r in left.collect()} == {1: "confirmed", 2: "rejected"}
    for ids, phrase in (([1], "confirm"), ([1, 2], "CONFIRM 2 LINKS")):
        with pytest.raises(ValueError):
            api.confirm_discoveries(vault, stored, ids, phrase, "x", "y")
    moved = api.review_discoveries(stored, spark.createDataFrame([(1, "investigating"), (2, "investigating")], "id bigint, to string"))
    assert {(r["id"], r["status"], r["applied"]) for r in moved.collect()} == {(1, "investigating", True), (2, "rejected", False)}


def test_questions_findings_and_proposals(spark, vault):
    answer = api.ask(vault, "What is first?", lambda p: '{"answer": "it", "citations": [1]}' if "[1] One" in p else "none").first()
    assert (answer["answer"], answer["cited"], answer["error"]) == ("it", [1], None)
    assert api.ask(vault, "What is first?", lambda p: '{"answer": "it", "citations": [77]}').first()["answer"] is None
    saved = api.save_answer(vault, 50, "Answer", "it", [1])
    assert {tuple(r) for r in saved.provenance.where("note_id = 50").collect()} == {(50, 7, "reference")}
    found = api.lint_analyze(vault, lambda p: '{"findings": [{"severity": "info", "message": "m", "pageIds": [1]}, {"severity": "x", "message": "m", "pageIds": [1]}]}')
    assert [(r["severity"], r["pages"]) for r in found.collect()] == [("info", [1])]
    stored = spark.createDataFrame([(1, "pending", AT), (2, "applied", AT)], "proposal_id bigint, status string, created_at timestamp")
    assert [r["proposal_id"] for r in api.proposals(stored).collect()] == [2, 1] and api.proposals(stored, "open").count() == 1
    assert {tuple(r) for r in api.reject_proposal(stored.withColumnRenamed("proposal_id", "id"), 2).select("id", "status").collect()} == {(1, "pending"), (2, "applied")}
    draft = spark.createDataFrame([(1, True)], "change_id bigint, include boolean")
    assert [tuple(r) for r in api.draft_proposal(draft, draft.withColumn("include", F.lit(False))).collect()] == [(1, False)]
    grown = api.rebuild_semantic(api.replace(vault, vectors=vault.vectors.where("id < 3")), lambda ts: [[1.0, 2.0] for _ in ts], 2)
    assert grown.vectors.count() == 3 and grown.links.columns == ["source_note_id", "target_note_id", "similarity"]


def test_a_deleted_page_takes_all_with_it(spark, vault):
    after = lifecycle.deleted(api._catalogue(vault), spark.createDataFrame([(2,), (None,)], "note_id bigint"))
    assert texts(after) == {1: "first", 3: "third"} and after.links.count() == 0 and after.provenance.count() == 2 and after.vectors.count() == 2


def test_a_journal_goes_forward_after_a_crash_and_back(spark, tmp_path):
    folder, journal = str(tmp_path / "vault"), str(tmp_path / "journal")
    integrity.write_files(spark.createDataFrame([("notes/a.md", "a"), ("notes/b.md", "b")], "path string, content string"), folder)
    changes = spark.createDataFrame([("notes/a.md", "a", "A"), ("notes/b.md", "b", None), ("notes/c.md", None, "C")], "path string, before string, after string")
    read = lambda: {p.name: p.read_text() for p in (tmp_path / "vault" / "notes").glob("*.md")}
    integrity.prepare_operation(changes, journal)
    (tmp_path / "vault" / "notes" / "c.md").write_text("C")  # a crash after the first file
    assert integrity.complete_operation(spark, folder, journal) == 2 and read() == {"a.md": "A", "c.md": "C"}
    integrity.prepare_operation(changes, journal)
    assert integrity.complete_operation(spark, folder, journal, back=True) == 3 and read() == {"a.md": "a", "b.md": "b"}
    integrity.prepare_operation(changes, journal)
    (tmp_path / "vault" / "notes" / "a.md").write_text("edited")
    with pytest.raises(RuntimeError):
        integrity.complete_operation(spark, folder, journal)
    assert read() == {"a.md": "edited", "b.md": "b"}
