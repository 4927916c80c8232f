"""The interface functions, ingest, validation and providers."""

import pytest
from pyspark.sql import functions as F

from tessera import api
from tessera.functions import validation as VA
from tessera.operators import ingest, providers

REL = "array<struct<target:string,type:string,explanation:string,significance:string,pageHashes:array<string>,confirmedAt:string>>"
NOTE = f"note_id bigint, title string, type string, body string, tags array<string>, links array<string>, relationships {REL}, created_at timestamp"


@pytest.fixture(scope="module")
def vault(spark):
    rows = [(1, "Mechanism evidence", "concept", "The kinase mechanism is reported here.", [], ["Related assay"], None, None), (2, "Related assay", "concept", "An assay of binding.", [], [], None, None), (3, "Other", "entity", "Nothing in common.", [], [], None, None)]
    vec = [(i, [float(i == k) for k in (1, 2, 3)]) for i in (1, 2, 3)]
    return api.Vault(
        spark.createDataFrame(rows, NOTE), spark.createDataFrame([(7, "h", "S", None, "text")], "source_id bigint, content_hash string, title string, source_url string, source_type string"),
        spark.createDataFrame([(1, 7, "new"), (2, 7, "merge")], "note_id bigint, source_id bigint, action string"), spark.createDataFrame(vec, "id bigint, v array<float>"),
        spark.createDataFrame([(2, 3, 0.5)], "source_note_id bigint, target_note_id bigint, similarity double"),
    )


def test_search_modes(spark, vault):
    assert [r["note_id"] for r in api.search(vault, "kinase mechanism", "keyword").collect()] == [1]
    assert api.search(vault, "  ", "hybrid").count() == 0
    found = {r["note_id"]: r["match_type"] for r in api.search(vault, "kinase mechanism", "hybrid", [1.0, 0.0, 0.0]).collect()}
    assert found[1] == "both" and found[2] == "semantic"
    assert {r["match_type"] for r in api.search(vault, "kinase", "hybrid").collect()} == {"keyword"}
    with pytest.raises(api.IncompleteIndex):
        api.search(vault, "kinase", "semantic")
    with pytest.raises(ValueError):
        api.search(vault, "x" * 501)
    with pytest.raises(ValueError):
        api.search(vault, "x", "other")


def test_pages_sources_and_context(vault):
    assert [r["note_id"] for r in api.question_context(vault, "What kinase mechanism is reported?").collect()] == [1, 2]
    assert api.sources(vault).first()["pages"] == 2
    assert [r["note_id"] for r in api.source_detail(vault, 7).collect()] == [1, 2]
    assert api.note_detail(vault, 1).first()["evidence"][0]["action"] == "new"
    assert api.note_by_title(vault, "related ASSAY").first()["note_id"] == 2
    assert [r["other"] for r in api.related(vault, 2).collect()] == [1, 3]
    assert {r["code"] for r in api.lint_report(vault).collect()} == {"missing_provenance", "orphan_page"}
    assert {r["code"] for r in api.verify(vault).collect()} == {"missing_provenance"}


def test_files_and_playlists(spark):
    rows = [("a/My_note-one.md", bytearray("﻿Hi\r\n".encode())), ("b.pdf", bytearray(b"%PDF")), ("c.txt", bytearray(b"\xff")), ("d.exe", bytearray(b"x")), ("e.txt", bytearray(b" "))]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r["title"]: (r["source_type"], r["text"], r["problem"]) for r in ingest.files(df, pdf=lambda b: ["one", "", "three"]).collect()}
    assert got["My note one"] == ("markdown", "Hi", None)
    assert got["b"] == ("pdf", "## PDF page 1\n\none\n\n## PDF page 3\n\nthree", None)
    assert got["c"][2] == "not_utf8_or_empty" and got["d"][2] == "unknown_type" and got["e"][2] == "not_utf8_or_empty"
    assert {r["problem"] for r in ingest.files(df.where("path = 'b.pdf'")).collect()} == {"no_text"}
    lists = spark.createDataFrame([(1, ["abcdefghijk", "https://youtu.be/abcdefghijk", "bad", None, "ABCDEFGHIJK"])], "id int, v array<string>")
    assert ingest.expanded_playlist(lists, "id", "v").count() == 2


def test_review_and_confirmation(spark):
    notes = spark.createDataFrame([(1, ["B"]), (2, None)], "note_id bigint, links array<string>")
    renames = spark.createDataFrame([("b", "New B"), ("zz", "Z")], "from_title string, to_title string")
    assert {r["note_id"]: r["links"] for r in ingest.rewritten_links(notes, renames).collect()} == {1: ["New B"], 2: []}
    more = spark.createDataFrame([(1, "C"), (1, "b"), (2, "D")], "note_id bigint, title string")
    assert {r["note_id"]: r["links"] for r in ingest.confirmed(notes, more).collect()} == {1: ["B", "C"], 2: ["D"]}
    known = spark.createDataFrame([(1, "T", "x", "concept"), (2, "U", "y", "concept")], "note_id bigint, title string, body string, type string")
    fresh = spark.createDataFrame([(2, "U", "z"), (3, "V", "w")], "note_id bigint, title string, body string")
    assert {(r["note_id"], r["body"]) for r in ingest.applied(known, fresh).collect()} == {(1, "x"), (2, "z"), (3, "w")}


def test_validation(spark):
    page = "title string, type string, body string, tags array<string>, links array<string>"
    rows = [("T", "concept", "b", [], []), ("", "x", None, ["t"] * 13, ["l"] * 51), ("a\x01", "entity", "b\n", None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, page).select(VA.page_problems(*(F.col(c) for c in ("title", "type", "body", "tags", "links")))).collect()]
    assert got == [[], ["title", "type", "body", "tags", "links"], ["title"]]
    ids = spark.createDataFrame([([1, 2, 2],), ([0],), ([],), (None,)], "v array<bigint>")
    assert [r[0] for r in ids.select(VA.positive_ids(F.col("v"))).collect()] == [[1, 2], None, None, None]
    rel = spark.createDataFrame([([("B", "supports", "2025-01-01T00:00:00Z", "1"), ("b", "supports", "2025-01-01T00:00:00Z", "2"), ("B", "odd", "2025-01-01T00:00:00Z", "3"), ("X", "supports", "2025-01-01T00:00:00Z", "4")], ["B"])], "r array<struct<target:string,type:string,confirmedAt:string,n:string>>, links array<string>")
    assert [x["n"] for x in rel.select(VA.clean_relationships(F.col("r"), F.col("links"))).first()[0]] == ["2"]


def test_providers(spark):
    df = spark.createDataFrame([(1, "same words"), (2, "same words"), (3, None)], "note_id bigint, text string")
    got = {r["note_id"]: r["vector"] for r in providers.embedded(df, "note_id", "text", providers.hashed_embedder(16), 16).collect()}
    assert got[1] == got[2] and len(got) == 2
    assert {r["vector"] for r in providers.embedded(df, "note_id", "text", lambda t: [[1.0]] * len(t), 16).collect()} == {None}
    assert providers.json_object('x ```json\n{"a": [1, 2,], "b": "c,}"}\n``` y') == {"a": [1, 2], "b": "c,}"}
    with pytest.raises(ValueError):
        providers.json_object("none")
    replies = spark.createDataFrame([(1, '{"answer":" yes ","citations":[2,2]}'), (2, '{"answer":"x","citations":[9]}'), (3, "junk")], "id bigint, reply string")
    ctx = F.array(F.lit(2).cast("bigint"), F.lit(3).cast("bigint"))
    assert {r["id"]: r["a"] and (r["a"]["answer"], r["a"]["cited"]) for r in replies.select("id", providers.valid_answer(F.col("reply"), ctx).alias("a")).collect()} == {1: ("yes", [2]), 2: None, 3: None}
    said = spark.createDataFrame([(1, '{"suggestions":[{"index":0,"type":"supports","explanation":"e","confidence":0.5},{"index":0,"type":"supports","explanation":"f","confidence":0.6},{"index":7,"type":"supports","explanation":"e","confidence":0.5}]}')], "id bigint, reply string")
    assert [(r["index"], r["explanation"]) for r in providers.valid_suggestions(said, 2, ("supports",)).collect()] == [(0, "e")]
    asked = providers.asked(spark.createDataFrame([(1, "p")], "id bigint, prompt string"), "id", "prompt", lambda p: '{"ok": true}')
    assert asked.first()["reply"] == '{"ok": true}'
    inc = spark.createDataFrame([(1,), (2,), (3,)], "incoming_id bigint")
    rep = spark.createDataFrame([(1, "merge", 5), (2, "merge", 6)], "incoming_id bigint, action string, existing_id bigint")
    cand = spark.createDataFrame([(1, 5)], "incoming_id bigint, existing_id bigint")
    assert {tuple(r) for r in providers.completed_decisions(inc, rep, cand).collect()} == {(1, "merge", 5), (2, "new", None), (3, "new", None)}
