"""Texts, Markdown, integrity, chunks and streams."""

import io
import tarfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import markdown as M
from tessera.functions import notes_text as X
from tessera.operators import chunking, integrity
from tessera.streaming import arrivals


def one(spark, text, f, kind="string"):
    return spark.createDataFrame([(text,)], f"t {kind}").select(f(F.col("t"))).first()[0]


def test_scalar_texts(spark):
    assert one(spark, "## A **bold** [link](x) ![i](y) [[Page]] <b>z</b>", X.plain_text) == "A bold link i Page z"
    assert one(spark, "Ärger & Straße — 2!", X.slug) == "rger-stra-e-2"
    assert one(spark, [8, 1, 2, 3, 5, 9, 10, 0, None, 3], X.page_ranges, "array<int>") == "1–3, 5, 8–10"
    assert one(spark, [" A", "a", "", None, "b ", "B"], X.distinct_ignoring_case, "array<string>") == ["A", "b"]
    assert one(spark, "word " * 80, lambda c: X.excerpt(c, 20)) == "word word word word…"
    assert one(spark, "x" * 300, lambda c: X.excerpt(c, 20)) == "x" * 19 + "…"
    assert one(spark, None, X.plain_text) is None


def test_urls(spark):
    video = "https://www.youtube.com/watch?v=abcdefghijk"
    for given_url in ("abcdefghijk", video + "&t=3", "https://youtu.be/abcdefghijk?x=1", "https://m.youtube.com/shorts/abcdefghijk", "https://youtube.com/embed/abcdefghijk"):
        assert one(spark, given_url, X.video_url) == video
    for bad in ("http://youtu.be/abcdefghijk", "https://evil.example/watch?v=abcdefghijk", "https://youtube.com/watch?v=short", "", None):
        assert one(spark, bad, X.video_url) is None
    assert one(spark, "https://www.youtube.com/playlist?list=PL12", X.playlist_url).endswith("list=PL12")


def test_paths_and_decoding(spark):
    for path, ok in (("notes/a.md", True), ("../a", False), ("/a", False), ("a//b", False), ("a/./b", False), ("a\\b", False), (None, False)):
        assert one(spark, path, X.safe_relative_path) is ok
    assert one(spark, bytearray("﻿a\r\nb ".encode()), X.decoded, "binary") == "a\nb"
    assert one(spark, bytearray(b"\xff\xfe"), X.decoded, "binary") is None


PAGE = "title string, type string, tags array<string>, links array<string>, body string, sources array<struct<title:string,url:string,pages:array<int>,content_hash:string>>"


def test_page_round_trip_and_claims(spark):
    h = "a" * 64
    rows = [('Quote "x" \\ é', "concept", ["t"], ["Other"], "First claim.\n\nSecond claim.", [("S [1]", "https://e.example/a>b", [3, 1], h)])]
    page = spark.createDataFrame(rows, PAGE).select(M.render_page(*(F.col(c) for c in ("title", "type", "tags", "links", "body", "sources"))).alias("m"))
    row = page.select("m", M.parsed_page(F.col("m")).alias("p"), M.source_hashes(F.col("m")).alias("h"), M.claim_citations(F.col("m")).alias("c"), M.source_pages(F.col("m"), F.lit(h)).alias("pages")).first()
    assert (row["p"]["title"], row["p"]["links"], row["p"]["body"]) == (rows[0][0], ["Other"], rows[0][4])
    assert row["h"] == [h] and [c["text"] for c in row["c"]] == ["First claim.", "Second claim."] and row["c"][0]["hashes"] == [h]
    assert row["pages"] == [1, 3]
    assert one(spark, "no front matter", M.parsed_page) is None


def test_captions(spark):
    text = "WEBVTT\nKind: captions\n\n00:01.000 --> 00:02.000 align:start\n<c>Hello</c> world\nHello world\n\n00:02.000 --> 00:03.000\nSecond idea\nHello world"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id bigint, t string")
    assert [(r["id"], r["text"]) for r in chunking.caption_text(df, "id", "t").collect()] == [(1, "Hello world Second idea Hello world")]


def test_balanced_chunks():
    text = "This sentence is forty characters long. " * 301
    parts = chunking.balanced_chunks(text, 12_000, 500)
    assert len(parts) == 2 and all(len(p) > 5_000 for p in parts) and abs(len(parts[0]) - len(parts[1])) < 1_000
    assert parts[0].rstrip().endswith(".")
    paged = "## PDF page 1\n\n" + "word " * 100 + "\n\n## PDF page 2\n\n" + "more " * 100
    assert chunking.balanced_chunks(paged, 400, 50)[-1].startswith("## PDF page 2 (continued)\n\n")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(20, 60), st.integers(0, 10))
def test_chunks_cover_the_text(text, limit, overlap):
    parts = chunking.balanced_chunks(text, limit, overlap)
    at = 0
    for p in parts:
        start = text.find(p, max(0, at - overlap - 1))
        assert start <= at
        at = max(at, start + len(p))
    assert all(len(p) <= limit for p in parts) and "".join(parts).count("b") >= text.count("b")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_line_diff_rebuilds_both_sides(a, b):
    before, after = "\n".join(a), "\n".join(b)
    diff = chunking.line_diff(before, after)
    assert "\n".join(t for k, t in diff if k != "add") == before
    assert "\n".join(t for k, t in diff if k != "remove") == after


def test_journal_undo_and_diff(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    after = spark.createDataFrame([("a", "2"), ("b", "1"), ("d", "1")], "path string, hash string")
    diff = integrity.snapshot_diff(before, after)
    assert {(r["path"], r["change"]) for r in diff.collect()} == {("a", "changed"), ("c", "removed"), ("d", "new")}
    journal = diff.select("path", F.col("before_hash").alias("before"), F.col("after_hash").alias("after"))
    now = spark.createDataFrame([("a", "2"), ("c", "9")], "path string, hash string")
    steps = integrity.classify_journal(journal, now)
    assert {tuple(r) for r in steps.collect()} == {("a", "done"), ("c", "conflict"), ("d", "apply")}
    assert not integrity.may_commit(steps)


def test_export_and_snapshots(spark, tmp_path):
    long = "d" * 90 + "/" + "f" * 50
    files = spark.createDataFrame([("b", bytearray(b"1")), (long, bytearray(b"22")), ("../x", bytearray(b"")), ("z" * 300, bytearray(b""))], "path string, content binary")
    rows = integrity.export_manifest(files).collect()
    assert [(r["path"], r["size"], r["prefix"]) for r in rows] == [("b", 1, ""), (long, 2, "d" * 90)]
    out = io.BytesIO()
    assert integrity.write_archive(rows, lambda p: b"x" * 3, out) == 2
    out.seek(0)
    assert tarfile.open(fileobj=out).getnames() == ["b", long]
    folder = str(tmp_path / "table")
    integrity.replace_snapshot(files.limit(1), folder, "1")
    integrity.replace_snapshot(files.limit(2), folder, "2")
    assert integrity.current_snapshot(spark, folder).count() == 2
    with pytest.raises(Exception):
        integrity.replace_snapshot(files, folder, "2")


def test_archive_scans(spark, tmp_path):
    import hashlib
    import json

    good = hashlib.sha256(b"text").hexdigest()
    for name, digest in ((good, good), ("b" * 64, "b" * 64)):
        d = tmp_path / "sources" / name
        d.mkdir(parents=True)
        (d / "meta.json").write_text(json.dumps({"contentHash": digest, "title": "T", "sourceUrl": "", "sourceType": "text"}))
        (d / "source.txt").write_bytes(b"text")
    got = {r["content_hash"]: r["problem"] for r in integrity.archived_sources(spark, str(tmp_path)).collect()}
    assert got == {good: None, "b" * 64: "hash_mismatch"}
    (tmp_path / "sources" / good / "extra.bin").write_bytes(b"x")
    assert {r["problem"] for r in integrity.archived_sources(spark, str(tmp_path), strict=True).collect()} == {"unexpected_file", "hash_mismatch"}
    with pytest.raises(ValueError):
        integrity.archived_sources(spark, str(tmp_path), most=1)
    with pytest.raises(ValueError):
        integrity.archived_sources(spark, str(tmp_path), most_bytes=10)
    when = spark.createDataFrame([("b" * 64, "2025-01-01")], "source_hash string, applied_at string")
    assert [r["content_hash"] for r in integrity.in_archive_order(integrity.archived_sources(spark, str(tmp_path)), when).collect()] == ["b" * 64, good]
    (tmp_path / "log.md").write_text(f"## x\n- Source SHA-256: `{good}`\n- Source SHA-256: `{good}`\n")
    assert [r[0] for r in integrity.logged_hashes(spark, str(tmp_path / "log.md")).collect()] == [good]
    (tmp_path / "history" / "h1").mkdir(parents=True)
    (tmp_path / "history" / "h1" / "manifest.json").write_text(json.dumps({"historyId": "h1", "proposalId": 1, "sourceHash": good, "appliedAt": "2025-01-01T00:00:00.000Z", "changes": [{"action": "new", "pageTitle": "P", "afterHash": good}]}))
    row = integrity.history_manifests(spark, str(tmp_path)).first()
    assert (row["historyId"], row["action"], row["applied_at"].year) == ("h1", "new", 2025)


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "content_hash string, n int").write.parquet(str(tmp_path / "arrivals.parquet"))
    stream = arrivals.stream_table(spark, str(tmp_path), "arrivals")
    assert sorted(r[0] for r in arrivals.run_to_table(arrivals.new_sources(stream).select("content_hash")).collect()) == ["a", "b"]
    assert arrivals.admission(set(), [], "x") == "start"
    assert arrivals.admission({"x"}, [], "x") == "refuse"
    assert arrivals.admission({"x"}, ["a", "b", "c", "d"], "y") == "refuse"
