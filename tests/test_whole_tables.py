"""Registered queries take whole tables: small tables with rows that a subset would leave out."""

import hashlib
import json

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import discovery, duplicates, maintenance
from tessera.operators.ranking import ranked


def run(spark, folder, name, **tables):
    """Rows of a registered query over tables given as (rows, schema)."""
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    return entry.queries()[name](spark, str(folder)).collect()


HELD = "note_id bigint, source_id bigint, action string"


def test_provenance_of_odd_notes_is_attached(spark, tmp_path):
    got = run(spark, tmp_path, "i16_attach_provenance", note_sources=([(1, 5, "new"), (1, 6, "new"), (2, 5, "new"), (None, 6, "new")], HELD))
    assert {tuple(r) for r in got} == {(1, 5, "merge"), (1, 6, "new"), (2, 5, "merge")}


def test_page_slice_of_a_whole_transcript(spark, tmp_path):
    text = "## PDF page 1\n\n" + "word " * 2000 + "\n\n## PDF page 2\n\nmore\n\n\\## PDF page 3\n\nend"
    rows = [(1, f"\n{text} \n", "pdf"), (2, "x" * 60, "pdf"), (3, text, "text")]
    got = run(spark, tmp_path, "t18_page_slice", ingest_results=(rows, "ingest_id bigint, transcript string, source_type string"))
    assert {tuple(r) for r in got} == {(1, text), (2, "x" * 60)}


NOTES = "note_id bigint, title string, type string, body string"


def test_index_lines_hold_the_summary(spark, tmp_path):
    rows = [(1, "B", "concept", "b " * 150), (2, "a", "concept", "Short  enough to be kept\nwhole"), (3, "C", "entity", ""), (4, "Édit", "concept", "x"), (5, "eel", "concept", "y"), (6, "a", "concept", "z"), (7, "Q", "other", "q")]
    got = run(spark, tmp_path, "m9_index", notes=(rows, NOTES))
    assert {r["line"] for r in got} == {"- [[a]] — Short enough to be kept whole", "- [[B]] — " + ("b " * 99)[:197].rstrip() + "…", "- [[Édit]] — x", "- [[eel]] — y", "- [[a]] — z"}
    assert {(r["heading"], r["pages"]) for r in got} == {("## Concepts", 5)}
    lines = maintenance.index_lines(spark.createDataFrame(rows, NOTES)).orderBy("section", "position").collect()
    assert [(r["position"], r["line"][4:7].strip("]")) for r in lines] == [(1, "a"), (2, "a"), (3, "B"), (4, "Édi"), (5, "eel")]


def test_ranks_of_large_small_and_null_groups(spark):
    rows = [(g, n) for n in range(300) for g in ([1] if n % 3 else [1, 2, None])]
    got = ranked(spark.createDataFrame(rows, "g int, n int"), ["g"], [F.desc("n")], "at", partitions=7).collect()
    want = {}
    for g in (1, 2, None):
        want.update({(g, n): at for at, n in enumerate(sorted((n for k, n in rows if k == g), reverse=True), 1)})
    assert {(r["g"], r["n"]): r["at"] for r in got} == want and len(got) == len(rows)
    whole = ranked(spark.createDataFrame(rows, "g int, n int"), [], [F.col("n"), F.col("g")], "at", partitions=5).orderBy("at").collect()
    assert [r["at"] for r in whole] == list(range(1, len(rows) + 1)) and [r["n"] for r in whole] == sorted(n for _, n in rows)
    assert ranked(spark.createDataFrame([], "g int, n int"), ["g"], [F.col("n")]).count() == 0


def test_first_row_of_hot_keys(spark):
    rows = [("h", i, f"t{i}") for i in range(50, 0, -1)] + [("k", 7, None), (None, 1, "n")]
    got = duplicates.keep_first(spark.createDataFrame(rows, "hash string, id int, text string"), "hash", "id").collect()
    assert {tuple(r) for r in got} == {("h", 1, "t1", 50), ("k", 7, None, 1), (None, 1, "n", 1)}


def test_snapshot_hash_is_that_of_the_json_list(spark):
    rows = [(i, f"{i:064x}") for i in (5, 1, 2500, 999, 1000)]
    text = json.dumps([[i, h] for i, h in sorted(rows)], separators=(",", ":"))
    frame = spark.createDataFrame(rows, "note_id bigint, evidence_hash string")
    assert discovery.snapshot_hash(frame).first()[0] == hashlib.sha256(text.encode()).hexdigest()
    assert discovery.snapshot_hash(frame.limit(0)).first()[0] == hashlib.sha256(b"[]").hexdigest()


def test_quota_counts_pairs_that_are_left(spark):
    near = [(1, 100 + i, 0.9 - i / 100, i + 1) for i in range(20)]
    notes = [(1, "one", "alpha")] + [(100 + i, f"t{i}", f"body{i}") for i in range(20)] + [(300, "far", "alpha")]
    sources = [(n, n) for n, _, _ in notes] + [(100, 1)]
    known = [(101 + i, 1) for i in range(9)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = discovery.candidates(
        frame(near, "left_id bigint, right_id bigint, similarity double, position int"), frame([(1, 300)], "seed_id bigint, note_id bigint"), frame(notes, "note_id bigint, title string, body string"),
        frame(sources, "note_id bigint, source_id bigint"), frame(known, "l bigint, r bigint"),
    )
    # 100 shares a source, 101 to 109 are known: the eight nearest of the others, and the lexical hit.
    assert {r["right_id"] for r in got.collect()} == {*range(110, 118), 300}


def test_every_decided_note_is_safeguarded(spark, tmp_path):
    rows = [(1, "Length of stay", "concept", "Plain"), (2, "Something else", "concept", "Other"), (3, "Length of stay", "concept", "Words")]
    got = run(spark, tmp_path, "d7_decisions", notes=(rows, NOTES), links=([(2, 3)], "source_note_id bigint, target_note_id bigint"))
    assert [tuple(r) for r in got] == [(3, "merge", 1)]


def test_sources_of_any_page(spark, tmp_path):
    sources = ([(5, "A"), (6, "B"), (7, "C")], "source_id bigint, title string")
    got = run(spark, tmp_path, "j2_sources_of_pages", sources=sources, note_sources=([(1, 5, "new"), (50, 6, "new"), (2, None, "new")], HELD))
    assert {tuple(r) for r in got} == {(5, "A"), (6, "B")}
