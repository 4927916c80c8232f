"""The contract: every query has a result at the smallest scale, and SQL names belong to queries."""

import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).columns == ["note_id", "title", "rank"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["g1_graph_edges", "h4_question_context", "p3_found", "r5_stream_ledger", "t2_chunks", "v9_mutual_links"])
def test_queries_run(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["a20_snapshot_hash", "i4_rebuild", "i6_undo", "i14_approve", "i16_attach_provenance", "i20_link_migration", "j20_primary_source", "m10_log_entry", "s11_archive_scan", "t18_page_slice"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    frame = entry.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = [tuple(row[names.index(c)] for c in columns) for row in found.fetchall()]
    assert sorted(names) == columns and sorted(map(str, (tuple(r) for r in frame.select(*columns).collect()))) == sorted(map(str, want))
