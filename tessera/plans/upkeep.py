"""Registered queries on upkeep of derived tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import notes_text as X
from tessera.operators import lexical, maintenance
from tessera.plans.knowledge import EV, FPS, PAIRS, ST, stored
from tessera.plans.records import cut_sql, plain_sql
from tessera.plans.retrieval import NS, N, V, note_rows, note_sources, note_vectors, notes, seeds, sql_candidates
from tessera.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {V} SELECT id, len(v) AS dims FROM v WHERE id % 3 <> 0 UNION ALL SELECT id, 0 FROM v WHERE id % 3 = 0")
def v3_upsert_vectors(spark, sf_dir):
    rows = note_vectors(spark, sf_dir).select("id", F.size("v").cast("bigint").alias("dims"))
    return maintenance.upsert(rows, rows.where("id % 3 = 0").withColumn("dims", F.lit(0).cast("bigint")), "id")


@query(f"WITH {N}, {V} SELECT note_id FROM n WHERE note_id NOT IN (SELECT id FROM v) ORDER BY note_id LIMIT 20")
def v7_next_to_embed(spark, sf_dir):
    return maintenance.next_to_embed(notes(spark, sf_dir).select("note_id"), note_vectors(spark, sf_dir), 20)


@query(
    f"""WITH {N}, {NS}, {EV}, {PAIRS}, {FPS}, {ST}, o AS (SELECT fingerprint, CASE WHEN ascii(fingerprint) % 2 = 0 THEN 'proposed' ELSE 'reviewed' END AS s FROM stored WHERE ascii(fingerprint) % 3 > 0)
  SELECT fingerprint, CASE WHEN status = 'queued' AND s IS NOT NULL THEN s ELSE status END AS status FROM stored LEFT JOIN o USING (fingerprint)"""
)
def c12_recorded_outcomes(spark, sf_dir):
    old = stored(spark, sf_dir)[0].select("fingerprint", "status", F.lit(None).cast("bigint").alias("discovery_id"))
    code = F.ascii("fingerprint")
    outcomes = old.where(code % 3 > 0).select("fingerprint", F.when(code % 2 == 0, "proposed").otherwise("reviewed").alias("status"), F.when(code % 2 == 0, F.lit(1).cast("bigint")).alias("discovery_id"))
    return maintenance.recorded(old, outcomes).select("fingerprint", "status")


_EX = lambda text, limit, least: f"(SELECT {cut_sql('t', 'hd', limit, least, limit - 1)} FROM (SELECT t, substr(t, 1, {limit}) AS hd FROM (SELECT {plain_sql(text)} AS t)))"


@query(
    f"""WITH {N}, {NS}, f AS (SELECT source_id, note_id, row_number() OVER (PARTITION BY source_id ORDER BY note_id) AS p, count(*) OVER (PARTITION BY source_id) - 3 AS more, {_EX("coalesce(title, '')", 120, 84)} AS a, {_EX("coalesce(body, '')", 260, 182)} AS b FROM ns JOIN n USING (note_id))
  SELECT source_id, 'Key findings: ' || string_agg(a || ' — ' || b, ' ' ORDER BY p) || CASE WHEN max(more) > 1 THEN ' ' || max(more) || ' additional findings captured.' WHEN max(more) = 1 THEN ' 1 additional finding captured.' ELSE '' END AS summary FROM f WHERE p <= 3 GROUP BY source_id"""
)
def t7_source_summary(spark, sf_dir):
    base = notes(spark, sf_dir).select("note_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "body")))
    rows = note_sources(spark, sf_dir).join(base, "note_id").select("source_id", F.col("note_id").alias("position"), "title", "body")
    return maintenance.source_summaries(rows)


@query("WITH i AS (SELECT ingest_id, min(transcript) AS t FROM ingest_results WHERE source_type = 'pdf' AND transcript <> '' GROUP BY 1) SELECT ingest_id, trim(t, chr(10) || ' ') AS page FROM i")
def t18_page_slice(spark, sf_dir):
    rows = table(spark, sf_dir, "ingest_results").where("source_type = 'pdf' and transcript <> ''").groupBy("ingest_id").agg(F.min("transcript").alias("t"))
    # The whole transcript is one page: its own page markers are text here, so they are quoted by a backslash around the slice.
    quoted = F.regexp_replace("t", r"(?m)^(\\*## PDF page )", r"\\$1")
    paged = F.concat(F.lit("## PDF page 1\n\nfirst\n\n## PDF page 2\n\n"), quoted, F.lit("\n\n## PDF page 3\n\nlast"))
    page = F.regexp_replace(maintenance.page_slice(paged, 2), r"(?m)^\\(\\*## PDF page )", "$1")
    return rows.select("ingest_id", F.regexp_replace(page, "^[\n ]+|[\n ]+$", "").alias("page"))


@query(
    "SELECT event_type, count(*) AS events, CASE event_type WHEN 'click' THEN 'todo' ELSE 'done' END AS review FROM (SELECT * FROM events WHERE event_type IN ('click', 'purchase')) GROUP BY 1"
)
def t21_step_states(spark, sf_dir):
    stage = F.when(F.col("event_type") == "click", "extracting").otherwise("applied")
    rows = table(spark, sf_dir, "events").where("event_type in ('click', 'purchase')").groupBy("event_type").agg(F.count("*").alias("events"))
    return rows.select("event_type", "events", maintenance.step_states(stage)["review"].alias("review"))


@query(f"WITH {N}, {NS}, a AS (SELECT note_id, source_id, min(action) AS action FROM note_sources WHERE note_id IS NOT NULL AND source_id IS NOT NULL AND action IS NOT NULL AND source_id % 2 = 0 GROUP BY 1, 2) SELECT note_id, source_id, coalesce(action, 'reference') AS action FROM ns LEFT JOIN a USING (note_id, source_id)")
def j19_rebuilt_provenance(spark, sf_dir):
    known = table(spark, sf_dir, "note_sources").where("note_id is not null and source_id is not null and action is not null and source_id % 2 = 0").groupBy("note_id", "source_id").agg(F.min("action").alias("action"))
    return maintenance.rebuilt_provenance(note_sources(spark, sf_dir), known)


@query(f"WITH {N}, {sql_candidates(8)}, r AS (SELECT seed_id, note_id, row_number() OVER (PARTITION BY seed_id ORDER BY round(score, 9) DESC, note_id) AS p FROM ic), f AS (SELECT note_id, min((seed_id, p)) AS o FROM r GROUP BY 1) SELECT note_id FROM f ORDER BY o, note_id LIMIT 40")
def d9_candidate_pool(spark, sf_dir):
    base = note_rows(spark, sf_dir)
    return maintenance.candidate_pool(lexical.integration_candidates(base, seeds(base), limit=8)).select("note_id")


@query(f"WITH {N} SELECT note_id, regexp_extract(replace('C:\\vault\\' || file_path, '\\', '/'), '^(?:.*/)?((?:notes|sources)/.+)$', 1) AS path FROM n WHERE file_path LIKE 'notes/%'")
def i23_portable_paths(spark, sf_dir):
    rows = notes(spark, sf_dir).where("file_path like 'notes/%'")
    return rows.select("note_id", maintenance.portable_path(F.concat(F.lit("C:\\vault\\"), "file_path")).alias("path"))


@query(
    f"""WITH {N}, {NS}, c AS (SELECT source_id, note_id, '- create ' || type || ': [[' || title || ']]' AS line, created_at FROM ns JOIN n USING (note_id) WHERE title IS NOT NULL AND type IS NOT NULL),
  e AS (SELECT source_id, min(created_at) AS t FROM c GROUP BY 1)
  SELECT source_id, 1 AS line_no, '## [' || strftime(t, '%Y-%m-%dT%H:%M:%S') || 'Z] ingest | source ' || source_id AS line FROM e
  UNION ALL SELECT source_id, 2, '- Source SHA-256: `' || sha256(source_id::VARCHAR) || '`' FROM e
  UNION ALL SELECT source_id, 2 + row_number() OVER (PARTITION BY source_id ORDER BY note_id), line FROM c"""
)
def m10_log_entry(spark, sf_dir):
    rows = note_sources(spark, sf_dir).join(notes(spark, sf_dir).where("title is not null and type is not null").select("note_id", "title", "type", "created_at"), "note_id")
    entries = rows.groupBy("source_id").agg(F.min("created_at").alias("at")).withColumns({"subject": F.concat(F.lit("source "), F.col("source_id").cast("string")), "content_hash": F.sha2(F.col("source_id").cast("string"), 256)})
    return maintenance.log_lines(entries, rows.withColumn("action", F.lit("create")), "source_id", "ingest")


@query("WITH i AS (SELECT DISTINCT source_id, source_url FROM sources WHERE source_url IS NOT NULL) SELECT CASE WHEN regexp_matches(trim(source_url, ' '), '^[A-Za-z0-9_-]{11}$') THEN 'video' ELSE 'text' END AS kind, count(*) AS inputs FROM i GROUP BY 1")
def t13_input_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "sources").where("source_url is not null").select("source_id", "source_url").distinct()
    return rows.groupBy(X.input_kind(F.col("source_url")).alias("kind")).agg(F.count("*").alias("inputs"))


@query(f"WITH {N}, s AS (SELECT note_id, list_sort(list_distinct(links)) AS a, list_sort(list_distinct(list_transform(relationships, lambda r: r.target))) AS b FROM n) SELECT note_id, a = b AS same FROM s WHERE a IS NOT NULL AND b IS NOT NULL")
def so4_set_equality(spark, sf_dir):
    rows = notes(spark, sf_dir).select("note_id", F.array_compact("links").alias("a"), F.array_compact("relationships.target").alias("b"))
    return rows.where("a is not null and b is not null").select("note_id", maintenance.same_members(F.col("a"), F.col("b")).alias("same"))
