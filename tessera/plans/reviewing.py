"""Registered queries on validation, review, confirmation and interface projections, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import notes_text as X
from tessera.functions import validation as VA
from tessera.operators import discovery, graph, ingest, integrity, lifecycle, providers
from tessera.operators.ranking import ranked
from tessera.plans.knowledge import DI, EV, discoveries
from tessera.plans.records import FIRST_SOURCE, HI, SRC, history, primary_sources, sources
from tessera.plans.retrieval import GE, NS, N, edges, note_sources, notes
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


TYPES = VA.PAGE_TYPES_SQL
RTYPES = "(" + ", ".join(f"'{t}'" for t in VA.RELATIONSHIP_TYPES) + ")"


@query(
    f"""WITH {N} SELECT note_id, concat_ws(',', CASE WHEN NOT coalesce(len(trim(title, ' ')) BETWEEN 1 AND 120 AND NOT regexp_matches(trim(title, ' '), '\\p{{Cc}}|\\[\\[|\\]\\]'), false) THEN 'title' END,
  CASE WHEN NOT coalesce(type IN {TYPES}, false) THEN 'type' END, CASE WHEN NOT coalesce(len(trim(body, ' ')) BETWEEN 1 AND 20000 AND NOT regexp_matches(body, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]'), false) THEN 'body' END,
  CASE WHEN len(tags) > 12 OR len(list_filter(tags, lambda t: len(t) > 64)) > 0 THEN 'tags' END, CASE WHEN len(links) > 50 THEN 'links' END) AS problems FROM n"""
)
def m1_validate_page(spark, sf_dir):
    rows = notes(spark, sf_dir)
    return rows.select("note_id", F.array_join(VA.page_problems(*(F.col(c) for c in ("title", "type", "body", "tags", "links"))), ",").alias("problems"))


@query(
    f"""WITH {N}, r AS (SELECT note_id, links, unnest(relationships) AS r FROM n), g AS (SELECT note_id, lower(trim(r.target, ' ')) AS target, r.type AS type FROM r WHERE r.type IN {RTYPES}
    AND list_contains(list_transform(list_filter(list_transform(links, lambda x: trim(x, ' ')), lambda x: len(x) > 0), lambda x: lower(x)), lower(trim(r.target, ' '))) AND regexp_matches(r.confirmedAt, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(?:\\.\\d{{1,6}})?(?:Z|[+-]\\d{{2}}:\\d{{2}})$'))
  SELECT note_id, count(DISTINCT (target, type)) AS relationships FROM g GROUP BY 1"""
)
def m2_relationships(spark, sf_dir):
    rows = notes(spark, sf_dir).select("note_id", "relationships", X.distinct_ignoring_case(F.col("links")).alias("links"))
    kept = rows.select("note_id", F.size(VA.clean_relationships(F.col("relationships"), F.col("links"))).cast("bigint").alias("relationships"))
    return kept.where("relationships > 0")


@query(f"WITH {SRC} SELECT source_id, concat_ws(',', CASE WHEN NOT coalesce(len(trim(title, ' ')) BETWEEN 1 AND 500, false) THEN 'title' END, CASE WHEN NOT coalesce(regexp_matches(content_hash, '^[a-f0-9]{{64}}$'), false) THEN 'hash' END) AS problems FROM sr")
def m11_source_problems(spark, sf_dir):
    none = F.lit(None).cast("array<int>")
    return sources(spark, sf_dir).select("source_id", F.array_join(VA.source_problems(F.col("title"), F.col("content_hash"), none), ",").alias("problems"))


# Changes under review: every note is rewritten by a change whose base hash is out of date for every ninth; every sixth change adds a page that takes the note's title.
CH = """ch AS (SELECT note_id AS change_id, CASE WHEN note_id % 6 = 0 THEN 'new' ELSE 'merge' END AS action, title, CASE WHEN note_id % 9 = 0 THEN 'old' ELSE sha256(coalesce(body, '')) END AS base_hash, CASE note_id % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS include, note_id % 40 AS proposal_id, sha256(coalesce(body, '')) AS now FROM n)"""


def changes(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = notes(spark, sf_dir).select("note_id", "title", F.sha2(F.coalesce("body", F.lit("")), 256).alias("hash"))
    new = F.col("note_id") % 6 == 0
    rows = base.select(F.col("note_id").alias("change_id"), F.when(new, "new").otherwise("merge").alias("action"), F.when(~new, F.col("note_id")).alias("note_id"), "title", F.when(F.col("note_id") % 9 == 0, "old").otherwise(F.col("hash")).alias("base_hash"))
    said = base.select(F.col("note_id").alias("change_id"), F.when(F.col("note_id") % 4 == 0, F.lit(None).cast("boolean")).otherwise(F.col("note_id") % 4 > 1).alias("include"))
    return rows, base, said


@query(f"WITH {N}, {CH} SELECT change_id, CASE WHEN NOT coalesce(include, false) THEN 'excluded' WHEN action <> 'new' AND base_hash <> now THEN 'stale' WHEN action = 'new' AND title IS NOT NULL THEN 'title_taken' ELSE 'apply' END AS status FROM ch")
def i13_selected_changes(spark, sf_dir):
    return ingest.selected_changes(*changes(spark, sf_dir))


@query(f"WITH {N}, {CH}, c AS (SELECT proposal_id, count(*) FILTER (include) AS include, count(*) FILTER (NOT include) AS exclude, count(*) FILTER (include IS NULL) AS pending FROM ch GROUP BY 1) SELECT *, pending = 0 AND include > 0 AS can_approve FROM c")
def a17_review_summary(spark, sf_dir):
    said = changes(spark, sf_dir)[2].withColumn("proposal_id", F.col("change_id") % 40)
    return ingest.decision_summary(said, "proposal_id")


@query("WITH p AS (SELECT DISTINCT note_id, source_id, action FROM note_sources WHERE note_id IS NOT NULL AND source_id IS NOT NULL) SELECT note_id, source_id, action FROM p WHERE source_id % 5 <> 0 UNION ALL SELECT DISTINCT note_id, source_id, 'merge' FROM p WHERE source_id % 5 = 0")
def i16_attach_provenance(spark, sf_dir):
    rows = table(spark, sf_dir, "note_sources").where("note_id is not null and source_id is not null").select("note_id", "source_id", "action").distinct()
    return ingest.attached(rows, rows.where("source_id % 5 = 0").withColumn("action", F.lit("merge")))


@query(f"WITH {N} SELECT note_id FROM n WHERE note_id % 8 = 0 OR (note_id % 5 = 0 AND type IS DISTINCT FROM 'entity')")
def i21_immutable_violations(spark, sf_dir):
    before = notes(spark, sf_dir).select("note_id", "title", "type")
    title = F.when(F.col("note_id") % 8 == 0, F.concat(F.coalesce("title", F.lit("")), F.lit("!"))).otherwise(F.col("title"))
    after = before.select("note_id", title.alias("title"), F.when(F.col("note_id") % 5 == 0, "entity").otherwise(F.col("type")).alias("type"))
    return ingest.immutable_violations(before, after)


@query(f"WITH {N}, rm AS (SELECT DISTINCT record_id FROM removals WHERE record_kind = 'note'), l AS (SELECT DISTINCT source_note_id, target_note_id FROM links) SELECT source_note_id, target_note_id FROM l WHERE source_note_id IN (SELECT note_id FROM n) AND target_note_id IN (SELECT note_id FROM n) AND source_note_id NOT IN (SELECT record_id FROM rm) AND target_note_id NOT IN (SELECT record_id FROM rm)")
def i17_delete_cascade(spark, sf_dir):
    removed = table(spark, sf_dir, "removals").where("record_kind = 'note' and record_id is not null").select(F.col("record_id").alias("note_id")).distinct()
    links = table(spark, sf_dir, "links").select("source_note_id", "target_note_id").distinct()
    return lifecycle.kept_links(links, notes(spark, sf_dir).select("note_id").join(removed, "note_id", "left_anti"))


@query(
    f"""WITH {N}, {NS}, {EV}, {GE}, {DI}, pa AS (SELECT a.id, a.note_id AS l, b.note_id AS r FROM dp a JOIN dp b ON a.id = b.id AND a.note_id < b.note_id WHERE NOT EXISTS (FROM ex WHERE source = a.note_id AND target = b.note_id)),
  sh AS (SELECT DISTINCT x.note_id AS l, y.note_id AS r FROM ns x JOIN ns y USING (source_id)), mk AS (SELECT id, pa.l, pa.r, sh.l IS NOT NULL AS same FROM pa LEFT JOIN sh ON sh.l = pa.l AND sh.r = pa.r)
  SELECT id, l, r FROM mk QUALIFY row_number() OVER (PARTITION BY id ORDER BY same, l, r) = 1"""
)
def c17_chosen_pairs(spark, sf_dir):
    return ingest.chosen_pairs(discoveries(spark, sf_dir), graph.explicit_edges(notes(spark, sf_dir)), note_sources(spark, sf_dir))


@query(f"WITH {N}, {NS}, {EV}, {GE}, {DI}, {SRC}, {FIRST_SOURCE} SELECT id, string_agg(coalesce(title, ''), '|' ORDER BY dp.note_id) AS titles, count(DISTINCT primary_source) AS sources FROM dp JOIN n ON n.note_id = dp.note_id LEFT JOIN fs ON fs.note_id = dp.note_id GROUP BY id")
def c15_hydrated(spark, sf_dir):
    whole = discovery.hydrated(discoveries(spark, sf_dir), notes(spark, sf_dir), primary_sources(spark, sf_dir))
    return whole.select("id", F.array_join(F.transform("pages", lambda p: p["title"]), "|").alias("titles"), "sources")


@query(f"WITH {N}, {NS}, {GE}, dg AS (SELECT node, count(DISTINCT other) FILTER (kind = 'explicit') AS explicit, count(DISTINCT other) FILTER (kind = 'semantic') AS semantic FROM inc GROUP BY 1), s AS (SELECT note_id, count(*) AS sources FROM ns GROUP BY 1) SELECT n.note_id, coalesce(explicit, 0) AS explicit, coalesce(semantic, 0) AS semantic, coalesce(sources, 0) AS sources FROM n LEFT JOIN dg ON node = n.note_id LEFT JOIN s ON s.note_id = n.note_id")
def a18_evidence_summary(spark, sf_dir):
    zero = F.lit(0).cast("bigint")
    inc = graph.incident(edges(spark, sf_dir))
    degree = inc.groupBy(F.col("node").alias("note_id")).agg(F.countDistinct(F.when(F.col("kind") == "explicit", F.col("other"))).alias("explicit"), F.countDistinct(F.when(F.col("kind") == "semantic", F.col("other"))).alias("semantic"))
    held = note_sources(spark, sf_dir).groupBy("note_id").agg(F.count("*").alias("sources"))
    rows = notes(spark, sf_dir).select("note_id").join(degree, "note_id", "left").join(held, "note_id", "left")
    return rows.select("note_id", *(F.coalesce(c, zero).alias(c) for c in ("explicit", "semantic", "sources")))


# Nodes lie by their numbers of links of each kind, with an offset by id.
@query(
    f"""WITH {N}, {NS}, {GE}, dg AS (SELECT node, count(DISTINCT other) FILTER (kind = 'explicit') AS e, count(DISTINCT other) FILTER (kind = 'semantic') AS s FROM inc GROUP BY 1), p AS (SELECT 40 * e + note_id % 13 AS x, 25 * s - note_id % 7 AS y FROM n JOIN dg ON node = note_id)
  SELECT count(*) AS points, min(x)::DOUBLE AS min_x, max(x)::DOUBLE AS max_x, min(y)::DOUBLE AS min_y, max(y)::DOUBLE AS max_y, round(least(800 / greatest(1, max(x) - min(x)), 600 / greatest(1, max(y) - min(y)), 4), 6)::DOUBLE AS scale FROM p"""
)
def a15_bounding_box(spark, sf_dir):
    inc = graph.incident(edges(spark, sf_dir))
    of = lambda kind: F.countDistinct(F.when(F.col("kind") == kind, F.col("other")))
    degree = inc.groupBy(F.col("node").alias("note_id")).agg(of("explicit").alias("e"), of("semantic").alias("s")).join(notes(spark, sf_dir).select("note_id"), "note_id", "left_semi")
    return graph.fitted(degree.select((40 * F.col("e") + F.col("note_id") % 13).alias("x"), (25 * F.col("s") - F.col("note_id") % 7).alias("y")), 800, 600).withColumn("scale", F.round("scale", 6))


@query(f"WITH {SRC}, {HI}, fa AS (SELECT source_hash, min(applied_at) AS t FROM hi GROUP BY 1) SELECT source_id, epoch_us(t) AS archived_at, row_number() OVER (ORDER BY t NULLS LAST, content_hash, source_id) AS position FROM sr LEFT JOIN fa ON source_hash = content_hash")
def s10_archive_order(spark, sf_dir):
    first = integrity.first_applied(history(spark, sf_dir)).withColumnRenamed("source_hash", "content_hash")
    rows = sources(spark, sf_dir).select("source_id", "content_hash").join(first, "content_hash", "left")
    return ranked(rows, [], [F.col("archived_at").asc_nulls_last(), F.col("content_hash"), F.col("source_id")]).select("source_id", F.unix_micros("archived_at").alias("archived_at"), "position")


@query("WITH t AS (SELECT ingest_id, min(regexp_replace(regexp_replace(transcript, '\\r\\n?', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS t, min(title) AS title FROM ingest_results WHERE transcript IS NOT NULL GROUP BY 1) SELECT sha256(t) AS content_hash, count(*) AS copies, CASE WHEN len(t) = 0 THEN 'empty' WHEN len(t) > 20000 THEN 'too_long' ELSE '' END AS problem FROM t GROUP BY 1, 3")
def s1_pasted_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "ingest_results").where("transcript is not null").groupBy("ingest_id").agg(F.min(X.stripped(F.regexp_replace("transcript", r"\r\n?", "\n"))).alias("transcript"), F.min("title").alias("title"))
    return ingest.pasted(rows, "title", "transcript", 20_000).groupBy("content_hash", F.coalesce("problem", F.lit("")).alias("problem")).agg(F.count("*").alias("copies"))


@query()
def v6_stub_embeddings(spark, sf_dir):
    text = notes(spark, sf_dir).select("note_id", providers.embedding_input(F.concat_ws("\n", "title", "body"), "nomic-embed-text-v2").alias("text"))
    return providers.embedded(text, "note_id", "text", providers.hashed_embedder(64), 64)


@query(f"WITH {N}, c AS (SELECT note_id AS id, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g'), ' ') AS t, created_at FROM n) SELECT id, t AS title, position FROM (SELECT *, row_number() OVER (ORDER BY contains(lower(t), 'window') DESC, lower(t), id)::INT AS position FROM c) WHERE position <= 50")
def proj9_page_list(spark, sf_dir):
    rows = notes(spark, sf_dir).select(F.col("note_id").alias("id"), X.squeezed(F.coalesce("title", F.lit(""))).alias("title"))
    order = (F.desc("hit"), "low", "id")
    top = rows.withColumns({"hit": F.contains(F.lower("title"), F.lit("window")), "low": F.lower("title")}).orderBy(*order).limit(50)
    return top.select("id", "title", F.row_number().over(Window.orderBy(*order)).alias("position"))
