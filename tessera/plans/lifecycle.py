"""Registered queries on whole changes of a catalogue and on the vault's files, with their SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.validation import PAGE_TYPES_SQL
from tessera.operators import integrity, lifecycle
from tessera.plans.records import HI, SRC, history, rendered, sources
from tessera.plans.retrieval import NS, N, V, note_sources, note_vectors, notes
from tessera.session import ensure_checkpoint_dir
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


# Each source is an ingest of the notes attached to it. Every thirteenth note has another title since, every eleventh another text, and every seventeenth earlier text fails its hash.
CHANGES = f"""{HI}, ac AS (SELECT note_id, source_id, min(lower(action)) AS a FROM note_sources WHERE note_id IS NOT NULL AND source_id IS NOT NULL GROUP BY 1, 2),
  hc AS (SELECT history_id, hi.source_id, applied_at, n.note_id, CASE WHEN note_id % 13 = 0 THEN coalesce(title, '') || '!' ELSE title END AS page_title, CASE WHEN a = 'new' THEN 'new' ELSE 'merge' END AS action,
    CASE WHEN note_id % 11 = 0 THEN 'old' ELSE sha256(coalesce(body, '')) END AS after_hash, note_id % 17 = 0 AS bad FROM hi JOIN ac ON ac.source_id = hi.source_id JOIN n USING (note_id)),
  cf AS (SELECT history_id, hc.note_id, CASE WHEN sha256(coalesce(body, '')) <> after_hash THEN 'changed' WHEN title IS DISTINCT FROM page_title THEN 'renamed' WHEN action <> 'new' AND bad THEN 'bad_revision' END AS problem FROM hc JOIN n USING (note_id))"""


def recorded(spark, sf_dir) -> DataFrame:
    acts = table(spark, sf_dir, "note_sources").where("note_id is not null and source_id is not null").groupBy("note_id", "source_id").agg(F.min(F.lower("action")).alias("a"))
    rows = history(spark, sf_dir).join(acts, "source_id").join(notes(spark, sf_dir).select("note_id", "title", "body"), "note_id")
    of = lambda n: F.col("note_id") % n == 0
    action = F.when(F.col("a") == "new", "new").otherwise("merge")
    before = F.when(action != "new", F.concat(F.lit("before "), F.col("note_id").cast("string")))
    return rows.select(
        "history_id", "source_id", "applied_at", "note_id", F.when(of(13), F.concat(F.coalesce("title", F.lit("")), F.lit("!"))).otherwise(F.col("title")).alias("page_title"), action.alias("action"), before.alias("before_body"),
        F.when(of(17), "bad").otherwise(F.sha2(before, 256)).alias("before_hash"), F.when(of(11), "old").otherwise(F.sha2(F.coalesce("body", F.lit("")), 256)).alias("after_hash"),
    )


def catalogue(spark, sf_dir) -> lifecycle.Catalogue:
    acts = table(spark, sf_dir, "note_sources").where("note_id is not null and source_id is not null").groupBy("note_id", "source_id").agg(F.min("action").alias("action"))
    return lifecycle.Catalogue(notes(spark, sf_dir), sources(spark, sf_dir), acts, note_vectors(spark, sf_dir), table(spark, sf_dir, "links").select("source_note_id", "target_note_id", "similarity"), recorded(spark, sf_dir))


def summary(after: lifecycle.Catalogue) -> DataFrame:
    """(note_id, body_hash, sources, has_vector) of a catalogue's notes."""
    held = after.provenance.groupBy("note_id").agg(F.count("*").alias("n"))
    marked = after.vectors.select(F.col("id").alias("note_id"), F.lit(True).alias("v"))
    rows = after.notes.select("note_id", F.sha2(F.coalesce("body", F.lit("")), 256).alias("body_hash")).join(held, "note_id", "left").join(marked, "note_id", "left")
    return rows.select("note_id", "body_hash", F.coalesce("n", F.lit(0).cast("bigint")).alias("sources"), F.coalesce("v", F.lit(False)).alias("has_vector"))


@query(f"WITH {N}, {SRC}, {CHANGES} SELECT history_id, note_id, problem FROM cf WHERE problem IS NOT NULL")
def i6_undo_conflicts(spark, sf_dir):
    return lifecycle.undo_conflicts(recorded(spark, sf_dir), notes(spark, sf_dir))


@query(
    f"""WITH {N}, {NS}, {SRC}, {V}, {CHANGES}, pick AS (SELECT history_id FROM hc WHERE history_id NOT IN (SELECT history_id FROM cf WHERE problem IS NOT NULL) ORDER BY hc.applied_at DESC, history_id DESC LIMIT 1),
  rw AS (SELECT * FROM hc WHERE history_id IN (FROM pick)), ps AS (SELECT note_id, count(*) AS c FROM ns WHERE NOT EXISTS (FROM rw WHERE rw.note_id = ns.note_id AND rw.source_id = ns.source_id) GROUP BY 1)
  SELECT n.note_id, CASE WHEN rw.note_id IS NULL THEN sha256(coalesce(body, '')) ELSE sha256('before ' || n.note_id) END AS body_hash, coalesce(c, 0) AS sources, rw.note_id IS NULL AND n.note_id IN (SELECT id FROM v) AS has_vector
  FROM n LEFT JOIN rw USING (note_id) LEFT JOIN ps ON ps.note_id = n.note_id WHERE rw.action IS DISTINCT FROM 'new'"""
)
def i6_undo(spark, sf_dir):
    """The notes after undoing the newest ingest that nothing stands against; the others are counted as undone already."""
    before = catalogue(spark, sf_dir)
    blocked = lifecycle.undo_conflicts(before.history, before.notes).select("history_id").distinct()
    newest = lifecycle.latest_undoable(before.history, blocked)
    return summary(lifecycle.undo(before, newest)[0] if newest else before)


AT = dt.datetime(2026, 9, 1)
APPROVED = """so AS (SELECT min(source_id) AS s FROM sr), up AS (SELECT note_id FROM n WHERE note_id % 10 = 3 AND note_id % 4 <> 0), nw AS (SELECT note_id + 1000000000 AS note_id FROM n WHERE note_id % 50 = 7 AND note_id % 4 <> 0),
  pv AS (SELECT note_id, source_id FROM ns UNION SELECT note_id, s FROM up, so UNION SELECT note_id, s FROM nw, so), pc AS (SELECT note_id, count(*) AS c FROM pv GROUP BY 1)"""


def approved(spark, sf_dir) -> lifecycle.Catalogue:
    """Every tenth note rewritten, and pages added, by a reviewed ingest of the first source; a fourth of the changes is excluded."""
    before = catalogue(spark, sf_dir)
    text = F.concat(F.lit("rewritten "), F.col("note_id").cast("string"))
    base = before.notes.select("note_id", "title", "type", F.sha2(F.coalesce("body", F.lit("")), 256).alias("base_hash"))
    rewritten = base.where("note_id % 10 = 3").select(F.col("note_id").alias("change_id"), F.lit("merge").alias("action"), "note_id", "title", text.alias("body"), "type", "base_hash")
    added = base.where("note_id % 50 = 7").select((-F.col("note_id")).alias("change_id"), F.lit("new").alias("action"), (F.col("note_id") + 1_000_000_000).alias("note_id"), F.concat(F.lit("Added page "), F.col("note_id").cast("string")).alias("title"), F.lit("fresh").alias("body"), "type", F.lit(None).cast("string").alias("base_hash"))
    changes = rewritten.unionByName(added)
    said = changes.select("change_id", (F.col("change_id") % 4 != 0).alias("include"))
    first = before.sources.agg(F.min("source_id")).first()[0]
    return lifecycle.approve(before, changes, said, first, "h-approve", AT)[0] if first is not None else before


@query(
    f"""WITH {N}, {NS}, {SRC}, {V}, {APPROVED} SELECT n.note_id, CASE WHEN up.note_id IS NULL THEN sha256(coalesce(body, '')) ELSE sha256('rewritten ' || n.note_id) END AS body_hash, coalesce(c, 0) AS sources, up.note_id IS NULL AND n.note_id IN (SELECT id FROM v) AS has_vector
  FROM n LEFT JOIN up USING (note_id) LEFT JOIN pc ON pc.note_id = n.note_id UNION ALL SELECT note_id, sha256('fresh'), c, false FROM nw JOIN pc USING (note_id)"""
)
def i14_approve(spark, sf_dir):
    return summary(approved(spark, sf_dir))


@query(
    f"""WITH {N}, {NS}, {SRC}, {APPROVED} SELECT n.note_id, 'merge' AS action, sha256(coalesce(body, '')) AS before_hash, sha256('rewritten ' || n.note_id) AS after_hash FROM n JOIN up USING (note_id)
  UNION ALL SELECT note_id, 'new', NULL, sha256('fresh') FROM nw"""
)
def i5_history_record(spark, sf_dir):
    return approved(spark, sf_dir).history.where("history_id = 'h-approve'").select("note_id", "action", "before_hash", "after_hash")


@query(
    f"""WITH {N}, {NS}, {SRC}, f AS (SELECT note_id AS old, title, file_path, row_number() OVER (ORDER BY file_path) AS note_id FROM n WHERE title IS NOT NULL AND body <> '' AND type IN {PAGE_TYPES_SQL}),
  ah AS (SELECT content_hash, min(created_at) AS t FROM sr GROUP BY 1), so AS (SELECT content_hash, row_number() OVER (ORDER BY t NULLS LAST, content_hash) AS source_id FROM ah),
  ac AS (SELECT note_id, content_hash, min(lower(action)) AS action FROM note_sources JOIN sr USING (source_id) WHERE source_id % 2 = 0 AND action IS NOT NULL GROUP BY 1, 2),
  pv AS (SELECT DISTINCT f.note_id, so.source_id, coalesce(ac.action, 'reference') AS action FROM f JOIN ns ON ns.note_id = f.old JOIN sr USING (source_id) JOIN so ON so.content_hash = sr.content_hash LEFT JOIN ac ON ac.note_id = f.old AND ac.content_hash = sr.content_hash)
  SELECT f.note_id, title, file_path, count(source_id) AS sources, string_agg(source_id || ' ' || action, ',' ORDER BY source_id) AS actions FROM f LEFT JOIN pv USING (note_id) GROUP BY ALL"""
)
def i4_rebuild(spark, sf_dir):
    """A catalogue from rendered pages, archived sources and the actions that history names, counted for each note."""
    path = notes(spark, sf_dir).select("note_id", F.col("file_path").alias("path"))
    files = rendered(spark, sf_dir).join(path, "note_id").select("path", "markdown")
    known = sources(spark, sf_dir)
    archive = known.groupBy("content_hash").agg(F.min_by(F.struct("title", "source_url", "source_type"), "source_id").alias("s"), F.min("created_at").alias("archived_at")).select("content_hash", "s.*", "archived_at")
    acts = table(spark, sf_dir, "note_sources").where("source_id % 2 = 0 and action is not null").join(known.select("source_id", "content_hash"), "source_id").join(path, "note_id")
    actions = acts.groupBy("path", "content_hash").agg(F.min(F.lower("action")).alias("action"))
    after = lifecycle.rebuilt(files, archive, actions, note_vectors(spark, sf_dir), table(spark, sf_dir, "links"))
    # A note names few sources, so its list is bounded.
    held = after.provenance.groupBy("note_id").agg(F.count("*").alias("sources"), F.array_sort(F.collect_list(F.struct("source_id", "action"))).alias("a"))
    rows = after.notes.join(held, "note_id", "left")
    text = F.array_join(F.transform("a", lambda x: F.concat(x["source_id"].cast("string"), F.lit(" "), x["action"])), ",")
    return rows.select("note_id", "title", "file_path", F.coalesce("sources", F.lit(0).cast("bigint")).alias("sources"), text.alias("actions"))


@query(f"WITH {SRC}, ah AS (SELECT content_hash, min(created_at) AS t FROM sr GROUP BY 1) SELECT content_hash, row_number() OVER (ORDER BY t NULLS LAST, content_hash) AS position FROM ah WHERE content_hash NOT IN (SELECT content_hash FROM sr WHERE source_id % 3 = 0)")
def i18_awaiting(spark, sf_dir):
    """Archived sources that the log, which names every third source, does not name, in the order of archiving."""
    from tessera.operators.ranking import ranked

    known = sources(spark, sf_dir)
    archive = known.groupBy("content_hash").agg(F.min("created_at").alias("archived_at"))
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    known.where("source_id % 3 = 0").select(F.concat(F.lit("- Source SHA-256: `"), "content_hash", F.lit("`"))).write.text(folder)
    left = lifecycle.awaiting(archive, integrity.logged_hashes(spark, folder))
    return ranked(left, [], [F.col("archived_at").asc_nulls_last(), F.col("content_hash")]).select("content_hash", "position")


@query(
    """WITH l AS (SELECT source_note_id AS s, target_note_id AS t, similarity AS x FROM links WHERE source_note_id <> target_note_id)
  SELECT least(s, t) AS source_note_id, greatest(s, t) AS target_note_id, x AS similarity FROM l QUALIFY row_number() OVER (PARTITION BY least(s, t), greatest(s, t) ORDER BY s, t, x IS NULL, x DESC) = 1"""
)
def i20_link_migration(spark, sf_dir):
    return lifecycle.migrated_links(table(spark, sf_dir, "links"))


@query(f"WITH {SRC} SELECT content_hash, source_type, CASE WHEN source_id % 7 = 0 THEN 'hash_mismatch' WHEN source_id % 5 = 0 THEN 'unexpected_file' END AS problem FROM (SELECT content_hash, source_type, source_id FROM sr QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY source_id) = 1)")
def s11_archive_scan(spark, sf_dir):
    """The strict scan of an archive folder written for it: every seventh source's text is not the one its name says, every fifth of the others has a file too many."""
    one = sources(spark, sf_dir).groupBy("content_hash").agg(F.min_by(F.struct("source_id", "title", "source_url", "source_type"), "source_id").alias("s")).select("content_hash", "s.*")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/archive-{uuid.uuid4().hex}"
    meta = F.to_json(F.struct(F.col("content_hash").alias("contentHash"), "title", F.col("source_url").alias("sourceUrl"), F.col("source_type").alias("sourceType")))
    files = one.select("source_id", "content_hash", meta.alias("meta"))
    integrity.write_files(files.select(F.concat(F.lit("sources/"), "content_hash", F.lit("/meta.json")).alias("path"), F.col("meta").alias("content")), folder)
    integrity.write_files(files.select(F.concat(F.lit("sources/"), "content_hash", F.lit("/source.txt")).alias("path"), F.concat(F.lit("text of "), "content_hash", F.when(F.col("source_id") % 7 == 0, "?").otherwise("")).alias("content")), folder)
    integrity.write_files(files.where("source_id % 5 = 0").select(F.concat(F.lit("sources/"), "content_hash", F.lit("/notes.bin")).alias("path"), F.lit("x").alias("content")), folder)
    # The stored hashes are not those of texts: the scan is told what each text's hash should be.
    digest = files.select("content_hash", F.sha2(F.concat(F.lit("text of "), "content_hash"), 256).alias("text_hash"))
    return integrity.archived_sources(spark, folder, strict=True, expected=digest).select("content_hash", F.col("sourceType").alias("source_type"), "problem")
