"""Whole changes of a catalogue: approving an ingest, undoing one, rebuilding from the vault's files, recompiling from the archive.

A catalogue is a set of tables; every function returns the next set and changes nothing in place.
Each change is all or nothing: a conflict leaves the catalogue as it was.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import markdown as M
from tessera.operators import ingest
from tessera.operators.ranking import ranked


@dataclass(frozen=True)
class Catalogue:
    notes: DataFrame  # note_id, title, type, body, file_path, source_url, source_type and more
    sources: DataFrame  # source_id, content_hash, title, source_url, source_type
    provenance: DataFrame  # note_id, source_id, action
    vectors: DataFrame  # id, v
    links: DataFrame  # source_note_id, target_note_id, similarity
    history: DataFrame | None = None  # rows of history_record


HISTORY = "history_id string, source_id bigint, applied_at timestamp, note_id bigint, page_title string, action string, before_body string, before_hash string, after_hash string"


def history_record(changes: DataFrame, notes: DataFrame, history_id: str, source_id: int, applied_at) -> DataFrame:
    """HISTORY rows of changes(note_id, action, title, body): what each page was and what it became. New pages have no earlier text."""
    before = notes.select("note_id", F.coalesce("body", F.lit("")).alias("b"))
    joined = changes.join(before, "note_id", "left")
    old = F.when(F.col("action") != "new", F.col("b"))
    return joined.select(
        F.lit(history_id).alias("history_id"), F.lit(source_id).cast("bigint").alias("source_id"), F.lit(applied_at).cast("timestamp").alias("applied_at"), "note_id", F.col("title").alias("page_title"), "action",
        old.alias("before_body"), F.sha2(old, 256).alias("before_hash"), F.sha2(F.coalesce("body", F.lit("")), 256).alias("after_hash"),
    )


def undo_conflicts(history: DataFrame, notes: DataFrame) -> DataFrame:
    """(history_id, note_id, problem): what stands against undoing ingests: a page that is missing, changed or renamed since, or an earlier text that fails its hash."""
    now = notes.select("note_id", "title", F.sha2(F.coalesce("body", F.lit("")), 256).alias("now"), F.lit(True).alias("there"))
    joined = history.join(now, "note_id", "left")
    problem = (
        F.when(F.col("there").isNull(), "missing")
        .when(~F.col("now").eqNullSafe(F.col("after_hash")), "changed")
        .when(~F.col("title").eqNullSafe(F.col("page_title")), "renamed")
        .when((F.col("action") != "new") & ~F.sha2(F.col("before_body"), 256).eqNullSafe(F.col("before_hash")), "bad_revision")
    )
    return joined.select("history_id", "note_id", problem.alias("problem")).where("problem is not null")


def latest_undoable(history: DataFrame, undone: DataFrame) -> str | None:
    """The newest ingest without an undo receipt, by time, then id."""
    first = history.join(undone.select("history_id"), "history_id", "left_anti").orderBy(F.desc("applied_at"), F.desc("history_id")).select("history_id").first()
    return first[0] if first else None


def _without_pages(catalogue: Catalogue, touched: DataFrame) -> Catalogue:
    """The catalogue without the vectors and links of touched pages(note_id), which no longer fit their texts."""
    ids = touched.select("note_id").distinct()
    links = catalogue.links
    for end in ("source_note_id", "target_note_id"):
        links = links.join(ids.withColumnRenamed("note_id", end), end, "left_anti")
    return replace(catalogue, vectors=catalogue.vectors.join(ids.withColumnRenamed("note_id", "id"), "id", "left_anti"), links=links.select(*catalogue.links.columns))


def kept_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Links whose two ends are among notes(note_id)."""
    out = links
    for end in ("source_note_id", "target_note_id"):
        out = out.join(notes.select(F.col("note_id").alias(end)).distinct(), end, "left_semi")
    return out.select(*links.columns)


def deleted(catalogue: Catalogue, gone: DataFrame) -> Catalogue:
    """The catalogue without the pages gone(note_id) and all that hangs on them; sources stay."""
    ids = gone.select("note_id").where("note_id is not null").distinct()
    after = _without_pages(catalogue, ids)
    return replace(after, notes=catalogue.notes.join(ids, "note_id", "left_anti").select(*catalogue.notes.columns), provenance=catalogue.provenance.join(ids, "note_id", "left_anti").select(*catalogue.provenance.columns))


def undo(catalogue: Catalogue, history_id: str) -> tuple[Catalogue, DataFrame]:
    """(catalogue, conflicts) after undoing an ingest of catalogue.history; with any conflict the catalogue stays as it is.

    New pages go with all that hangs on them. Others get their earlier text back, lose this source and
    their vectors and links, and take url and type from the first source they have left.
    """
    rows = catalogue.history.where(F.col("history_id") == history_id)
    conflicts = undo_conflicts(rows, catalogue.notes)
    if not conflicts.isEmpty():
        return catalogue, conflicts
    return undone(catalogue, rows), conflicts


def undone(catalogue: Catalogue, rows: DataFrame) -> Catalogue:
    """The catalogue after undoing the HISTORY rows of ingests without conflicts."""
    gone = rows.where("action = 'new'").select("note_id").distinct()
    back = rows.where("action <> 'new'")
    touched = rows.select("note_id", "source_id").distinct()
    kept = catalogue.provenance.join(touched, ["note_id", "source_id"], "left_anti").join(gone, "note_id", "left_anti")
    earlier = back.groupBy("note_id").agg(F.min_by("before_body", "applied_at").alias("earlier"), F.lit(True).alias("back"))
    remaining = kept.join(touched.select("note_id").distinct(), "note_id", "left_semi").groupBy("note_id").agg(F.min("source_id").alias("source_id"))
    first = remaining.join(catalogue.sources.select("source_id", F.col("source_url").alias("u"), F.col("source_type").alias("k")), "source_id").select("note_id", "u", "k")
    pages = catalogue.notes.join(gone, "note_id", "left_anti").join(earlier, "note_id", "left").join(first, "note_id", "left")
    new = {"body": "earlier", "source_url": "u", "source_type": "k"}
    restored = pages.withColumns({c: F.when(F.col("back"), F.col(v)).otherwise(F.col(c)) for c, v in new.items() if c in catalogue.notes.columns}).select(*catalogue.notes.columns)
    return replace(_without_pages(catalogue, rows), notes=restored, provenance=kept)


def approve(catalogue: Catalogue, changes: DataFrame, decisions: DataFrame, source_id: int, history_id: str, applied_at, vectors: DataFrame | None = None) -> tuple[Catalogue, DataFrame]:
    """(catalogue, statuses) after the chosen changes of an ingest.

    changes(change_id, action, note_id, title, body, type, base_hash), decisions(change_id, include);
    new pages have the note_id they are to get. A chosen change that is stale or whose title is taken stops them
    all. Changed pages get their text, the source and its action, and lose their vectors; with vectors(id, v)
    of the new texts these take their place, without any the links are cleared. A history record is kept.
    """
    current = catalogue.notes.select("note_id", "title", F.sha2(F.coalesce("body", F.lit("")), 256).alias("hash"))
    statuses = ingest.selected_changes(changes, current, decisions)
    if statuses.where("status not in ('apply', 'excluded')").isEmpty():
        chosen = changes.join(statuses.where("status = 'apply'").select("change_id"), "change_id", "left_semi")
        return applied(catalogue, chosen, source_id, history_id, applied_at, vectors), statuses
    return catalogue, statuses


def applied(catalogue: Catalogue, chosen: DataFrame, source_id: int, history_id: str, applied_at, vectors: DataFrame | None = None) -> Catalogue:
    """The catalogue after changes that are known to apply: see approve."""
    record = history_record(chosen, catalogue.notes, history_id, source_id, applied_at)
    old = catalogue.notes.alias("o").join(chosen.where("action <> 'new'").select("note_id", F.col("body").alias("_body"), F.lit(True).alias("_hit")), "note_id", "left")
    kept = old.withColumn("body", F.when(F.col("_hit"), F.col("_body")).otherwise(F.col("body"))).select(*catalogue.notes.columns)
    of = catalogue.sources.where(F.col("source_id") == source_id).select("source_url", "source_type")
    fresh = chosen.where("action = 'new'").drop("source_url", "source_type").join(of, how="left")  # one row: the source
    columns = (F.col(c) if c in fresh.columns else F.lit(None).cast(catalogue.notes.schema[c].dataType).alias(c) for c in catalogue.notes.columns)
    acts = chosen.select("note_id", F.lit(source_id).cast("bigint").alias("source_id"), "action")
    after = _without_pages(catalogue, chosen)
    after = replace(after, vectors=after.vectors.unionByName(vectors)) if vectors is not None else replace(after, links=catalogue.links.limit(0))
    history = record if catalogue.history is None else catalogue.history.unionByName(record)
    return replace(after, notes=kept.unionByName(fresh.select(*columns)), provenance=ingest.attached(catalogue.provenance, acts), history=history)


def rebuild_problems(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, problem) that stop a rebuild: unreadable pages, titles used twice, hashes that no source has."""
    read = pages.where("page is not null")
    titles = read.groupBy(F.lower("page.title").alias("key")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    twice = read.join(titles, F.lower("page.title") == F.col("key")).select("path", F.lit("duplicate_title").alias("problem"))
    cited = read.select("path", F.explode("hashes").alias("content_hash"))
    unknown = cited.join(sources.select("content_hash").distinct(), "content_hash", "left_anti").select("path", F.lit("unknown_source").alias("problem")).distinct()
    return pages.where("page is null").select("path", F.lit("unreadable").alias("problem")).unionByName(twice).unionByName(unknown)


def parsed_files(files: DataFrame) -> DataFrame:
    """(path, page, hashes) of files(path, markdown): page is null where the format does not hold, hashes are in page order."""
    return files.select("path", M.parsed_page(F.col("markdown")).alias("page"), M.source_hashes(F.col("markdown")).alias("hashes"))


def rebuilt(files: DataFrame, archive: DataFrame, actions: DataFrame, vectors: DataFrame, links: DataFrame) -> Catalogue:
    """A catalogue from the vault's files alone: files(path, markdown), archive(content_hash, title, source_url, source_type, archived_at), actions(path, content_hash, action).

    Sources are numbered by time and hash, notes by path. A page's first known hash gives its url and type. An action
    that history doesn't name is `reference`. Vectors and links are reset: they are computed again.
    """
    order = [F.col("archived_at").asc_nulls_last(), F.col("content_hash")]
    sources = ranked(archive.dropDuplicates(["content_hash"]), [], order, "source_id")
    read = parsed_files(files).where("page is not null")
    numbered = ranked(read.select("path", "page", "hashes"), [], [F.col("path")], "note_id")
    cited = numbered.select("note_id", "path", F.posexplode("hashes").alias("place", "content_hash")).join(sources.select("content_hash", "source_id", "source_url", "source_type"), "content_hash")
    provenance = cited.join(actions, ["path", "content_hash"], "left").select("note_id", "source_id", F.coalesce("action", F.lit("reference")).alias("action"))
    first = cited.groupBy("note_id").agg(F.min_by(F.struct("source_url", "source_type"), "place").alias("s"))
    notes = numbered.join(first, "note_id", "left").select("note_id", "page.title", "page.type", "page.body", "page.tags", "page.links", F.col("path").alias("file_path"), "s.source_url", "s.source_type")
    return Catalogue(notes, sources, provenance, vectors.limit(0), links.limit(0))


def awaiting(archive: DataFrame, logged: DataFrame) -> DataFrame:
    """Archived sources, in the order of archiving, that a log does not name yet: what a recompile has left to do, or a restage can stage again."""
    return archive.join(logged.select("content_hash").distinct(), "content_hash", "left_anti").orderBy(F.col("archived_at").asc_nulls_last(), "content_hash")


def migrated_links(links: DataFrame) -> DataFrame:
    """Unordered pairs of links(source_note_id, target_note_id, similarity): the first of each, the one with the lowest pair as written, turned so that the smaller id comes first.

    Links to itself and with a null end go; similarity is that of the row kept (of equal rows the highest, nulls last).
    """
    pair = links.where("source_note_id <> target_note_id").withColumns({"a": F.least("source_note_id", "target_note_id"), "b": F.greatest("source_note_id", "target_note_id")})
    first = F.min_by("similarity", F.struct("source_note_id", "target_note_id", F.col("similarity").isNull(), -F.col("similarity")))
    return pair.groupBy(F.col("a").alias("source_note_id"), F.col("b").alias("target_note_id")).agg(first.alias("similarity"))
