"""Keeping derived tables in step: upserts, index identity, resumable sweeps, rebuilds, summaries and saved answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import notes_text as X
from tessera.functions.markdown import page_link
from tessera.functions.validation import ANSWER_TYPE, HEADINGS, PAGE_TYPES
from tessera.operators import graph
from tessera.operators.ranking import ranked

SMALL = 24


def upsert(stored: DataFrame, fresh: DataFrame, *keys: str) -> DataFrame:
    """stored with fresh rows in place of those with the same keys."""
    newest = fresh.dropDuplicates(list(keys)).select(*stored.columns)
    return stored.join(newest.select(*keys), list(keys), "left_anti").unionByName(newest)


def without(stored: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return stored.join(gone.select(*keys), list(keys), "left_anti")


def activated(vectors: DataFrame, links: DataFrame, current: str | None, wanted: str) -> tuple[DataFrame, DataFrame]:
    """Vectors and links after the index takes an identity: another one clears both."""
    same = current == wanted
    return (vectors, links) if same else (vectors.limit(0), links.limit(0))


def next_to_embed(notes: DataFrame, vectors: DataFrame, limit: int = 20) -> DataFrame:
    """The next notes without a vector, 1 to 100 at a time."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    return notes.join(vectors.select(F.col("id").alias("note_id")), "note_id", "left_anti").orderBy("note_id").limit(limit)


def unchanged_since(embedded: DataFrame, notes: DataFrame) -> DataFrame:
    """Vectors whose note still has the text they were made from (text_hash)."""
    now = notes.select("note_id", F.sha2(F.coalesce("body", F.lit("")), 256).alias("now"))
    return embedded.join(now, "note_id").where("text_hash = now").drop("now")


def small_collection_pairs(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """(left_id, right_id): all pairs of pages from different sources in a collection of at most 24 pages; none in a larger one.

    The guard is a count of at most 25 rows; within it there are at most 276 pairs.
    """
    pages = notes.select("note_id").distinct().limit(SMALL + 1)
    if pages.count() > SMALL:
        pages = pages.limit(0)
    all_ids = pages.agg(F.array_sort(F.collect_list("note_id")).alias("ids"))
    pair = F.explode(F.flatten(F.transform("ids", lambda a: F.transform(F.filter("ids", lambda b: b > a), lambda b: F.struct(a.alias("left_id"), b.alias("right_id"))))))
    pairs = all_ids.select(pair.alias("p")).select("p.*")
    shared = pairs.join(sources.select(F.col("note_id").alias("left_id"), "source_id"), "left_id").join(sources.select(F.col("note_id").alias("right_id"), "source_id"), ["right_id", "source_id"], "left_semi")
    return pairs.join(shared.select("left_id", "right_id"), ["left_id", "right_id"], "left_anti")


def may_resume(generation: DataFrame, candidates: DataFrame, hashes: DataFrame, scope: str, model: str, prompt: str, snapshot: str) -> bool:
    """Whether a stored generation (one row) can go on: same settings and snapshot, and every queued candidate's pages are unchanged."""
    same = (F.col("scope") == scope) & (F.col("model") == model) & (F.col("prompt_version") == prompt) & (F.col("page_snapshot_hash") == snapshot)
    if generation.where(same).isEmpty():
        return False
    stale = candidates.where("status = 'queued'")
    for side in ("left", "right"):
        now = hashes.select(F.col("note_id").alias(f"{side}_note_id"), F.col("evidence_hash").alias(f"{side}_now"))
        stale = stale.join(now, f"{side}_note_id", "left")
    bad = ~(F.col("left_hash").eqNullSafe(F.col("left_now")) & F.col("right_hash").eqNullSafe(F.col("right_now")))
    return stale.where(bad).isEmpty()


def recorded(candidates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Candidates after outcomes (fingerprint, status, discovery_id): only queued ones change, and `proposed` needs a discovery, others must have none."""
    good = outcomes.where((F.col("status") == "proposed") == F.col("discovery_id").isNotNull()).where("status in ('reviewed', 'proposed')").dropDuplicates(["fingerprint"])
    new = good.select("fingerprint", F.col("status").alias("new_status"), F.col("discovery_id").alias("new_discovery"))
    joined = candidates.join(new, "fingerprint", "left")
    change = (F.col("status") == "queued") & F.col("new_status").isNotNull()
    return joined.withColumns({"status": F.when(change, F.col("new_status")).otherwise(F.col("status")), "discovery_id": F.when(change, F.col("new_discovery")).otherwise(F.col("discovery_id"))}).select(*candidates.columns)


def source_summaries(findings: DataFrame) -> DataFrame:
    """(source_id, summary) of findings(source_id, position, title, body): the first three and how many more there are."""
    order = Window.partitionBy("source_id").orderBy("position")
    text = F.concat(X.excerpt(X.plain_text(F.col("title")), 120), F.lit(" — "), X.excerpt(X.plain_text(F.col("body")), 260))
    first = findings.withColumn("n", F.row_number().over(order)).where("n <= 3").select("source_id", "n", text.alias("text"))
    joined = first.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("f"))
    counts = findings.groupBy("source_id").agg((F.count("*") - 3).alias("more"))
    tail = F.when(F.col("more") > 0, F.concat(F.lit(" "), F.col("more").cast("string"), F.when(F.col("more") == 1, " additional finding captured.").otherwise(" additional findings captured."))).otherwise("")
    return joined.join(counts, "source_id").select("source_id", F.concat(F.lit("Key findings: "), F.array_join(F.transform("f", lambda x: x["text"]), " "), tail).alias("summary"))


def page_slice(text: Column, page: int) -> Column:
    """The text of one PDF page, between its marker and the next; null if there is no such page."""
    found = F.regexp_extract(text, rf"(?:^|\n)## PDF page {page}\n\n?([\s\S]*?)(?=\n\n## PDF page \d+\n|$)", 1)
    return F.when(F.rlike(text, F.lit(rf"(?m)^## PDF page {page}$")), X.stripped(found))


#: The steps that a stage of an ingest stands for.
STAGES = {
    "queued": ("current", "todo", "todo"), "reading": ("current", "todo", "todo"), "extracting": ("done", "current", "todo"), "integrating": ("done", "current", "todo"), "staged": ("done", "done", "current"),
    "applied": ("done", "done", "done"), "rejected": ("done", "done", "done"), "failed": ("error", "todo", "todo"),
}


def step_states(stage: Column) -> Column:
    """struct(read, draft, review) of a stage; null for an unknown one."""
    out = F.lit(None).cast("struct<read:string,draft:string,review:string>")
    for name, (a, b, c) in STAGES.items():
        out = F.when(stage == name, F.struct(F.lit(a).alias("read"), F.lit(b).alias("draft"), F.lit(c).alias("review"))).otherwise(out)
    return out


def same_members(left: Column, right: Column) -> Column:
    """Whether two arrays hold the same distinct entries."""
    return (F.size(F.array_except(left, right)) == 0) & (F.size(F.array_except(right, left)) == 0)


def saved_answer(notes: DataFrame, provenance: DataFrame, note_id: int, title: str, body: str, cited: list[int]) -> tuple[DataFrame, DataFrame]:
    """Notes and provenance with an answer as a new page: it links the cited pages and inherits all their sources. The title must be free."""
    if not notes.where(F.lower("title") == title.lower()).isEmpty():
        raise ValueError("a page has this title")
    links = [r["title"] for r in notes.where(F.col("note_id").isin(*cited)).orderBy("note_id").select("title").collect()]  # the cited pages, at most a dozen
    row = notes.sparkSession.createDataFrame([(note_id, title, ANSWER_TYPE, body, links)], "note_id bigint, title string, type string, body string, links array<string>")
    page = row.select(*(F.col(c) if c in row.columns else F.lit(None).cast(notes.schema[c].dataType).alias(c) for c in notes.columns))
    inherited = provenance.where(F.col("note_id").isin(*cited)).select("source_id").distinct().select(F.lit(note_id).cast("bigint").alias("note_id"), "source_id", F.lit("reference").alias("action"))
    return notes.unionByName(page), provenance.select("note_id", "source_id", "action").unionByName(inherited)


def rebuilt_provenance(pages: DataFrame, history_actions: DataFrame) -> DataFrame:
    """(note_id, source_id, action): what pages cite, with the action that history names, else `reference`."""
    return pages.join(history_actions, ["note_id", "source_id"], "left").select("note_id", "source_id", F.coalesce("action", F.lit("reference")).alias("action"))


def focus(edges: DataFrame, node: int) -> DataFrame:
    """A node and its direct neighbours."""
    near = graph.incident(edges).where(F.col("node") == node).select(F.col("other").alias("node"))
    return near.unionByName(edges.sparkSession.createDataFrame([(node,)], "node bigint")).distinct()


def candidate_pool(hits: DataFrame, per_note: int = 8, most: int = 40) -> DataFrame:
    """(note_id, first): the distinct candidates (seed position, rank) of several notes in order, at most 40 in all."""
    near = hits.where(F.col("position") <= per_note).groupBy("note_id").agg(F.min(F.struct("seed_id", "position")).alias("first"))
    return near.orderBy("first", "note_id").limit(most)


def migrated(zettels: DataFrame, episodes: DataFrame) -> DataFrame:
    """Notes from a legacy store: zettels(id, title, content, episode_id) with their episode's url."""
    return zettels.join(episodes.select(F.col("id").alias("episode_id"), "url"), "episode_id", "left").select(
        F.col("id").alias("note_id"), "title", F.col("content").alias("body"), F.col("url").alias("source_url"), F.concat(F.lit("notes/"), X.slug(F.col("title")), F.lit("-"), F.col("id").cast("string"), F.lit(".md")).alias("file_path")
    )


def portable_path(path: Column) -> Column:
    """A stored path relative to its vault: what follows the last notes/ or sources/ folder; others stay."""
    found = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:.*/)?((?:notes|sources)/.+)$", 1)
    return F.when(found != "", found).otherwise(path)


def index_lines(notes: DataFrame) -> DataFrame:
    """(section, heading, position, line): the page index, a row for each complete page, to be written in the order of section and position.

    Sections follow the page types' order; within one, titles are ordered by base letters (case and accents
    don't count), then by id. The line names the page and the one-line summary of its text. Nothing is
    gathered in one task, however many pages a section has.
    """
    pages = notes.where(F.col("title").isNotNull() & (F.col("body") != "") & F.col("type").isin(*PAGE_TYPES))
    pick = lambda values: F.element_at(F.create_map(*(F.lit(x) for pair in values for x in pair)), F.col("type"))
    rows = pages.select(
        pick([(t, i) for i, t in enumerate(PAGE_TYPES, 1)]).alias("section"), pick([(t, f"## {h}") for t, h in HEADINGS.items()]).alias("heading"), "note_id",
        F.collate(F.col("title"), "UNICODE_CI_AI").alias("letters"), F.concat(F.lit("- "), page_link(F.col("title")), F.lit(" — "), X.index_line(F.col("body"))).alias("line"),
    )
    return ranked(rows, ["section"], [F.col("letters"), F.col("note_id")]).select("section", "heading", "position", "line")


def pages_of_sources(provenance: DataFrame, notes: DataFrame) -> DataFrame:
    """(source_id, note_id, title, created_at, position): the pages of each source in the order of creation; one source may hold a large part of them."""
    joined = provenance.join(notes.select("note_id", "title", "created_at"), "note_id").select("source_id", "note_id", "title", "created_at")
    return ranked(joined, ["source_id"], [F.col("created_at"), F.col("note_id")])


def primary_sources(cited: DataFrame, sources: DataFrame) -> DataFrame:
    """(note_id, primary_source): the source of the first hash that a page names.

    cited(note_id, place, content_hash): the hashes of a page in order of place; sources(source_id,
    content_hash): of several with one hash the lowest id counts. Pages without a known hash give no row.
    """
    first = cited.groupBy("note_id").agg(F.min_by("content_hash", "place").alias("content_hash"))
    by_hash = sources.groupBy("content_hash").agg(F.min("source_id").alias("primary_source"))
    return first.join(by_hash, "content_hash").select("note_id", "primary_source")


def log_lines(entries: DataFrame, changes: DataFrame, key: str, operation: str) -> DataFrame:
    """(key, line_no, line): log entries as lines, a header, the source's hash, then a line for each change in page order.

    entries(key, at, subject, content_hash), changes(key, note_id, action, type, title). An entry may
    have any number of changes: lines are numbered without gathering them.
    """
    one, two = F.lit(1).cast("bigint"), F.lit(2).cast("bigint")
    head = entries.select(key, one.alias("line_no"), F.concat(F.lit("## ["), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f"Z] {operation} | "), "subject").alias("line"))
    digest = entries.select(key, two.alias("line_no"), F.concat(F.lit("- Source SHA-256: `"), "content_hash", F.lit("`")).alias("line"))
    rows = changes.select(key, "note_id", F.concat(F.lit("- "), "action", F.lit(" "), "type", F.lit(": "), page_link(F.col("title"))).alias("line"))
    body = ranked(rows, [key], [F.col("note_id")], "at").select(key, (F.col("at") + 2).alias("line_no"), "line")
    return head.unionByName(digest).unionByName(body)
