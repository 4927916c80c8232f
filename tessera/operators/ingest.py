"""From files and texts to sources, and from model notes to a reviewed change of the collection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import notes_text as X

#: What a file's extension makes of it.
KINDS = {"txt": "text", "md": "markdown", "markdown": "markdown", "pdf": "pdf", "vtt": "youtube"}
PdfText = Callable[[bytes], list[str]]


def pasted(df: DataFrame, title_col: str, text_col: str, limit: int = 250_000) -> DataFrame:
    """Sources from pasted texts: trimmed, hashed, with a problem where empty or too long."""
    text = X.stripped(F.regexp_replace(F.col(text_col), r"\r\n?", "\n"))
    problem = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty").when(F.length(text) > limit, "too_long")
    return df.select(F.sha2(text, 256).alias("content_hash"), F.trim(title_col).alias("title"), F.lit("text").alias("source_type"), text.alias("text"), problem.alias("problem"))


def files(df: DataFrame, limit_bytes: int = 25 * 1024 * 1024, pdf: PdfText | None = None) -> DataFrame:
    """Sources from files(path, content): type by extension, UTF-8 text, hash of the original bytes.

    PDFs need a reader that gives each page's text; without one they are reported. A PDF's text has a
    `## PDF page N` line before each page.
    """
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    kind = F.element_at(kinds, F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    rows = df.select("path", "content", kind.alias("source_type"), X.file_title(F.col("path")).alias("title"), F.octet_length("content").alias("size"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for content in frame["content"]:
                try:
                    pages = pdf(bytes(content)) if pdf else None
                    texts.append("\n\n".join(f"## PDF page {n}\n\n{p.strip()}" for n, p in enumerate(pages, 1) if p.strip()) if pages else None)
                except Exception:  # noqa: BLE001 - a bad file must not fail the others
                    texts.append(None)
            yield pd.DataFrame({"path": frame["path"], "pdf_text": texts})

    if pdf:
        read_pages = rows.where("source_type = 'pdf'").select("path", "content").mapInPandas(read, "path string, pdf_text string")
        rows = rows.join(read_pages, "path", "left")
    else:
        rows = rows.withColumn("pdf_text", F.lit(None).cast("string"))
    text = F.when(F.col("source_type") == "pdf", F.nullif("pdf_text", F.lit(""))).otherwise(X.decoded(F.col("content")))
    problem = F.when(F.col("source_type").isNull(), "unknown_type").when(F.col("size") > limit_bytes, "too_large").when(text.isNull(), F.when(F.col("source_type") == "pdf", "no_text").otherwise("not_utf8_or_empty"))
    return rows.select(F.sha2("content", 256).alias("content_hash"), "title", "source_type", text.alias("text"), problem.alias("problem"))


def expanded_playlist(df: DataFrame, id_col: str, videos_col: str, most: int = 10) -> DataFrame:
    """(id, url, position): the distinct valid videos of each list, at most `most`."""
    urls = F.array_distinct(F.array_compact(F.transform(videos_col, lambda v: X.video_url(v))))
    return df.select(id_col, F.posexplode(F.slice(urls, 1, most)).alias("at", "url")).select(id_col, "url", (F.col("at") + 1).alias("position"))


def unseen(arriving: DataFrame, archive: DataFrame) -> DataFrame:
    """Arriving sources without a problem whose hash the archive lacks, one row for each hash."""
    fresh = arriving.where("problem is null").groupBy("content_hash").agg(F.min_by(F.struct("title", "source_type", "text"), "title").alias("s")).select("content_hash", "s.*")
    return fresh.join(archive.select("content_hash"), "content_hash", "left_anti")


def rewritten_links(pages: DataFrame, renames: DataFrame) -> DataFrame:
    """pages(note_id, links) with links to renamed titles: renames(from_title, to_title), compared in lower case; first spelling kept."""
    exploded = pages.select("note_id", F.posexplode_outer("links").alias("at", "link"))
    named = renames.groupBy(F.lower("from_title").alias("key")).agg(F.min("to_title").alias("to_title"))
    mapped = exploded.join(named, F.lower("link") == F.col("key"), "left").select("note_id", "at", F.coalesce("to_title", "link").alias("link"))
    whole = mapped.groupBy("note_id").agg(F.array_sort(F.collect_list(F.when(F.col("link").isNotNull(), F.struct("at", "link")))).alias("l"))
    return whole.select("note_id", X.distinct_ignoring_case(F.transform("l", lambda x: x["link"])).alias("links"))


def selected_changes(changes: DataFrame, current: DataFrame, decisions: DataFrame) -> DataFrame:
    """(change_id, status) for a review: excluded, stale, title_taken or apply.

    changes(change_id, action, note_id, title, base_hash), current(note_id, title, hash), decisions(change_id, include).
    A change of a page whose text has moved on since is stale; a new page must not take a title in use.
    """
    chosen = changes.join(decisions, "change_id", "left").join(current.select("note_id", F.col("hash").alias("now")), "note_id", "left")
    taken = current.select(F.lower("title").alias("key")).where("key is not null").distinct().withColumn("taken", F.lit(True))
    known = chosen.join(taken, F.lower("title") == F.col("key"), "left")
    status = (
        F.when(~F.coalesce("include", F.lit(False)), "excluded")
        .when((F.col("action") != "new") & ~F.col("base_hash").eqNullSafe(F.col("now")), "stale")
        .when((F.col("action") == "new") & F.coalesce("taken", F.lit(False)), "title_taken")
        .otherwise("apply")
    )
    return known.select("change_id", status.alias("status"))


def decision_summary(decisions: DataFrame, *by: str) -> DataFrame:
    """(by, include, exclude, pending, can_approve): approval needs every change decided and one included."""
    counts = decisions.groupBy(*by).agg(F.count_if(F.coalesce("include", F.lit(False))).alias("include"), F.count_if(~F.coalesce("include", F.lit(True))).alias("exclude"), F.count_if(F.col("include").isNull()).alias("pending"))
    return counts.withColumn("can_approve", (F.col("pending") == 0) & (F.col("include") > 0))


def applied(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """The next notes snapshot: changes(note_id, title, body, type) replace pages or add them."""
    columns = notes.columns
    fresh = changes.select(*(F.col(c) if c in changes.columns else F.lit(None).cast(notes.schema[c].dataType).alias(c) for c in columns))
    return notes.join(changes.select("note_id"), "note_id", "left_anti").unionByName(fresh)


def immutable_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """(note_id): pages whose title or type changed, which a rewrite must not do."""
    b = before.select("note_id", F.col("title").alias("bt"), F.col("type").alias("bk"))
    return after.join(b, "note_id").where(~F.col("title").eqNullSafe(F.col("bt")) | ~F.col("type").eqNullSafe(F.col("bk"))).select("note_id")


def attached(provenance: DataFrame, fresh: DataFrame) -> DataFrame:
    """Provenance (note_id, source_id, action) after an upsert: the fresh action counts."""
    newest = fresh.dropDuplicates(["note_id", "source_id"]).select("note_id", "source_id", "action")
    return provenance.select("note_id", "source_id", "action").join(newest, ["note_id", "source_id"], "left_anti").unionByName(newest)


def chosen_pairs(discoveries: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, l, r): the pair of each discovery (id, page_ids) to link: the first unlinked one across sources, else the first unlinked one."""
    from pyspark.sql import Window

    pages = F.array_sort(F.array_distinct("page_ids"))
    pairs = F.flatten(F.transform(pages, lambda a: F.transform(F.filter(pages, lambda b: b > a), lambda b: F.struct(a.alias("l"), b.alias("r")))))
    rows = discoveries.select("id", F.posexplode(pairs).alias("at", "p")).select("id", "at", "p.l", "p.r")
    open_pairs = rows.join(edges.select(F.col("source").alias("l"), F.col("target").alias("r")), ["l", "r"], "left_anti")
    shared = open_pairs.join(sources.select(F.col("note_id").alias("l"), "source_id"), "l").join(sources.select(F.col("note_id").alias("r"), "source_id"), ["r", "source_id"], "left_semi").select("l", "r").distinct()
    marked = open_pairs.join(shared.withColumn("same", F.lit(1)), ["l", "r"], "left")
    first = Window.partitionBy("id").orderBy(F.coalesce("same", F.lit(0)), "at")
    return marked.withColumn("n", F.row_number().over(first)).where("n = 1").select("id", "l", "r")


def confirmed(notes: DataFrame, links: DataFrame, explanation: str | None = None, confirmed_at: str | None = None) -> DataFrame:
    """notes(note_id, links, relationships) with confirmed links (note_id, title, type) added once, at the end.

    With an explanation each also gets a relationship of its type; one to the same target and of the same
    type is replaced. A page gains few links at a time, so its lists stay bounded.
    """
    added = links.groupBy("note_id").agg(F.array_sort(F.collect_set("title")).alias("more"), *([F.array_sort(F.collect_set(F.struct("title", "type"))).alias("_r")] if explanation else []))
    joined = notes.join(added, "note_id", "left")
    empty = F.array().cast("array<string>")
    out = joined.withColumn("links", F.when(F.col("more").isNull(), F.col("links")).otherwise(X.distinct_ignoring_case(F.concat(F.coalesce("links", empty), F.coalesce("more", empty)))))
    if explanation:
        kind = notes.schema["relationships"].dataType
        known = {"explanation": F.lit(explanation), "confirmedAt": F.lit(confirmed_at)}
        fresh = F.transform("_r", lambda r: F.struct(*(r["title"].alias("target") if f.name == "target" else r["type"].alias("type") if f.name == "type" else known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.elementType.fields)))
        old = F.filter(F.coalesce("relationships", F.array().cast(kind)), lambda o: ~F.exists("_r", lambda r: (F.lower(r["title"]) == F.lower(o["target"])) & (r["type"] == o["type"])))
        out = out.withColumn("relationships", F.when(F.col("_r").isNull(), F.col("relationships")).otherwise(F.concat(old, fresh.cast(kind))))
    return out.select(*notes.columns)
