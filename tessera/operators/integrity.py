"""History, verification, undo, journals, proposals and export of a content-hashed archive.

State is never changed in place: each function maps snapshots to the next one or to findings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ranking import ranked


def first_applied(history: DataFrame) -> DataFrame:
    """(source_hash, archived_at): the earliest time at which each source was applied."""
    return history.groupBy("source_hash").agg(F.min("applied_at").alias("archived_at"))


def action_per_page(changes: DataFrame) -> DataFrame:
    """(note_id, source_id, action, conflict): the one action of each pair; conflict where there are several."""
    sets = changes.where("action is not null").groupBy("note_id", "source_id").agg(F.array_sort(F.collect_set("action")).alias("a"))
    return sets.select("note_id", "source_id", F.when(F.size("a") == 1, F.get("a", F.lit(0))).alias("action"), (F.size("a") > 1).alias("conflict"))


def latest_undoable(history: DataFrame, undone: DataFrame) -> DataFrame:
    """The newest ingest (by applied_at, then history_id) without an undo receipt."""
    return history.join(undone.select("history_id"), "history_id", "left_anti").orderBy(F.desc("applied_at"), F.desc("history_id")).limit(1)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """(key, change, before_hash, after_hash) for keys that are new, removed or changed."""
    b, a = before.select(key, F.col(digest).alias("before_hash")), after.select(key, F.col(digest).alias("after_hash"))
    both = b.withColumn("_b", F.lit(True)).join(a.withColumn("_a", F.lit(True)), key, "full_outer")
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "removed").when(~F.col("before_hash").eqNullSafe(F.col("after_hash")), "changed")
    return both.select(key, change.alias("change"), "before_hash", "after_hash").where("change is not null")


def classify_journal(journal: DataFrame, current: DataFrame) -> DataFrame:
    """(path, step): done, apply or conflict for each file of a journal (path, before, after) against (path, hash); null is absent."""
    joined = journal.join(current.select("path", F.col("hash").alias("now")), "path", "left")
    step = F.when(F.col("now").eqNullSafe(F.col("after")), "done").when(F.col("now").eqNullSafe(F.col("before")), "apply").otherwise("conflict")
    return joined.select("path", step.alias("step"))


def may_commit(classified: DataFrame) -> bool:
    return classified.where("step = 'conflict'").isEmpty()


def hash_mismatches(rows: DataFrame, id_col: str, content: Column, stored: Column) -> DataFrame:
    """(id, computed): rows whose stored SHA-256 is not that of the content."""
    computed = F.sha2(content, 256)
    return rows.where(~stored.eqNullSafe(computed)).select(id_col, computed.alias("computed"))


def verify(notes: DataFrame, sources: DataFrame, provenance: DataFrame) -> DataFrame:
    """(code, item): what would stop a rebuild: shared titles, pages without or with unknown sources, broken links, shared hashes."""
    keyed = notes.withColumn("key", F.lower("title"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1 and key is not null").select(F.lit("duplicate_title").alias("code"), F.col("key").alias("item"))
    known = provenance.join(sources.select("source_id").distinct(), "source_id", "left_semi").select("note_id").distinct()
    lacking = notes.join(known, "note_id", "left_anti").select(F.lit("missing_provenance").alias("code"), F.col("note_id").cast("string").alias("item"))
    unknown = provenance.join(sources.select("source_id").distinct(), "source_id", "left_anti").select(F.lit("unknown_source").alias("code"), F.col("source_id").cast("string").alias("item")).distinct()
    links = notes.select(F.explode("links").alias("link")).where("link is not null and link <> ''").select(F.lower("link").alias("key")).distinct()
    broken = links.join(keyed.select("key").distinct(), "key", "left_anti").select(F.lit("broken_link").alias("code"), F.col("key").alias("item"))
    hashes = sources.groupBy("content_hash").agg(F.countDistinct("source_id").alias("n")).where("n > 1").select(F.lit("duplicate_source").alias("code"), F.col("content_hash").alias("item"))
    return reduce(DataFrame.unionByName, (shared, lacking, unknown, broken, hashes))


def grouped_targets(decisions: DataFrame) -> DataFrame:
    """(existing_id, incoming, action): one rewrite for each target page; a contradiction outweighs merges."""
    rows = decisions.where("existing_id is not null")
    action = F.when(F.bool_or(F.col("action") == "contradict"), "contradict").otherwise("merge")
    return rows.groupBy("existing_id").agg(F.array_sort(F.collect_list("incoming_id")).alias("incoming"), action.alias("action"))


def outcome_counts(rows: DataFrame, outcome: str, values: tuple[str, ...], *by: str) -> DataFrame:
    """One row (for each `by`) with the number of rows of each outcome."""
    return rows.groupBy(*by).agg(*(F.count_if(F.col(outcome) == v).alias(v) for v in values))


def proposal_problems(changes: DataFrame, most: int = 12) -> DataFrame:
    """(proposal_id, problem) of proposals with no or too many changes, or with a page or title twice. changes(proposal_id, note_id, title)."""
    per = changes.groupBy("proposal_id").agg(
        F.count("*").alias("n"), F.count("note_id").alias("ids"), F.countDistinct("note_id").alias("distinct_ids"), F.countDistinct(F.lower("title")).alias("titles"), F.count("title").alias("all_titles")
    )
    found = F.array_compact(F.array(F.when(F.col("n") > most, "too_many_changes"), F.when(F.col("distinct_ids") < F.col("ids"), "page_twice"), F.when(F.col("titles") < F.col("all_titles"), "title_twice")))
    return per.select("proposal_id", F.explode(found).alias("problem"))


def export_manifest(files: DataFrame) -> DataFrame:
    """(path, size, hash, name, prefix) of files(path, content), in path order: how a ustar archive would hold each of them.

    Paths up to 100 bytes are a name; longer ones are cut at a slash into a prefix (155) and a name
    (100). Paths that leave the folder, or fit neither way, are left out.
    """
    from tessera.functions.notes_text import safe_relative_path

    path = F.col("path")
    cut = F.regexp_extract(path, r"^(.{1,155})/([^/].{0,99})$", 1)
    fits = F.octet_length(path) <= 100
    named = files.where(safe_relative_path(path)).select(
        "path", F.octet_length("content").cast("bigint").alias("size"), F.sha2(F.col("content"), 256).alias("hash"),
        F.when(fits, path).otherwise(F.regexp_extract(path, r"^(.{1,155})/([^/].{0,99})$", 2)).alias("name"), F.when(fits, "").otherwise(cut).alias("prefix"),
    )
    return named.where("name <> ''").orderBy("path")


def write_archive(manifest_rows, content_of, out) -> int:
    """Streams files into a tar in path order. manifest_rows: an iterable with path; content_of(path) gives bytes. Returns the count."""
    import io
    import tarfile

    n = 0
    with tarfile.open(fileobj=out, mode="w|", format=tarfile.USTAR_FORMAT) as tar:
        for row in manifest_rows:
            data = content_of(row["path"])
            info = tarfile.TarInfo(row["path"])
            info.size, info.mode, info.mtime = len(data), 0o644, 0
            tar.addfile(info, io.BytesIO(data))
            n += 1
    return n


def replace_snapshot(df: DataFrame, folder: str, version: str) -> str:
    """Writes the next snapshot beside the last and then names it current: readers see the old or the new one, never a part or none.

    A snapshot counts once its marker file is there; the newest marker, by number, is the current one. A marker is
    created in one step and never replaced, so of two writers of one number the second fails.
    """
    spark: SparkSession = df.sparkSession
    target = f"{folder}/v={version}"
    df.write.mode("errorifexists").parquet(target)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    markers = path(f"{folder}/CURRENT")
    fs.mkdirs(markers)
    taken = [int(x.getPath().getName().split("-", 1)[0]) for x in fs.listStatus(markers)]
    stream = fs.create(path(f"{folder}/CURRENT/{max(taken, default=0) + 1:012d}-{version}"), False)
    stream.close()
    return target


def current_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path
    markers = path(f"{folder}/CURRENT")
    names = [x.getPath().getName() for x in markers.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(markers)]
    return spark.read.parquet(f"{folder}/v={max(names).split('-', 1)[1]}")


def write_files(files: DataFrame, folder: str) -> None:
    """Writes files(path, content), strings, under a folder, each as a file of its own; the executors write. The folder is a path or URI that they share."""
    root = folder if ":" in folder.split("/")[0] else f"file://{folder}"
    root = root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file://") else root

    def write(rows):
        import pyarrow.fs as pafs

        system, base = pafs.FileSystem.from_uri(root)
        for row in rows:
            target = f"{base}/{row['path']}"
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(target) as out:
                out.write(row["content"].encode())

    files.foreachPartition(write)


def _remove(folder: str, paths: list[str]) -> None:
    import pyarrow.fs as pafs

    system, base = pafs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{folder}")
    for path in paths:
        system.delete_file(f"{base}/{path}")


def current_files(spark: SparkSession, folder: str, paths: DataFrame) -> DataFrame:
    """(path, hash) of those of paths(path) that are files under the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.split(":", 1)[-1].rstrip("/").replace("//", "/")
    named = files.select(F.substring_index("path", f"{base}/", -1).alias("path"), F.sha2("content", 256).alias("hash"))
    return named.join(paths.select("path").distinct(), "path", "left_semi")


def prepare_operation(changes: DataFrame, journal: str) -> DataFrame:
    """Stores the journal of changes(path, before, after), texts with null for no file, before any file is touched: (path, before_text, after_text, before, after)."""
    digest = lambda c: F.sha2(F.col(c), 256)
    changes.select("path", F.col("before").alias("before_text"), F.col("after").alias("after_text"), digest("before").alias("before"), digest("after").alias("after")).write.mode("errorifexists").parquet(journal)
    return changes.sparkSession.read.parquet(journal)


def complete_operation(spark: SparkSession, folder: str, journal: str, back: bool = False) -> int:
    """Brings the files of a stored journal forward, or back, and removes the journal; gives the number of files written or removed.

    May be run again after a crash at any point: files that are done are left alone. A file that is neither as
    before nor as after stops it with nothing changed. Files to remove are named to the driver: an operation has few.
    """
    rows = spark.read.parquet(journal)
    if back:
        rows = rows.select("path", F.col("after_text").alias("before_text"), F.col("before_text").alias("after_text"), F.col("after").alias("before"), F.col("before").alias("after"))
    steps = classify_journal(rows, current_files(spark, folder, rows)).persist()
    if not may_commit(steps):
        raise RuntimeError("a file has changed since the operation began")
    todo = rows.join(steps.where("step = 'apply'"), "path", "left_semi")
    count = todo.count()
    gone = [r["path"] for r in todo.where("after_text is null").select("path").collect()]
    write_files(todo.where("after_text is not null").select("path", F.col("after_text").alias("content")), folder)
    _remove(folder, gone)
    steps.unpersist()
    path = spark._jvm.org.apache.hadoop.fs.Path(journal)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return count


ALLOWED_FILES = ("meta.json", "source.txt", "summary.md")


def archived_sources(spark: SparkSession, folder: str, strict: bool = False, expected: DataFrame | None = None, most: int = 0, most_bytes: int = 0) -> DataFrame:
    """(content_hash, title, sourceUrl, sourceType, text, problem) of an archive folder sources/<hash>/{meta.json,source.txt,summary.md,original.*}.

    problem names a folder whose name, metadata and content hash do not agree; strict also those with
    another file. expected(content_hash, text_hash) gives the hash of the extracted text where it is not the
    source's own. An archive of more than `most` sources or `most_bytes` (0: no bound) is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/sources")
    if most or most_bytes:
        size = files.agg(F.countDistinct(F.regexp_extract("path", r"/sources/([^/]+)/", 1)).alias("n"), F.sum("length").alias("bytes")).first()
        if (most and size["n"] > most) or (most_bytes and (size["bytes"] or 0) > most_bytes):
            raise ValueError("the archive is larger than its bounds")
    at = F.regexp_extract("path", r"/sources/([^/]+)/([^/]+)$", 1)
    named = files.select(at.alias("dir"), F.regexp_extract("path", r"/([^/]+)$", 1).alias("file"), "content")
    content = lambda name: F.max(F.when(F.col("file") == name, F.col("content")))
    other = ~F.col("file").isin(*ALLOWED_FILES) & ~F.col("file").startswith("original.")
    # One pass: a folder holds a few files.
    whole = named.groupBy("dir").agg(
        F.from_json(content("meta.json").cast("string"), "contentHash string, title string, sourceUrl string, sourceType string").alias("m"), content("source.txt").alias("source"),
        F.max(F.when(F.col("file").startswith("original."), F.sha2("content", 256))).alias("original"), F.max(other).alias("other"),
    )
    joined = whole.join(expected.select(F.col("content_hash").alias("dir"), "text_hash"), "dir", "left") if expected is not None else whole.withColumn("text_hash", F.lit(None).cast("string"))
    computed = F.sha2("source", 256)
    identity = F.when(F.col("text_hash").isNotNull(), F.when(computed == F.col("text_hash"), F.col("dir"))).otherwise(F.coalesce("original", computed))
    agrees = (F.col("dir") == F.col("m.contentHash")) & F.col("m.contentHash").eqNullSafe(identity)
    problem = F.when(F.col("m").isNull(), "missing_metadata").when(F.col("source").isNull(), "missing_text").when(~F.coalesce(agrees, F.lit(False)), "hash_mismatch").when(F.lit(strict) & F.col("other"), "unexpected_file")
    return joined.select(F.col("dir").alias("content_hash"), "m.title", "m.sourceUrl", "m.sourceType", F.col("source").cast("string").alias("text"), problem.alias("problem"))


def in_archive_order(archived: DataFrame, history: DataFrame) -> DataFrame:
    """Archived sources with archived_at, the time of their first ingest in history(source_hash, applied_at), in that order, then by hash; those without one come last."""
    first = first_applied(history).withColumnRenamed("source_hash", "content_hash")
    return archived.join(first, "content_hash", "left").orderBy(F.col("archived_at").asc_nulls_last(), "content_hash")


def vault_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, page) of Markdown files under notes/, without index and log; page is null where the format does not hold."""
    from tessera.functions.markdown import parsed_page

    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(f"{folder}/notes")
    named = files.select(F.regexp_extract(F.input_file_name(), r"/(notes/.+)$", 1).alias("path"), "value")
    return named.where(~F.rlike("path", F.lit(r"/(index|log)\.md$"))).select("path", parsed_page(F.col("value")).alias("page"))


def history_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each change of each history manifest."""
    schema = "historyId string, proposalId bigint, sourceHash string, sourceTitle string, appliedAt string, reviewMode string, batchId string, changes array<struct<action:string,pageTitle:string,notePath:string,beforeRevision:string,beforeHash:string,afterHash:string>>"
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").json(f"{folder}/history")
    return rows.select("historyId", "proposalId", "sourceHash", "sourceTitle", F.try_to_timestamp("appliedAt").alias("applied_at"), "reviewMode", "batchId", F.explode_outer("changes").alias("change")).select("*", "change.*").drop("change")


def logged_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(content_hash): source hashes that a log names."""
    lines = spark.read.text(path).select(F.regexp_extract("value", r"^- Source SHA-256: `([a-f0-9]{64})`", 1).alias("content_hash"))
    return lines.where("content_hash <> ''").distinct()


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with stable ids from 1 in the given order."""
    return ranked(df, [], [F.col(c) for c in order], name)
