"""References to records that do not exist, as keyed state that batches move on.

The state lives in a folder of append-only logs, each partitioned by a hash bucket of its key:
parents by (kind, key), records by (kind, record_id) with their keys and removals, and references
with their orphan flag, what it was before, and the version. `advance` takes a batch of new parents, references
and removals: new references probe the parent index, arriving parents resolve waiting orphans,
removals reopen references that had been resolved. A batch reads the buckets that its keys fall
into (a small one only its keys' rows, which lie sorted) and appends what has changed; the rest of
the state is neither read nor written. Counts follow from the changes, up to any version.

A reference is an orphan unless a parent with its key is no later than it and not removed. Batches
may come in any order and repeat rows: the state depends on the rows seen alone. The newest version
of a reference counts.

Keys may be hot: references are reduced to their earliest time per (field, note, target) before any
shuffle, the probe spreads a key's references over `slices` tasks (the index, one row for a key, is
repeated instead), and a bucket is written by as many tasks.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.functions.text import title_key
from tessera.session import ensure_checkpoint_dir, parallelism

PARENTS = "kind string, key string, record_id bigint, since timestamp"
REFERENCES = "ref_field string, note_id bigint, target string, kind string, key string, at timestamp"
REMOVALS = "kind string, record_id bigint"
LOGS = {
    "parents": PARENTS + ", gone boolean, version int", "records": "kind string, record_id bigint, key string, gone boolean", "references": REFERENCES + ", orphan boolean, version int, old_at timestamp, was boolean",
}
REFERENCE = ("ref_field", "note_id", "target", "kind", "key")
SLICES = 4
FEW_KEYS = 500  # a batch of up to so many keys names them to the scan


@dataclass(frozen=True)
class OrphanState:
    """The state after `version` batches. One folder belongs to one line of batches: an older state must not be moved on again."""

    spark: SparkSession
    folder: str
    buckets: int
    slices: int = SLICES
    version: int = 0

    def log(self, name: str) -> DataFrame:
        """A log as far as it has come with `version`, with its bucket; empty before the first batch."""
        schema = LOGS[name] + ", bucket int"
        if not self.version:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        # A batch that failed and is tried again may have left rows of its version.
        return rows.where(F.col("version") <= self.version) if "version" in rows.columns else rows

    @property
    def references(self) -> DataFrame:
        """REFERENCES with `orphan`: the newest version of each."""
        return _newest(self.log("references")).select(*REFERENCE, "at", "orphan")


def empty_state(spark: SparkSession, folder: str | None = None, buckets: int | None = None, slices: int = SLICES) -> OrphanState:
    """A state without rows, in a folder of its own under the shared checkpoint folder unless one is given; as many buckets as keep all cores busy."""
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/orphans-{uuid.uuid4().hex}"
    return OrphanState(spark, folder, buckets or max(2, parallelism(spark) // slices), slices)


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*REFERENCE).agg(F.max(F.struct("version", "at", "orphan")).alias("r")).select(*REFERENCE, "r.at", "r.orphan")


def _bucket(state: OrphanState, *keys: str) -> Column:
    return F.pmod(F.hash(*keys), F.lit(state.buckets))


def _append(state: OrphanState, name: str, rows: DataFrame, keys: tuple[str, str], spread_by: str) -> None:
    """Appends rows to a log, sorted by key within each file; a bucket's rows are shared out by the hash of spread_by."""
    placed = rows.withColumns({"bucket": _bucket(state, *keys), "_slice": F.pmod(F.xxhash64(spread_by), F.lit(state.slices))})
    placed = placed.repartition(min(parallelism(state.spark), state.buckets * state.slices), "bucket", "_slice").drop("_slice").sortWithinPartitions("bucket", *keys)
    placed.write.mode("append").partitionBy("bucket").parquet(f"{state.folder}/{name}")


def _touching(state: OrphanState, name: str, touched: DataFrame, keys: tuple[str, str], buckets: list[int], few: list | None) -> DataFrame:
    """The rows of a log with touched keys: other buckets, and with few keys other rows of a bucket, stay unread."""
    rows = state.log(name).where(F.col("bucket").isin(buckets))
    if few is not None:
        rows = rows.where(F.col(keys[1]).isin(few))
    return rows.join(touched.select(*keys), list(keys), "left_semi")


def _places(state: OrphanState, touched: DataFrame, keys: tuple[str, str]) -> tuple[list[int], list | None]:
    """The buckets of touched keys, at most state.buckets, and the keys themselves if there are few."""
    found = touched.agg(F.count("*").alias("n"), F.collect_set(_bucket(state, *keys)).alias("buckets")).first()
    few = [r[0] for r in touched.select(keys[1]).distinct().collect()] if found["n"] <= FEW_KEYS else None
    return found["buckets"], few


def probe(references: DataFrame, index: DataFrame, slices: int = SLICES) -> DataFrame:
    """references with `orphan`; a reference without a time is an orphan only if its key leads nowhere."""
    spread = index.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    placed = references.withColumn("_slice", F.pmod(F.hash("note_id", "ref_field", "target"), F.lit(slices)))
    orphan = F.col("since").isNull() | F.coalesce(F.col("since") > F.col("at"), F.lit(False))
    return placed.join(spread, ["kind", "key", "_slice"], "left").withColumn("orphan", orphan).drop("_slice", "since")


def advance(state: OrphanState, parents: DataFrame, references: DataFrame, removals: DataFrame) -> OrphanState:
    """The state after a batch of PARENTS, REFERENCES and REMOVALS rows."""
    by_key, by_record, version = ("kind", "key"), ("kind", "record_id"), state.version + 1
    after = replace(state, version=version)
    gone_now = removals.select("kind", "record_id").distinct()
    arriving = parents.groupBy("kind", "key", "record_id").agg(F.min("since").alias("since"))
    fresh = references.groupBy(*REFERENCE).agg(F.min("at").alias("at"))
    # Arriving records that were or are removed, and known ones that are removed now.
    known_gone, lost = gone_now, None
    if state.version:
        named = parents.select(*by_record).unionByName(gone_now).distinct()
        held = _touching(state, "records", named, by_record, *_places(state, named, by_record))
        known_gone = held.where("gone").select(*by_record).unionByName(gone_now).distinct()
        lost = held.where(~F.col("gone")).join(gone_now, list(by_record), "left_semi")
        lost = lost.select("kind", "key", "record_id", F.lit(None).cast("timestamp").alias("since"), F.lit(True).alias("gone")).distinct()
    delta = arriving.join(known_gone.withColumn("gone", F.lit(True)), list(by_record), "left").select("kind", "key", "record_id", "since", F.coalesce("gone", F.lit(False)).alias("gone"))
    delta = delta.unionByName(lost) if lost is not None else delta
    _append(state, "parents", delta.withColumn("version", F.lit(version)), by_key, "record_id")
    touched = after.log("parents").where(F.col("version") == version).select(*by_key).unionByName(fresh.select(*by_key)).distinct()
    if state.version:
        places = _places(state, touched, by_key)
        seen = _touching(after, "parents", touched, by_key, *places)
        held_refs = _newest(_touching(state, "references", touched, by_key, *places))
    else:
        seen, held_refs = after.log("parents"), state.references
    records = seen.groupBy("kind", "key", "record_id").agg(F.min("since").alias("since"), F.max("gone").alias("gone"))
    index = records.where(~F.col("gone")).groupBy(*by_key).agg(F.min("since").alias("since"))
    both = fresh.select(*REFERENCE, "at", F.lit(None).cast("timestamp").alias("old_at"), F.lit(None).cast("boolean").alias("was"))
    both = both.unionByName(held_refs.select(*REFERENCE, "at", F.col("at").alias("old_at"), F.col("orphan").alias("was")))
    merged = both.groupBy(*REFERENCE).agg(F.min("at").alias("at"), F.min("old_at").alias("old_at"), F.max("was").alias("was"))
    judged = probe(merged, index, state.slices)
    changed = judged.where(F.col("was").isNull() | (F.col("was") != F.col("orphan")) | ~F.col("at").eqNullSafe(F.col("old_at")))
    _append(state, "references", changed.select(*REFERENCE, "at", "orphan", F.lit(version).alias("version"), "old_at", "was"), by_key, "note_id")
    records = arriving.select("kind", "record_id", "key", F.lit(False).alias("gone")).unionByName(gone_now.select("kind", "record_id", F.lit(None).cast("string").alias("key"), F.lit(True).alias("gone")))
    _append(state, "records", records, by_record, "key")
    return after


def snapshot_counts(state: OrphanState) -> DataFrame:
    """(ref_field, month, references, orphans) per field and month of the reference, from the changes of each batch up to the state's version."""
    # A batch that was tried again has written its changes twice.
    changes = state.log("references").dropDuplicates([*REFERENCE, "version"])
    month = lambda c: F.date_format(c, "yyyy-MM").alias("month")
    one, flag = F.lit(1).cast("bigint"), lambda c: F.col(c).cast("bigint")
    now = changes.select("ref_field", month("at"), one.alias("references"), flag("orphan").alias("orphans"))
    before = changes.where("was is not null").select("ref_field", month("old_at"), (-one).alias("references"), (-flag("was")).alias("orphans"))
    sums = now.unionByName(before).groupBy("ref_field", "month").agg(F.sum("references").alias("references"), F.sum("orphans").alias("orphans"))
    return sums.where("references > 0")


def _entries(value: Column) -> Column:
    """Entries of an array that refer to something: not null and not blank."""
    return F.filter(value, lambda x: x.isNotNull() & (F.length(x) > 0))


def note_references(notes: DataFrame, note_sources: DataFrame) -> DataFrame:
    """Titles in notes.links and notes.relationships.target and ids in note_sources.source_id, as REFERENCES rows."""
    links = notes.select(F.lit("links").alias("ref_field"), "note_id", F.explode(_entries(F.array_distinct("links"))).alias("target"), F.col("created_at").alias("at"))
    related = (
        notes.select("note_id", F.explode("relationships").alias("r"))
        .where(F.length("r.target") > 0)
        .select(F.lit("relationships").alias("ref_field"), "note_id", F.col("r.target").alias("target"), F.expr("try_cast(r.confirmedAt as timestamp)").alias("at"))
    )
    titles = links.unionByName(related).groupBy("ref_field", "note_id", "target").agg(F.min("at").alias("at"))
    titles = titles.select("ref_field", "note_id", "target", F.lit("note").alias("kind"), title_key("target").alias("key"), "at").where("key <> ''")
    ids = (
        note_sources.where("source_id is not null")
        .groupBy("note_id", "source_id")
        .agg(F.min("attached_at").alias("at"))
        .select(F.lit("note_sources").alias("ref_field"), "note_id", F.col("source_id").cast("string").alias("target"), F.lit("source").alias("kind"), F.col("source_id").cast("string").alias("key"), "at")
    )
    return titles.unionByName(ids)


def note_parents(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """Notes by title and sources by id, as PARENTS rows: each record's earliest time."""
    by_title = notes.where("title is not null").groupBy("note_id", "title").agg(F.min("created_at").alias("since"))
    by_title = by_title.select(F.lit("note").alias("kind"), title_key("title").alias("key"), F.col("note_id").alias("record_id"), "since").where("key <> ''")
    by_id = sources.where("source_id is not null").groupBy("source_id").agg(F.min("created_at").alias("since"))
    by_id = by_id.select(F.lit("source").alias("kind"), F.col("source_id").cast("string").alias("key"), F.col("source_id").alias("record_id"), "since")
    return by_title.unionByName(by_id)


def note_periods(months: int, at: Column) -> Column:
    """The number of a time's period of so many calendar months; rows without a time come first."""
    return F.coalesce(F.floor((F.year(at) * 12 + F.month(at) - 1) / months).cast("int"), F.lit(-1))


def orphan_state(notes: DataFrame, sources: DataFrame, note_sources: DataFrame, removals: DataFrame, months: int = 12) -> OrphanState:
    """The state after all rows of the tables, in batches of `months` calendar months in the order of time.

    A batch has the records created, the references made and the removals of its period. Null and
    empty entries are no references; references of removed notes count; repeated rows count once;
    empty tables give an empty state; other columns are ignored.
    """
    spark = notes.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/orphan-events-{uuid.uuid4().hex}"
    gone = removals.select(F.lower(F.trim("record_kind")).alias("kind"), "record_id", F.col("removed_at").alias("at") if "removed_at" in removals.columns else F.lit(None).cast("timestamp").alias("at")).where("record_id is not null")
    events = {"parents": (note_parents(notes, sources), "since"), "references": (note_references(notes, note_sources), "at"), "removals": (gone, "at")}
    periods: set[int] = set()
    for name, (rows, at) in events.items():
        rows.withColumn("period", note_periods(months, F.col(at))).write.partitionBy("period").parquet(f"{folder}/{name}")
    read = {name: spark.read.schema(StructType([*rows.schema.fields, StructField("period", IntegerType())])).parquet(f"{folder}/{name}") for name, (rows, _) in events.items()}
    for rows in read.values():  # a number for each period of the calendar that occurs: the names of folders
        periods.update(r[0] for r in rows.select("period").distinct().collect())
    state = empty_state(spark)
    for period in sorted(periods):
        part = {name: rows.where(F.col("period") == period).drop("period") for name, rows in read.items()}
        state = advance(state, part["parents"], part["references"], part["removals"])
    return state
