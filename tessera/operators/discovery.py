"""Candidate pairs across sources, their evidence hashes and the review generations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.duplicates import only
from tessera.session import cut_lineage

MIN_SEMANTIC, MIN_LEXICAL, BODY_WEIGHT = 0.5, 0.12, 0.65
NEAREST, PER_PAGE, LEXICAL = 64, 8, 16


def evidence(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """(note_id, evidence_hash): notes with at least one source; SHA-256 of title, type, body and sorted source ids as JSON."""
    of = sources.groupBy("note_id").agg(F.array_sort(F.collect_set("source_id")).alias("sourceIds"))
    text = F.to_json(F.struct("title", "type", "body", "sourceIds"), {"ignoreNullFields": "false"})
    return notes.join(of, "note_id").select("note_id", F.sha2(text, 256).alias("evidence_hash"))


def lexical_similarity(title_l: Column, title_r: Column, body_l: Column, body_r: Column) -> Column:
    """The better of the titles' Jaccard and 0.65 of the bodies', from token arrays."""
    return F.greatest(T.jaccard(title_l, title_r), BODY_WEIGHT * T.jaccard(body_l, body_r))


def tokenised(notes: DataFrame, prefix: str) -> DataFrame:
    empty = F.lit("")
    return notes.select(
        F.col("note_id").alias(f"{prefix}_id"), T.discovery_tokens(F.coalesce("title", empty)).alias(f"{prefix}_title"), T.discovery_tokens(F.coalesce("body", empty)).alias(f"{prefix}_body")
    )


def pair_similarity(pairs: DataFrame, notes: DataFrame) -> DataFrame:
    """pairs(l_id, r_id, ...) with lexical similarity."""
    both = pairs.join(tokenised(notes, "l"), "l_id").join(tokenised(notes, "r"), "r_id")
    return both.withColumn("lexical", lexical_similarity(F.col("l_title"), F.col("r_title"), F.col("l_body"), F.col("r_body"))).drop("l_title", "l_body", "r_title", "r_body")


def candidates(nearest: DataFrame, lexical_hits: DataFrame, notes: DataFrame, sources: DataFrame, excluded: DataFrame) -> DataFrame:
    """(left_id, right_id, score, lexical, semantic) of pairs worth a review.

    nearest(left_id, right_id, similarity, position) has each seed's nearest 64; lexical_hits(seed_id,
    note_id). Pairs sharing a source, known pairs (excluded: l, r) and pairs under both thresholds drop
    out first; of a seed's nearest that are left, the 8 nearest stay. Lexical hits have no quota. The
    best score of a pair counts. (A pair that an earlier seed has added counts towards a later seed's
    quota here; so the result doesn't depend on the order of seeds.)
    """
    eligible = sources.select(F.col("note_id").alias("id")).distinct()
    sem = nearest.select(F.col("left_id").alias("l_id"), F.col("right_id").alias("r_id"), F.col("similarity").alias("semantic"), "position")
    lex = lexical_hits.select(F.col("seed_id").alias("l_id"), F.col("note_id").alias("r_id"), F.lit(None).cast("double").alias("semantic"), F.lit(0).alias("position"))
    pairs = sem.unionByName(lex).where("l_id <> r_id")
    for side in ("l_id", "r_id"):
        pairs = pairs.join(eligible.withColumnRenamed("id", side), side, "left_semi")
    known = excluded.select(F.least("l", "r").alias("x"), F.greatest("l", "r").alias("y")).distinct()
    pairs = cut_lineage(pairs.join(known, (F.least("l_id", "r_id") == F.col("x")) & (F.greatest("l_id", "r_id") == F.col("y")), "left_anti"))
    # Only the nominated pairs' own sources are compared: the pair is the key, so a large source is no hot key.
    named = pairs.select("l_id", "r_id").distinct()
    mine = named.join(sources.select(F.col("note_id").alias("l_id"), "source_id"), "l_id")
    overlap = mine.join(sources.select(F.col("note_id").alias("r_id"), "source_id"), ["r_id", "source_id"], "left_semi").select("l_id", "r_id").distinct()
    # Each pair is compared once, in one direction, and only pages that a pair names are tokenised.
    apart = named.join(overlap, ["l_id", "r_id"], "left_anti").select(F.least("l_id", "r_id").alias("l_id"), F.greatest("l_id", "r_id").alias("r_id")).distinct()
    wanted = apart.select(F.explode(F.array("l_id", "r_id")).alias("note_id")).distinct()
    alike = pair_similarity(apart, only(notes, wanted).dropDuplicates(["note_id"])).select(F.col("l_id").alias("x"), F.col("r_id").alias("y"), "lexical")
    scored = pairs.join(alike, (F.least("l_id", "r_id") == F.col("x")) & (F.greatest("l_id", "r_id") == F.col("y"))).drop("x", "y")
    passed = scored.where((F.coalesce("semantic", F.lit(0.0)) >= MIN_SEMANTIC) | (F.col("lexical") >= MIN_LEXICAL))
    order = Window.partitionBy("l_id").orderBy("position")
    near = passed.where("semantic is not null").withColumn("n", F.row_number().over(order)).where(F.col("n") <= PER_PAGE).drop("n")
    strong = near.unionByName(passed.where("semantic is null"))
    score = F.least(F.lit(1.0), F.greatest(F.coalesce(F.greatest("semantic", F.lit(0.0)), F.lit(0.0)), F.col("lexical")))
    keyed = strong.select(F.least("l_id", "r_id").alias("left_id"), F.greatest("l_id", "r_id").alias("right_id"), score.alias("score"), "lexical", "semantic")
    return keyed.groupBy("left_id", "right_id").agg(F.max(F.struct("score", "semantic", "lexical")).alias("b")).select("left_id", "right_id", "b.score", "b.lexical", "b.semantic")


def fingerprint(prompt: str, model: str, left_id: Column, left_hash: Column, right_id: Column, right_hash: Column) -> Column:
    """SHA-256 of the JSON that names the prompt, the model and both pages with their hashes, the smaller id first."""
    page = lambda i, h: F.concat(F.lit("["), i.cast("string"), F.lit(',"'), h, F.lit('"]'))
    first = left_id <= right_id
    a, b = page(F.when(first, left_id).otherwise(right_id), F.when(first, left_hash).otherwise(right_hash)), page(F.when(first, right_id).otherwise(left_id), F.when(first, right_hash).otherwise(left_hash))
    return F.sha2(F.concat(F.lit(f'{{"promptVersion":"{prompt}","model":"{model}","left":'), a, F.lit(',"right":'), b, F.lit("}")), 256)


def snapshot_hash(hashes: DataFrame, block: int = 1000) -> DataFrame:
    """(snapshot_hash): SHA-256 of the JSON list [[id,"hash"],...] of all pages in id order; of [] for no page.

    Blocks of ids are written as text in parallel. SHA-256 itself is sequential, so one task reads the
    blocks in order as a stream; it holds one Arrow batch at a time and sorting may spill.
    """
    entry = F.concat(F.lit("["), F.col("note_id").cast("string"), F.lit(',"'), F.col("evidence_hash"), F.lit('"]'))
    blocks = hashes.groupBy(F.floor(F.col("note_id") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("note_id", entry.alias("e")))).alias("es"))
    texts = blocks.select("block", F.array_join(F.transform("es", lambda x: x["e"]), ",").alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, first = hashlib.sha256(b"["), True
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text is not None:
                    state.update(("" if first else ",").encode() + text.encode())
                    first = False
        state.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()])], names=["snapshot_hash"])

    # A row without text, so that the list of no page has a hash too.
    start = hashes.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("block"), F.lit(None).cast("string").alias("text"))
    return texts.unionByName(start).repartition(1).sortWithinPartitions("block").select("text").mapInArrow(digest, "snapshot_hash string")


def restage(stored: DataFrame, fresh: DataFrame, generation: int) -> DataFrame:
    """Candidates after staging: a known fingerprint moves to the new generation with new scores and keeps its status."""
    new = fresh.select("fingerprint", F.col("score").alias("new_score"), F.lit(True).alias("seen"))
    both = stored.join(new, "fingerprint", "full_outer")
    return both.select(
        "fingerprint", F.when(F.col("seen"), F.lit(generation)).otherwise(F.col("generation")).alias("generation"), F.coalesce("new_score", "score").alias("score"), F.coalesce("status", F.lit("queued")).alias("status")
    )


def coverage(stored: DataFrame) -> DataFrame:
    """(generation, queued, reviewed, proposed, total, evaluated, remaining, complete) for each generation."""
    counts = stored.groupBy("generation").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("queued", "reviewed", "proposed")), F.count("*").alias("total"))
    return counts.select("*", (F.col("reviewed") + F.col("proposed")).alias("evaluated"), F.col("queued").alias("remaining"), (F.col("queued") == 0).alias("complete"))


def dequeue(stored: DataFrame, generation: int, limit: int = 20, batch: int = 5) -> DataFrame:
    """(fingerprint, score, batch): the next queued candidates by score, in batches."""
    top = stored.where((F.col("generation") == generation) & (F.col("status") == "queued")).orderBy(F.desc("score"), "fingerprint").limit(limit)
    return top.select("fingerprint", "score", (F.floor((F.row_number().over(Window.orderBy(F.desc("score"), "fingerprint")) - 1) / batch) + 1).cast("int").alias("batch"))


def known_pairs(discoveries: DataFrame, hashes: DataFrame) -> DataFrame:
    """(l, r) of pages of a discovery (id, page_ids, page_hashes) all of whose stored hashes are still current."""
    entries = discoveries.select("id", F.posexplode("page_ids").alias("pos", "note_id"), "page_hashes").select("id", "note_id", F.get("page_hashes", F.col("pos")).alias("stored"))
    checked = entries.join(hashes, "note_id", "left").groupBy("id").agg(F.bool_and(F.coalesce(F.col("stored") == F.col("evidence_hash"), F.lit(False))).alias("current"))
    valid = discoveries.join(checked.where("current"), "id")
    pages = F.array_sort(F.array_distinct("page_ids"))
    pairs = F.flatten(F.transform(pages, lambda a: F.transform(F.filter(pages, lambda b: b > a), lambda b: F.struct(a.alias("l"), b.alias("r")))))
    return valid.select(F.explode(pairs).alias("p")).select("p.l", "p.r").distinct()


def insert_or_ignore(stored: DataFrame, fresh: DataFrame, key: str = "fingerprint") -> DataFrame:
    """stored with the first of the fresh rows whose key is new."""
    return stored.unionByName(fresh.join(stored.select(key), key, "left_anti").dropDuplicates([key]).select(*stored.columns))


def guarded(state: DataFrame, commands: DataFrame, allowed: dict[str, tuple[str, ...]], key: str = "id") -> DataFrame:
    """(key, status, applied): the state after commands (key, to); applied is null without a command.

    A command is applied if the current status is among those that `allowed` names for its target.
    """
    may = F.lit(False)
    for target, before in allowed.items():
        may = may | ((F.col("to") == target) & F.col("status").isin(*before))
    joined = state.join(commands.select(key, "to"), key, "left")
    applied = F.when(F.col("to").isNotNull(), may)
    return joined.select(key, F.when(applied, F.col("to")).otherwise(F.col("status")).alias("status"), applied.alias("applied"))


def stale(discoveries: DataFrame, hashes: DataFrame) -> DataFrame:
    """(id, changed): how many of a discovery's pages are gone or no longer have the stored hash."""
    entries = discoveries.select("id", F.posexplode("page_ids").alias("pos", "note_id"), "page_hashes").select("id", "note_id", F.get("page_hashes", F.col("pos")).alias("stored"))
    return entries.join(hashes, "note_id", "left").groupBy("id").agg(F.count_if(~F.coalesce(F.col("stored") == F.col("evidence_hash"), F.lit(False))).alias("changed"))


def hydrated(discoveries: DataFrame, notes: DataFrame, primary: DataFrame) -> DataFrame:
    """(id, pages, sources) of discoveries(id, page_ids): each page's id and title in id order, and the number of primary sources.

    primary(note_id, primary_source). A discovery names few pages, so its list is bounded; unknown pages are left out, null titles are empty.
    """
    pages = discoveries.select("id", F.explode("page_ids").alias("note_id"))
    rows = pages.join(notes.select("note_id", F.coalesce("title", F.lit("")).alias("title")), "note_id").join(primary, "note_id", "left")
    return rows.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("note_id", "title"))).alias("pages"), F.countDistinct("primary_source").alias("sources"))
