"""The capabilities of the service as Python functions over a set of tables.

A `Vault` holds DataFrames; every function returns a DataFrame and reads nothing before it is used,
except single numbers that choose a plan (is the vector index complete, does any page hold all terms).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import discovery, duplicates, graph, hybrid, ingest, integrity, lexical, lifecycle, lint, maintenance, providers, vectors
from tessera.plans import retrieval
from tessera.sources.tables import table

QUERY_LIMIT, RESULTS = 500, 20


class IncompleteIndex(RuntimeError):
    """Semantic search asked for while some pages have no vector."""


@dataclass(frozen=True)
class Vault:
    notes: DataFrame  # note_id, title, type, body, tags, links, relationships
    sources: DataFrame  # source_id, content_hash, title, source_url, source_type
    provenance: DataFrame  # note_id, source_id, action
    vectors: DataFrame  # id, v
    links: DataFrame  # source_note_id, target_note_id, similarity

    @staticmethod
    def load(spark: SparkSession, sf_dir: str) -> Vault:
        acts = table(spark, sf_dir, "note_sources").where("note_id is not null and source_id is not null").select("note_id", "source_id", "action").distinct()
        sources = table(spark, sf_dir, "sources").where("source_id is not null").dropDuplicates(["source_id"])
        return Vault(retrieval.notes(spark, sf_dir), sources, acts, retrieval.note_vectors(spark, sf_dir), table(spark, sf_dir, "links"))

    @property
    def note_sources(self) -> DataFrame:
        return self.provenance.select("note_id", "source_id").distinct()


def notes(vault: Vault) -> DataFrame:
    return vault.notes.orderBy(F.desc("created_at"), "note_id")


def note_detail(vault: Vault, note_id: int) -> DataFrame:
    """The page with its sources and their actions."""
    held = vault.provenance.join(vault.sources.select("source_id", F.col("title").alias("source_title"), "content_hash"), "source_id")
    listed = held.where(F.col("note_id") == note_id).groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "source_title", "content_hash", "action"))).alias("evidence"))
    return vault.notes.where(F.col("note_id") == note_id).join(listed, "note_id", "left")


def note_by_title(vault: Vault, title: str) -> DataFrame:
    return vault.notes.where(F.lower("title") == title.lower()).orderBy("note_id").limit(1)


def sources(vault: Vault) -> DataFrame:
    counts = vault.note_sources.groupBy("source_id").agg(F.count("*").alias("pages"))
    return vault.sources.join(counts, "source_id", "left").withColumn("pages", F.coalesce("pages", F.lit(0).cast("bigint"))).orderBy("source_id")


def source_detail(vault: Vault, source_id: int) -> DataFrame:
    return vault.note_sources.where(F.col("source_id") == source_id).join(vault.notes.select("note_id", "title", "type", "created_at"), "note_id").orderBy("created_at", "note_id")


def semantic_status(vault: Vault) -> DataFrame:
    return vectors.index_status(vault.notes, vault.vectors)


def search(vault: Vault, query: str, mode: str = "hybrid", query_vector: list[float] | None = None, limit: int = RESULTS) -> DataFrame:
    """(note_id, title, score, match_type). Hybrid falls back to keywords while the index is incomplete or no query vector is there; semantic then fails."""
    query = query.strip()
    if len(query) > QUERY_LIMIT:
        raise ValueError(f"a query has at most {QUERY_LIMIT} characters")
    if mode not in ("keyword", "semantic", "hybrid"):
        raise ValueError("mode is keyword, semantic or hybrid")
    keyword = lexical.keyword_search(vault.notes, query, limit=limit)
    by_rank = keyword.select("note_id", "title", (-F.col("rank")).alias("score"), F.lit("keyword").alias("match_type"))
    if not query or mode == "keyword":
        return by_rank
    complete = query_vector is not None and semantic_status(vault).first()["complete"]
    if not complete:
        if mode == "semantic":
            raise IncompleteIndex("the vector index is not complete")
        return by_rank
    near = vectors.nearest_to(vault.vectors, query_vector, limit).withColumnRenamed("id", "note_id")
    if mode == "semantic":
        return near.join(vault.notes.select("note_id", "title"), "note_id").select("note_id", "title", F.col("similarity").alias("score"), F.lit("semantic").alias("match_type"))
    ranked = hybrid.positions(keyword, F.round("rank", 10), "note_id")
    return hybrid.fuse(ranked, hybrid.positions(near, F.round("similarity", 12).desc(), "note_id"), vault.notes, query, limit)


def page_graph(vault: Vault) -> DataFrame:
    return graph.graph_edges(vault.notes, vault.links)


def related(vault: Vault, note_id: int) -> DataFrame:
    return graph.related(page_graph(vault), vault.notes, F.lit(note_id)).orderBy("position")


def rebuild_links(vault: Vault, k: int = 8) -> DataFrame:
    return vectors.mutual_links(vault.vectors, vault.note_sources, k)


def lint_report(vault: Vault) -> DataFrame:
    return lint.ordered(lint.report(vault.notes, vault.provenance))


def verify(vault: Vault) -> DataFrame:
    return integrity.verify(vault.notes, vault.sources, vault.note_sources)


def export_manifest(files: DataFrame) -> DataFrame:
    return integrity.export_manifest(files)


def stage_sources(vault: Vault, arriving: DataFrame) -> DataFrame:
    """Arriving sources that the archive does not hold yet."""
    return ingest.unseen(arriving, vault.sources)


def integrate(vault: Vault, incoming: DataFrame, decisions: DataFrame) -> DataFrame:
    """Safeguarded decisions for incoming notes (note_id, title, body) given a model's decisions."""
    found = duplicates.strongest_of(incoming, vault.notes)
    both = vault.notes.select("note_id", "title", "body").unionByName(incoming.select("note_id", "title", "body"))
    return duplicates.safeguarded(decisions, found, both)


def generate_candidates(vault: Vault, seeds: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Candidate pairs for review from seeds (note_id), against all pages."""
    rows = vault.vectors.join(seeds.select(F.col("note_id").alias("id")), "id", "left_semi")
    near = vectors.nearest_of_all(rows, vault.vectors, discovery.NEAREST - 1)
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    asked = vault.notes.join(seeds.select("note_id"), "note_id", "left_semi").select(F.col("note_id").alias("seed_id"), text.alias("text"))
    hits = lexical.integration_candidates(vault.notes, asked, limit=discovery.LEXICAL)
    pairs = graph.explicit_edges(vault.notes).select(F.col("source").alias("l"), F.col("target").alias("r"))
    return discovery.candidates(near, hits, vault.notes, vault.note_sources, pairs if known is None else pairs.unionByName(known))


def question_context(vault: Vault, question: str, query_vector: list[float] | None = None) -> DataFrame:
    """(note_id, position, content): the pages to answer a question from, their text cut at 12 000 characters."""
    spark = vault.notes.sparkSession
    asked = spark.createDataFrame([(0, question)], "seed_id bigint, text string")
    keyword = lexical.integration_candidates(vault.notes, asked, limit=6).select("note_id", "position")
    semantic = keyword.limit(0)
    if query_vector is not None and semantic_status(vault).first()["complete"]:
        near = vectors.nearest_to(vault.vectors, query_vector, 8).withColumnRenamed("id", "note_id")
        semantic = hybrid.positions(near, F.round("similarity", 12).desc(), "note_id").select("note_id", "position")
    chosen = hybrid.question_context(keyword, semantic, page_graph(vault))
    return chosen.join(vault.notes.select("note_id", F.substring("body", 1, 12_000).alias("content")), "note_id").orderBy("position")


# ---- reviewed changes -----------------------------------------------------------------------
def _catalogue(vault: Vault, history: DataFrame | None = None) -> lifecycle.Catalogue:
    return lifecycle.Catalogue(vault.notes, vault.sources, vault.provenance, vault.vectors, vault.links, history)


def _vault(after: lifecycle.Catalogue) -> Vault:
    return Vault(after.notes, after.sources, after.provenance, after.vectors, after.links)


def proposals(stored: DataFrame, status: str | None = None) -> DataFrame:
    """Stored proposals (proposal_id, status, created_at, ...), newest first; `open` are those that wait for a decision."""
    rows = stored if status is None else stored.where(F.col("status").isin("pending", "investigating") if status == "open" else F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), F.desc("proposal_id"))


def draft_proposal(stored: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (change_id, include) of a proposal after more of them: the newest decision on a change counts. Nothing is applied."""
    return maintenance.upsert(stored, decisions, "change_id")


def reject_proposal(stored: DataFrame, proposal_id: int) -> DataFrame:
    """(id, status, applied) of all proposals (id, status) after one is rejected; only a pending one can be."""
    command = stored.sparkSession.createDataFrame([(proposal_id, "rejected")], "id bigint, to string")
    return discovery.guarded(stored, command, {"rejected": ("pending",)})


def approve_proposal(vault: Vault, changes: DataFrame, decisions: DataFrame, source_id: int, history_id: str, applied_at, history: DataFrame | None = None, vectors: DataFrame | None = None) -> tuple[Vault, DataFrame, DataFrame | None]:
    """(vault, statuses, history) after the chosen changes of a proposal, all or none: see lifecycle.approve. Every change needs a decision, and one must be included."""
    if not ingest.decision_summary(changes.select("change_id").join(decisions, "change_id", "left")).first()["can_approve"]:
        raise ValueError("every change needs a decision, and one must be included")
    after, statuses = lifecycle.approve(_catalogue(vault, history), changes, decisions, source_id, history_id, applied_at, vectors)
    return _vault(after), statuses, after.history


def restage_source(vault: Vault, archive: DataFrame, content_hash: str) -> DataFrame:
    """An archived source to be staged again: it must be in the archive, and no page may have it as a source."""
    held = vault.sources.where(F.col("content_hash") == content_hash).join(vault.note_sources, "source_id", "left_semi")
    return archive.where(F.col("content_hash") == content_hash).join(held.select("content_hash"), "content_hash", "left_anti")


def undo_last(vault: Vault, history: DataFrame, undone: DataFrame) -> tuple[Vault, str | None, DataFrame | None]:
    """(vault, history_id, conflicts) after undoing the newest ingest without a receipt; a conflict leaves the vault as it is."""
    newest = lifecycle.latest_undoable(history, undone)
    if newest is None:
        return vault, None, None
    after, conflicts = lifecycle.undo(_catalogue(vault, history), newest)
    return _vault(after), newest, conflicts


def rebuild(files: DataFrame, archive: DataFrame, actions: DataFrame, vault: Vault) -> Vault:
    """A vault from its files alone; what stands against it is an error. Vectors and links are reset."""
    if not lifecycle.rebuild_problems(lifecycle.parsed_files(files), archive).isEmpty():
        raise ValueError("the files don't make a catalogue: see lifecycle.rebuild_problems")
    return _vault(lifecycle.rebuilt(files, archive, actions, vault.vectors, vault.links))


def rebuild_semantic(vault: Vault, embed: Callable, dims: int, limit: int = 20) -> Vault:
    """The vault with vectors for the next notes that have none; links are computed once all have one."""
    todo = maintenance.next_to_embed(vault.notes.select("note_id", F.concat_ws("\n", "title", "body").alias("text")), vault.vectors, limit)
    fresh = providers.embedded(todo, "note_id", "text", embed, dims).select(F.col("note_id").alias("id"), F.col("vector").alias("v")).where("v is not null")
    after = replace(vault, vectors=vault.vectors.unionByName(fresh))
    return replace(after, links=rebuild_links(after)) if semantic_status(after).first()["complete"] else after


def discoveries(stored: DataFrame, vault: Vault, status: str | None = None) -> DataFrame:
    """Stored discoveries (id, status, page_ids) with their pages' titles and number of primary sources."""
    rows = stored if status is None else stored.where(F.col("status").isin("pending", "investigating") if status == "open" else F.col("status") == status)
    primary = vault.note_sources.groupBy("note_id").agg(F.min("source_id").alias("primary_source"))
    return rows.join(discovery.hydrated(rows, vault.notes, primary), "id", "left").orderBy("id")


def review_discoveries(stored: DataFrame, commands: DataFrame) -> DataFrame:
    """(id, status, applied) after commands (id, to): investigate pending ones, reject open ones. Confirming adds links: see confirm_discoveries."""
    return discovery.guarded(stored.select("id", "status"), commands, {"investigating": ("pending",), "rejected": ("pending", "investigating")})


def confirm_discoveries(vault: Vault, stored: DataFrame, ids: list[int], phrase: str, explanation: str, confirmed_at: str) -> tuple[Vault, DataFrame]:
    """(vault, discoveries) after confirming open discoveries, all or none: each chosen pair gets a link and a relationship.

    phrase must be `CONFIRM n LINKS`. Fails if one of them is not open.
    """
    if phrase != f"CONFIRM {len(set(ids))} LINKS":
        raise ValueError(f"the phrase must be CONFIRM {len(set(ids))} LINKS")
    chosen = stored.where(F.col("id").isin(*ids) & F.col("status").isin("pending", "investigating"))
    pairs = ingest.chosen_pairs(chosen, graph.explicit_edges(vault.notes), vault.note_sources)
    if pairs.count() != len(set(ids)):
        raise ValueError("a discovery is not open, or its pages are linked already")
    titles = vault.notes.select(F.col("note_id").alias("r"), "title")
    named = pairs.join(titles, "r").join(chosen.select("id", "type"), "id").select(F.col("l").alias("note_id"), "title", "type")
    notes = ingest.confirmed(vault.notes, named, explanation, confirmed_at)
    status = F.when(F.col("id").isin(*ids), "confirmed").otherwise(F.col("status"))
    return replace(vault, notes=notes), stored.withColumn("status", status)


# ---- questions and findings -----------------------------------------------------------------
def ask(vault: Vault, question: str, chat: Callable[[str], str], query_vector: list[float] | None = None) -> DataFrame:
    """(answer, cited, error): a model's answer from the question's context; one that is empty or cites pages outside it has no answer."""
    context = question_context(vault, question, query_vector)
    held = context.join(vault.notes.select("note_id", "title"), "note_id").agg(F.array_sort(F.collect_list(F.struct("position", "note_id", "title", "content"))).alias("c"))  # at most a dozen pages
    pages = F.array_join(F.transform("c", lambda p: F.concat(F.lit("["), p["note_id"].cast("string"), F.lit("] "), p["title"], F.lit("\n"), F.coalesce(p["content"], F.lit("")))), "\n\n")
    prompts = held.select(F.lit(0).cast("bigint").alias("id"), F.concat(F.lit(f"Answer from these pages alone and cite their numbers.\nQuestion: {question}\n\n"), pages).alias("prompt"), F.col("c.note_id").alias("ids"))
    replies = providers.asked(prompts.select("id", "prompt"), "id", "prompt", chat)
    checked = replies.join(prompts.select("id", "ids"), "id").select(providers.valid_answer(F.col("reply"), F.col("ids")).alias("a"), "error")
    return checked.select("a.answer", "a.cited", F.when(F.col("a").isNull(), F.coalesce("error", F.lit("the answer cites no page of its context"))).alias("error"))


def save_answer(vault: Vault, note_id: int, title: str, body: str, cited: list[int]) -> Vault:
    """The vault with an answer as a page that links the pages it cites and has their sources."""
    notes, provenance = maintenance.saved_answer(vault.notes, vault.provenance, note_id, title, body, cited)
    return replace(vault, notes=notes, provenance=provenance)


def lint_analyze(vault: Vault, chat: Callable[[str], str]) -> DataFrame:
    """(severity, message, pages): a model's findings on at most a dozen pages, those with issues first."""
    issues = lint_report(vault).groupBy(F.col("page_id").alias("note_id")).agg(F.count("*").alias("n"))
    first = vault.notes.where("body is not null").join(issues, "note_id", "left").orderBy(F.coalesce("n", F.lit(0).cast("bigint")).desc(), "note_id").limit(12)
    held = first.agg(F.array_sort(F.collect_list(F.struct("note_id", "title", F.substring("body", 1, 12_000).alias("content")))).alias("c"))
    text = F.array_join(F.transform("c", lambda p: F.concat(F.lit("["), p["note_id"].cast("string"), F.lit("] "), F.coalesce(p["title"], F.lit("")), F.lit("\n"), p["content"])), "\n\n")
    prompts = held.select(F.lit(0).cast("bigint").alias("id"), F.concat(F.lit("Name contradictions and gaps in these pages.\n\n"), text).alias("prompt"), F.col("c.note_id").alias("ids"))
    replies = providers.asked(prompts.select("id", "prompt"), "id", "prompt", chat).join(prompts.select("id", "ids"), "id")
    return providers.valid_findings(replies, F.col("ids")).drop("id")
