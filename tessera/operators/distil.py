"""From source texts to reviewed pages around a model: extraction by chunk, consolidation, decisions, rewriting, and sweeps over stored candidates.

A model is a picklable callable; its replies are checked, and what fails a check is asked for once
more or falls back to a deterministic result, so a failed item never stops the others.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import notes_text as X
from tessera.functions.validation import PAGE_TYPES
from tessera.operators import chunking, discovery, duplicates, maintenance, providers
from tessera.session import cut_lineage

#: A prompt, the most tokens of the reply and a temperature (None: the model's own) give the reply and whether it was cut off.
Model = Callable[[str, int, float | None], tuple[str, bool]]
#: Limits of a finding and of a reply.
TITLE, BODY, TAGS, LINKS, PAGES, TOKENS, MOST_TOKENS, CHUNKS = 120, 4_000, 3, 8, 50, 4_000, 16_000, 32
FINDING = "title string, body string, type string, tags array<string>, links array<string>, pages array<int>"


def reply_of(model: Model, prompt: str, wanted: str, tokens: int = TOKENS) -> tuple[str | None, str | None]:
    """(reply, error): a JSON object that has the wanted list. A cut-off reply is asked for again with twice the tokens, steadily; a wrong one once more."""
    temperature, wrong, error = None, 0, None
    while True:
        try:
            text, cut = model(prompt, tokens, temperature)
            if cut and tokens < MOST_TOKENS:
                tokens, temperature = min(2 * tokens, MOST_TOKENS), 0.0
                continue
            found = providers.json_object(text)
            if isinstance(found.get(wanted), list):
                return json.dumps(found), None
            error = f"no list of {wanted}"
        except Exception as e:  # noqa: BLE001 - a failed item must not fail the others
            error = str(e)[:500]
        wrong += 1
        if wrong > 1:
            return None, error


def replies(df: DataFrame, keys: tuple[str, ...], model: Model, wanted: str) -> DataFrame:
    """(keys, reply, error) for df(keys, prompt)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [reply_of(model, p, wanted) for p in frame["prompt"]]
            yield frame[list(keys)].assign(reply=[r for r, _ in got], error=[e for _, e in got])

    return df.select(*keys, "prompt").mapInPandas(run, ", ".join(f"{k} bigint" for k in keys) + ", reply string, error string")


def _bounded(value: Column, most: int) -> Column:
    return F.slice(X.distinct_ignoring_case(F.coalesce(value, F.array().cast("array<string>"))), 1, most)


def _findings(rows: DataFrame, keys: tuple[str, ...], seen: Column) -> DataFrame:
    """(keys, at, finding) of replies that are good findings: known type, bounded texts; pages are those that the text shows."""
    found = rows.select(*keys, seen.alias("_seen"), F.posexplode(F.from_json("reply", f"findings array<struct<{FINDING}>>")["findings"]).alias("at", "f"))
    f = found.select(*keys, "at", "_seen", F.trim("f.title").alias("title"), F.trim("f.body").alias("body"), F.col("f.type").alias("type"), _bounded(F.col("f.tags"), TAGS).alias("tags"), _bounded(F.col("f.links"), LINKS).alias("links"), F.col("f.pages").alias("pages"))
    good = F.length("title").between(1, TITLE) & F.length("body").between(1, BODY) & F.col("type").isin(*PAGE_TYPES)
    pages = F.slice(F.array_sort(F.array_intersect(F.coalesce("pages", F.array().cast("array<int>")), "_seen")), 1, PAGES)
    return f.where(good).select(*keys, "at", F.struct("title", "body", "type", "tags", "links", pages.alias("pages")).alias("finding"))


def extracted(sources: DataFrame, model: Model, limit: int = 12_000, overlap: int = 500) -> tuple[DataFrame, DataFrame]:
    """(findings, errors): findings(source_id, chunk_no, at, finding) of each chunk of sources(source_id, text), in order; errors(source_id, error).

    A source of more than CHUNKS chunks is an error, and gives no finding. Pages are kept only if the chunk has them.
    """
    chunks = cut_lineage(chunking.chunked(sources, "source_id", "text", limit, overlap))
    many = chunks.groupBy("source_id").agg(F.count("*").alias("n")).where(F.col("n") > CHUNKS)
    prompts = chunks.join(many, "source_id", "left_anti").select("source_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk", F.concat(F.lit('Extract findings as JSON {"findings": [...]}.\n\n'), "chunk").alias("prompt"))
    got = cut_lineage(replies(prompts, ("source_id", "chunk_no"), model, "findings"))
    shown = prompts.select("source_id", "chunk_no", F.transform(F.regexp_extract_all("chunk", F.lit(r"(?m)^## PDF page (\d+)"), F.lit(1)), lambda p: p.cast("int")).alias("shown"))
    found = _findings(got.where("reply is not null").join(shown, ["source_id", "chunk_no"]), ("source_id", "chunk_no"), F.col("shown"))
    errors = got.where("reply is null").select("source_id", "error").unionByName(many.select("source_id", F.lit(f"more than {CHUNKS} chunks").alias("error")))
    return found, errors


def consolidated(findings: DataFrame, model: Model) -> DataFrame:
    """(source_id, position, FINDING columns): findings of one chunk as they are; those of several merged by the model, which names the places each comes from.

    Tags, links and pages of merged findings are united, first come first. Without a good reply findings of one title are one, the first.
    A source has at most CHUNKS chunks of bounded findings, so its list is bounded.
    """
    listed = findings.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "at", "finding"))).alias("l"), F.countDistinct("chunk_no").alias("chunks"))
    listed = cut_lineage(listed.select("source_id", F.transform("l", lambda x: x["finding"]).alias("fs"), "chunks"))
    text = F.array_join(F.transform("fs", lambda f, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), f["title"], F.lit("\n"), f["body"])), "\n\n")
    prompts = listed.where("chunks > 1").select("source_id", F.concat(F.lit('Merge these findings as JSON {"merged": [{"title", "body", "type", "from"}]}.\n\n'), text).alias("prompt"))
    merged = F.from_json("reply", "merged array<struct<title:string,body:string,type:string,from:array<int>>>")["merged"]
    both = listed.join(replies(prompts, ("source_id",), model, "merged").select("source_id", merged.alias("m")), "source_id", "left")
    union = lambda m, field: F.flatten(F.transform(m["from"], lambda i: F.get("fs", i)[field]))
    fine = F.filter("m", lambda m: F.length(F.trim(m["title"])).between(1, TITLE) & F.length(F.trim(m["body"])).between(1, BODY) & m["type"].isin(*PAGE_TYPES) & F.coalesce(F.size(m["from"]) > 0, F.lit(False)) & F.forall(m["from"], lambda i: i.between(0, F.size("fs") - 1)))
    made = F.transform(fine, lambda m: F.struct(F.trim(m["title"]).alias("title"), F.trim(m["body"]).alias("body"), m["type"].alias("type"), _bounded(union(m, "tags"), TAGS).alias("tags"), _bounded(union(m, "links"), LINKS).alias("links"), F.slice(F.array_sort(F.array_distinct(union(m, "pages"))), 1, PAGES).alias("pages")))
    # A reply is good if every one of its entries is, and it leaves no finding out.
    whole = (F.size(made) == F.size("m")) & (F.size(F.array_distinct(F.flatten(F.transform("m", lambda m: m["from"])))) == F.size("fs"))
    titles = F.transform("fs", lambda f: F.lower(f["title"]))
    first = F.filter("fs", lambda f, i: F.array_position(titles, F.lower(f["title"])) == i + 1)
    out = both.select("source_id", F.when(F.coalesce(whole, F.lit(False)), made).otherwise(first).alias("fs"))
    return out.select("source_id", F.posexplode("fs").alias("position", "f")).select("source_id", "position", "f.*")


def decided(incoming: DataFrame, candidates: DataFrame, notes: DataFrame, model: Model) -> DataFrame:
    """(incoming_id, action, existing_id): the model's decision for each of incoming(note_id, title, body) on its candidates(incoming_id, existing_id), completed and safeguarded.

    A note has at most eight candidates.
    """
    page = notes.select(F.col("note_id").alias("existing_id"), F.concat(F.lit("["), F.col("note_id").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.substring(F.coalesce("body", F.lit("")), 1, 1_400)).alias("t"))
    shown = candidates.join(page, "existing_id").groupBy("incoming_id").agg(F.array_join(F.array_sort(F.collect_list("t")), "\n\n").alias("pages"))
    new = incoming.select(F.col("note_id").alias("incoming_id"), F.concat_ws("\n", "title", "body").alias("text"))
    prompts = new.join(shown, "incoming_id").select("incoming_id", F.concat(F.lit('New, merge or contradict? JSON {"decisions": [{"action", "existing_id"}]}\n\n'), "text", F.lit("\n\n"), "pages").alias("prompt"))
    said = replies(prompts, ("incoming_id",), model, "decisions").select("incoming_id", F.get(F.from_json("reply", "decisions array<struct<action:string,existing_id:bigint>>")["decisions"], F.lit(0)).alias("d")).select("incoming_id", "d.*")
    complete = providers.completed_decisions(new, said.where("action is not null"), candidates)
    found = duplicates.strongest_of(incoming, notes)
    texts = notes.select("note_id", "title", "body").unionByName(incoming.select("note_id", "title", "body"))
    return duplicates.safeguarded(complete, found, texts)


def rewritten(targets: DataFrame, model: Model) -> DataFrame:
    """(note_id, body, tags, links) of targets(note_id, body, tags, links, added_body, added_tags, added_links): the model's text, tags and links merged first come first.

    Without a good reply the added text follows the old one.
    """
    prompts = targets.select("note_id", F.concat(F.lit('Rewrite as JSON {"body": ["..."]}.\n\n'), F.coalesce("body", F.lit("")), F.lit("\n\n"), F.coalesce("added_body", F.lit(""))).alias("prompt"))
    said = replies(prompts, ("note_id",), model, "body").select("note_id", F.trim(F.array_join(F.from_json("reply", "body array<string>")["body"], "\n\n")).alias("said"))
    both = lambda a, b: X.distinct_ignoring_case(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))
    body = F.when(F.length("said") > 0, F.col("said")).otherwise(F.concat_ws("\n\n", "body", "added_body"))
    return targets.join(said, "note_id", "left").select("note_id", body.alias("body"), both("tags", "added_tags").alias("tags"), both("links", "added_links").alias("links"))


def distilled(sources: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) of sources(source_id, text): extracted by chunk, then consolidated."""
    found, errors = extracted(sources, model)
    return consolidated(found, model), errors


def sweep(candidates: DataFrame, generation: int, review: Callable[[DataFrame], DataFrame], limit: int = 20, rounds: int | None = None) -> DataFrame:
    """Stored candidates after reviewing a generation's queue, batch by batch, until it is empty or for so many rounds.

    review(batch) gives outcomes (fingerprint, status, discovery_id). What it says nothing about stays queued, and
    a batch without any outcome ends the sweep. The state is a table: a later sweep goes on where this one ended.
    """
    done = 0
    while rounds is None or done < rounds:
        batch = cut_lineage(discovery.dequeue(candidates, generation, limit))
        if batch.isEmpty():
            break
        outcomes = cut_lineage(review(batch).join(batch.select("fingerprint"), "fingerprint", "left_semi"))
        if outcomes.isEmpty():
            break
        candidates = cut_lineage(maintenance.recorded(candidates, outcomes))
        done += 1
    return candidates
