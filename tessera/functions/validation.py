"""Checks on pages, relationships and source references, as columns of problems."""

from __future__ import annotations

import json
import pkgutil

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The types of a page, their headings in the index, and the type of a saved answer: data of the page model, in page_types.json.
_TYPES = json.loads(pkgutil.get_data(__name__, "page_types.json"))
PAGE_TYPES = tuple(t["type"] for t in _TYPES)
HEADINGS = {t["type"]: t["heading"] for t in _TYPES}
ANSWER_TYPE = next(t["type"] for t in _TYPES if t["holds_answers"])
PAGE_TYPES_SQL = "(" + ", ".join(f"'{t}'" for t in PAGE_TYPES) + ")"
#: Relationship types and the limits of a page.
RELATIONSHIP_TYPES = (
    "consolidation_candidate", "supports", "contradicts", "mechanistic", "causal_hypothesis", "temporal", "depends_on", "analogous", "shared_constraint", "research_gap",
)
TITLE, BODY, TAGS, TAG, LINKS, RELATIONSHIPS, SOURCE_PAGES = 120, 20_000, 12, 64, 50, 50, 50
HASH = "^[a-f0-9]{64}$"
TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})$"


def _problems(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), code) for bad, code in checks)))


def page_problems(title: Column, kind: Column, body: Column, tags: Column, links: Column) -> Column:
    """Codes of what is wrong with a page; empty if it is valid."""
    text = F.trim(title)
    return _problems(
        (~F.length(text).between(1, TITLE) | F.rlike(text, F.lit(r"\p{Cc}|\[\[|\]\]")), "title"),
        (~kind.isin(*PAGE_TYPES), "type"),
        (~F.length(F.trim(body)).between(1, BODY) | F.rlike(body, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")), "body"),
        ((F.coalesce(F.size(tags), F.lit(0)) > TAGS) | F.coalesce(F.exists(tags, lambda t: F.length(t) > TAG), F.lit(False)), "tags"),
        (F.coalesce(F.size(links), F.lit(0)) > LINKS, "links"),
    )


def clean_links(links: Column, title: Column) -> Column:
    """The first spelling of each link, without links to the page itself."""
    from tessera.functions.notes_text import distinct_ignoring_case

    return F.filter(distinct_ignoring_case(links), lambda x: F.lower(x) != F.lower(F.trim(title)))


def clean_relationships(relationships: Column, links: Column) -> Column:
    """Valid relationships to linked pages; of several with one target and type the last counts, in its first one's place."""
    known = F.transform(links, lambda x: F.lower(x))
    good = F.filter(
        relationships,
        lambda r: r["target"].isNotNull() & F.array_contains(known, F.lower(F.trim(r["target"]))) & r["type"].isin(*RELATIONSHIP_TYPES) & F.rlike(F.coalesce(r["confirmedAt"], F.lit("")), F.lit(TIME)),
    )
    keys = F.transform(good, lambda r: F.concat_ws("\u0001", F.lower(F.trim(r["target"])), r["type"]))
    last = lambda k: F.element_at(F.filter(good, lambda r: F.concat_ws("\u0001", F.lower(F.trim(r["target"])), r["type"]) == k), -1)
    return F.transform(F.array_distinct(keys), last)


def source_problems(title: Column, content_hash: Column, pages: Column) -> Column:
    return _problems(
        (~F.length(F.trim(title)).between(1, 500), "title"),
        (~F.rlike(content_hash, F.lit(HASH)), "hash"),
        ((F.coalesce(F.size(pages), F.lit(0)) > SOURCE_PAGES) | F.coalesce(F.exists(pages, lambda p: p < 1), F.lit(False)), "pages"),
    )


def positive_ids(values: Column, least: int = 1, most: int = 100) -> Column:
    """Distinct ids if all are positive and their number is within bounds; null otherwise."""
    ids = F.array_distinct(values)
    return F.when(F.size(ids).between(least, most) & F.forall(ids, lambda i: i.isNotNull() & (i > 0)), ids)
