"""The Markdown form of pages: rendering, parsing, claims and source references.

Markers are HTML comments `<!-- {prefix}-source:HASH -->` and `<!-- {prefix}-claim:HASH,HASH -->`.
Reading accepts any prefix, writing uses the one given.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.validation import PAGE_TYPES

HASH = "[a-f0-9]{64}"
SOURCE_MARKER = rf"<!-- [a-z]+-source:({HASH}) -->"
CLAIM_MARKER = rf"<!-- [a-z]+-claim:({HASH}(?:,{HASH})*) -->"


def page_link(title: Column) -> Column:
    return F.concat(F.lit("[["), title, F.lit("]]"))


def json_string(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("s"))), r'^\{"s":(.*)\}$', 1)


def json_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: json_string(v)), ", "), F.lit("]"))


def claim_blocks(body: Column) -> Column:
    """Paragraphs of a body, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(body, r"\n{2,}"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")


def source_line(title: Column, url: Column, pages: Column, content_hash: Column, prefix: str) -> Column:
    safe = F.replace(F.replace(title, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    place = F.when(F.length(url) > 0, F.concat(F.lit("["), safe, F.lit("](<"), F.replace(url, F.lit(">"), F.lit("%3E")), F.lit(">)"))).otherwise(safe)
    where = F.when(F.size(pages) > 0, F.concat(F.lit("; pages: "), F.array_join(F.transform(pages, lambda p: p.cast("string")), ", "))).otherwise("")
    return F.concat(F.lit("- "), place, where, F.lit("; SHA-256: `"), content_hash, F.lit(f"` <!-- {prefix}-source:"), content_hash, F.lit(" -->"))


def render_page(title: Column, kind: Column, tags: Column, links: Column, body: Column, sources: Column, prefix: str = "page") -> Column:
    """Markdown of a page. sources: array of struct(title, url, pages, content_hash); every claim cites all of them."""
    hashes = F.array_join(F.array_distinct(F.transform(sources, lambda s: s["content_hash"])), ",")
    cited = F.array_join(F.transform(claim_blocks(body), lambda b: F.concat(b, F.lit(f"\n<!-- {prefix}-claim:"), hashes, F.lit(" -->"))), "\n\n")
    front = F.concat(F.lit("---\ntitle: "), json_string(title), F.lit("\ntype: "), kind, F.lit("\ntags: "), json_list(tags), F.lit("\nlinks: "), json_list(links), F.lit("\n---"))
    related = F.when(F.size(links) > 0, F.concat(F.lit("\n\n## Related\n\n"), F.array_join(F.transform(links, lambda x: F.concat(F.lit("- "), page_link(x))), "\n"))).otherwise("")
    lines = F.transform(sources, lambda s: source_line(s["title"], s["url"], s["pages"], s["content_hash"], prefix))
    quoted = F.when(F.size(sources) > 0, F.concat(F.lit("\n\n## Sources\n\n"), F.array_join(lines, "\n"))).otherwise("")
    return F.concat(front, F.lit("\n\n# "), title, F.lit("\n\n"), F.when(F.size(sources) > 0, cited).otherwise(body), related, quoted, F.lit("\n"))


def parsed_page(markdown: Column) -> Column:
    """struct(title, type, tags, links, body) of a rendered page; null where the front matter or heading is missing."""
    text = F.regexp_replace(markdown, r"\r\n?", "\n")
    front = F.regexp_extract(text, r"^---\n([\s\S]*?)\n---\n+", 1)
    rest = F.regexp_replace(text, r"^---\n[\s\S]*?\n---\n+", "")
    heading = F.regexp_extract(rest, r"^# ([^\n]+)\n", 1)
    body = F.regexp_replace(F.regexp_extract(F.regexp_replace(rest, r"^# [^\n]+\n\n?", ""), r"^([\s\S]*?)(?:\n\n## (?:Related|Sources)\n[\s\S]*)?$", 1), rf"\n?{CLAIM_MARKER}", "")
    field = lambda name: F.regexp_extract(front, rf"(?m)^{name}: (.*)$", 1)
    listed = lambda name: F.from_json(field(name), "array<string>")
    title = F.get_json_object(F.concat(F.lit('{"t":'), field("title"), F.lit("}")), "$.t")
    good = (front != "") & (heading != "") & (title == heading) & field("type").isin(*PAGE_TYPES)
    return F.when(good, F.struct(title.alias("title"), field("type").alias("type"), listed("tags").alias("tags"), listed("links").alias("links"), F.trim(F.regexp_replace(body, r"^\s+|\s+$", "")).alias("body")))


def source_hashes(markdown: Column) -> Column:
    """Distinct source hashes in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(markdown, F.lit(SOURCE_MARKER), F.lit(1)))


def source_pages(markdown: Column, content_hash: Column) -> Column:
    """Sorted page numbers of a source's reference line; null where it names none."""
    line = F.get(F.filter(F.split(markdown, "\n"), lambda x: F.startswith(x, F.lit("- ")) & F.contains(x, F.concat(F.lit("-source:"), content_hash, F.lit(" -->")))), F.lit(0))
    found = F.regexp_extract(line, r";\s*pages:\s*(\d+(?:,\s*\d+)*)\s*;\s*SHA-256:", 1)
    return F.when(found != "", F.array_sort(F.array_distinct(F.split(found, r",\s*").cast("array<int>"))))


def claim_citations(markdown: Column) -> Column:
    """array of struct(text, hashes): each claim with what it cites; pages without markers cite all their sources."""
    text = F.regexp_replace(markdown, r"\r\n?", "\n")
    rest = F.regexp_replace(F.regexp_replace(text, r"^---\n[\s\S]*?\n---\n+", ""), r"^# [^\n]+\n\n?", "")
    body = F.regexp_extract(rest, r"^([\s\S]*?)(?:\n\n## (?:Related|Sources)\n[\s\S]*)?$", 1)
    # A marker that stands alone belongs to the block before it.
    joined = F.regexp_replace(body, rf"\n{{2,}}({CLAIM_MARKER})", "\n$1")
    marked = F.transform(
        claim_blocks(joined),
        lambda b: F.struct(F.trim(F.regexp_replace(b, rf"\n?{CLAIM_MARKER}\s*$", "")).alias("text"), F.array_distinct(F.split(F.regexp_extract(b, rf"{CLAIM_MARKER}\s*$", 1), ",")).alias("hashes")),
    )
    plain = F.transform(claim_blocks(body), lambda b: F.struct(b.alias("text"), source_hashes(markdown).alias("hashes")))
    return F.when(F.rlike(body, F.lit(CLAIM_MARKER)), marked).otherwise(plain)


def log_entry(at: Column, operation: Column, subject: Column, content_hash: Column, changes: Column) -> Column:
    """A log section; changes: array of struct(action, type, title)."""
    lines = F.transform(changes, lambda c: F.concat(F.lit("- "), c["action"], F.lit(" "), c["type"], F.lit(": "), page_link(c["title"])))
    head = F.concat(F.lit("## ["), at, F.lit("] "), operation, F.lit(" | "), subject)
    digest = F.when(content_hash.isNotNull(), F.array(F.concat(F.lit("- Source SHA-256: `"), content_hash, F.lit("`")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_join(F.concat(F.array(head), digest, lines), "\n"), F.lit("\n"))
