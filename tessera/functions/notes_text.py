"""Scalar text functions of the page model: plain text, excerpts, slugs, URLs, page ranges, Markdown pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


#: What plain text leaves out, in this order.
PLAIN = (
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"\[\[([^\]]+)\]\]", "$1"), (r"</?[A-Za-z][^>]*>", " "), (r"(?m)^\s*[#>*+-]+\s+", ""), (r"[*_~`]", ""),
)


def plain_text(text: Column) -> Column:
    """Without Markdown images, links, page links, tags, bullets and emphasis; white space as one space."""
    for pattern, to in PLAIN:
        text = F.regexp_replace(text, pattern, to)
    return squeezed(text)


def excerpt(text: Column, limit: int, share: float = 0.7) -> Column:
    """At most `limit` characters with an ellipsis, cut at the last space if that keeps `share` of them."""
    head = F.substring(text, 1, limit)
    # The last space at or before position limit - 1 (from 0): its distance from the end of the head.
    space = F.length(head) - F.instr(F.reverse(head), " ")
    end = F.when((F.instr(head, " ") > 0) & (space >= int(limit * share)), space).otherwise(limit - 1)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, F.lit(1), end)), F.lit("…")))


def evidence_preview(text: Column, limit: int = 180) -> Column:
    """White space squeezed; a longer text is cut at a word boundary from 65 % of the limit on."""
    flat = squeezed(text)
    head = F.substring(flat, 1, limit + 1)
    space = F.length(head) - F.instr(F.reverse(head), " ")
    end = F.when((F.instr(head, " ") > 0) & (space >= int(limit * 0.65)), space).otherwise(limit)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, F.lit(1), end)), F.lit("…")))


def index_line(text: Column) -> Column:
    flat = squeezed(text)
    return F.when(F.length(flat) > 200, F.concat(F.rtrim(F.substring(flat, 1, 197)), F.lit("…"))).otherwise(flat)


def first_paragraph(body: Column) -> Column:
    return F.element_at(F.split(F.trim(body), r"\n\s*\n"), 1)


def slug(title: Column) -> Column:
    """Lower-case ASCII letters and digits, other runs as one hyphen, trimmed, at most 80 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)


def page_ranges(pages: Column) -> Column:
    """'1–3, 5, 8–10' from an array of page numbers; numbers below 1 and nulls are left out."""
    sorted_pages = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p > 0)))
    starts = F.filter(sorted_pages, lambda p: ~F.array_contains(sorted_pages, p - 1))
    ends = F.filter(sorted_pages, lambda p: ~F.array_contains(sorted_pages, p + 1))
    one = lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("–"), b.cast("string")))
    return F.array_join(F.zip_with(starts, ends, one), ", ")


def distinct_ignoring_case(values: Column) -> Column:
    """The first spelling of each entry that is the same in lower case; trimmed, empty ones left out."""
    clean = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: F.length(v) > 0)
    keys = F.transform(clean, lambda v: F.lower(v))
    return F.filter(clean, lambda v, i: F.array_position(keys, F.lower(v)) == i + 1)


#: Hosts and the form of ids.
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be")
VIDEO_ID = "^[A-Za-z0-9_-]{11}$"
PLAYLIST_ID = "^[A-Za-z0-9_-]{2,100}$"


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https://([^/?#:@]+)(?=[/?#]|$)", 1))


def video_url(value: Column) -> Column:
    """The canonical address of a video id or an allowed https address of one; null for anything else."""
    text = F.trim(value)
    path = F.regexp_extract(text, r"^https://[^/?#]+/([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    from_query = F.regexp_extract(text, r"[?&]v=([^&#]*)", 1)
    from_path = F.when(F.get(parts, F.lit(0)).isin("shorts", "embed", "live"), F.get(parts, F.lit(1)))
    found = F.when(_host(text) == "youtu.be", F.get(parts, F.lit(0))).otherwise(F.coalesce(F.nullif(from_query, F.lit("")), from_path))
    ident = F.when(F.rlike(text, F.lit(VIDEO_ID)), text).when(_host(text).isin(*VIDEO_HOSTS), found)
    return F.when(F.rlike(ident, F.lit(VIDEO_ID)), F.concat(F.lit("https://www.youtube.com/watch?v="), ident))


def playlist_url(value: Column) -> Column:
    text = F.trim(value)
    ident = F.when(F.rlike(text, F.lit(PLAYLIST_ID)), text).when(_host(text).isin(*VIDEO_HOSTS), F.trim(F.regexp_extract(text, r"[?&]list=([^&#]*)", 1)))
    return F.when(F.rlike(ident, F.lit(PLAYLIST_ID)), F.concat(F.lit("https://www.youtube.com/playlist?list="), ident))


def input_kind(value: Column) -> Column:
    """text, video, playlist or queue: what an entered source is."""
    lines = F.filter(F.transform(F.split(value, r"\r\n?|\n"), lambda x: F.trim(x)), lambda x: x != "")
    every = F.forall(lines, lambda x: video_url(x).isNotNull())
    single = F.get(lines, F.lit(0))
    is_url = F.rlike(single, F.lit("^https?://"))
    return (
        F.when(F.size(lines) == 0, "text")
        .when((F.size(lines) > 1) & every, "queue")
        .when((F.size(lines) == 1) & is_url & playlist_url(single).isNotNull() & F.contains(single, F.lit("list=")), "playlist")
        .when((F.size(lines) == 1) & video_url(single).isNotNull(), "video")
        .otherwise("text")
    )


def queue_lines(value: Column) -> Column:
    """Distinct non-empty trimmed lines in order."""
    return F.array_distinct(F.filter(F.transform(F.split(value, r"\r\n?|\n"), lambda x: F.trim(x)), lambda x: x != ""))


def decoded(content: Column) -> Column:
    """Text of UTF-8 bytes: without a byte-order mark, line ends as \\n, trimmed; null for bad UTF-8 or no text."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    text = stripped(F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), r"\r\n?", "\n"))
    return F.nullif(text, F.lit(""))


def file_title(name: Column) -> Column:
    """A title from a file name: without folders and extension, hyphens and underscores as spaces."""
    base = F.regexp_replace(F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1), r"\.[A-Za-z0-9]{1,8}$", "")
    return squeezed(F.regexp_replace(base, "[_-]+", " "))


def safe_relative_path(path: Column) -> Column:
    """A path that stays inside its folder: relative, no empty, . or .. part, no control character, at most 4096 characters."""
    parts = F.split(path, "/")
    return F.coalesce(
        (F.length(path).between(1, 4096)) & ~F.rlike(path, F.lit(r"^/|^[A-Za-z]:|\\|\p{Cc}")) & ~F.exists(parts, lambda p: p.isin("", ".", "..")), F.lit(False)
    )


def bounded_text(value: Column, limit: int) -> Column:
    """Trimmed, not empty, at most `limit` characters and no control characters; null otherwise."""
    text = F.trim(value)
    return F.when(F.length(text).between(1, limit) & ~F.rlike(text, F.lit(r"\p{Cc}")), text)
