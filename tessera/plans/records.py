"""Registered queries on texts, Markdown, provenance, history and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import markdown as M
from tessera.functions import notes_text as X
from tessera.functions.validation import HEADINGS, PAGE_TYPES, PAGE_TYPES_SQL
from tessera.operators import chunking, duplicates, integrity, maintenance
from tessera.operators.ranking import ranked
from tessera.plans.knowledge import DEC, PAIRS, pairs
from tessera.plans.retrieval import NS, N, note_sources, notes
from tessera.sources.tables import table
from tessera.streaming import arrivals

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")


D = "d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"


def squeezed_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'), ' ')"


def plain_sql(c: str) -> str:
    steps = (("!\\[([^\\]]*)\\]\\([^)]*\\)", "\\1"), ("\\[([^\\]]+)\\]\\([^)]*\\)", "\\1"), ("\\[\\[([^\\]]+)\\]\\]", "\\1"), ("</?[A-Za-z][^>]*>", " "), ("(?m)^\\s*[#>*+-]+\\s+", ""), ("[*_~`]", ""))
    for pattern, to in steps:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return squeezed_sql(c)


def cut_sql(text: str, head: str, limit: int, least: int, hard: int) -> str:
    space = f"(len({head}) - strpos(reverse({head}), ' '))"
    return f"CASE WHEN len({text}) <= {limit} THEN {text} ELSE rtrim(substr({text}, 1, CASE WHEN strpos({head}, ' ') > 0 AND {space} >= {least} THEN {space} ELSE {hard} END), ' ') || '…' END"


# ---- text -----------------------------------------------------------------------------------
@query(f"WITH {D} SELECT doc_id, {plain_sql('text')} AS plain FROM d")
def t5_plain_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.plain_text(F.col("text")).alias("plain"))


@query(f"WITH {D}, p AS (SELECT doc_id, {plain_sql('text')} AS t FROM d), h AS (SELECT doc_id, t, substr(t, 1, 260) AS hd FROM p) SELECT doc_id, {cut_sql('t', 'hd', 260, 182, 259)} AS excerpt FROM h")
def t6_excerpt(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.plain_text(F.col("text")).alias("t")).select("doc_id", X.excerpt(F.col("t"), 260).alias("excerpt"))


@query(f"WITH {D}, p AS (SELECT doc_id, {squeezed_sql('text')} AS t FROM d), h AS (SELECT doc_id, t, substr(t, 1, 181) AS hd FROM p) SELECT doc_id, {cut_sql('t', 'hd', 180, 117, 180)} AS preview FROM h")
def t10_evidence_preview(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.evidence_preview(F.col("text")).alias("preview"))


@query(f"WITH {N}, s AS (SELECT note_id, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug FROM n WHERE title IS NOT NULL) SELECT note_id, slug || CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY note_id) > 1 THEN '-' || row_number() OVER (PARTITION BY slug ORDER BY note_id) ELSE '' END AS slug FROM s")
def t8_slug(spark, sf_dir):
    rows = notes(spark, sf_dir).where("title is not null").select("note_id", X.slug(F.col("title")).alias("slug"))
    nth = ranked(rows, ["slug"], [F.col("note_id")], "n")
    return nth.select("note_id", F.when(F.col("n") > 1, F.concat_ws("-", "slug", F.col("n").cast("string"))).otherwise(F.col("slug")).alias("slug"))


@query(f"WITH {D}, p AS (SELECT doc_id, {squeezed_sql('text')} AS t FROM d) SELECT doc_id, CASE WHEN len(t) > 200 THEN rtrim(substr(t, 1, 197), ' ') || '…' ELSE t END AS line FROM p")
def t9_index_line(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.index_line(F.col("text")).alias("line"))


@query(
    """WITH i AS (SELECT DISTINCT ingest_id, transcript FROM ingest_results WHERE starts_with(transcript, 'WEBVTT')), l AS (SELECT ingest_id, unnest(regexp_split_to_array(transcript, '\\r\\n|\\r|\\n')) AS raw, generate_subscripts(regexp_split_to_array(transcript, '\\r\\n|\\r|\\n'), 1) AS no FROM i),
  c AS (SELECT ingest_id, no, trim(regexp_replace(trim(raw, ' '), '<[^>]+>', '', 'g'), ' ') AS clean FROM l WHERE trim(raw, ' ') <> '' AND NOT regexp_matches(trim(raw, ' '), '^WEBVTT|^Kind:|^Language:|^\\d{2}:\\d{2}|-->|^align:|^position:')),
  f AS (SELECT *, lag(clean) OVER (PARTITION BY ingest_id ORDER BY no) AS before FROM c WHERE clean <> '') SELECT ingest_id, string_agg(clean, ' ' ORDER BY no) AS text FROM f WHERE before IS NULL OR clean <> before GROUP BY 1"""
)
def t1_vtt(spark, sf_dir):
    rows = table(spark, sf_dir, "ingest_results").where("transcript like 'WEBVTT%'").select("ingest_id", "transcript").distinct()
    return chunking.caption_text(rows, "ingest_id", "transcript")


@query()
def t2_chunks(spark, sf_dir):
    return chunking.chunked(docs(spark, sf_dir), "doc_id", "text")


@query("WITH d AS (SELECT doc_id, len(text) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN n <= 12000 THEN 1 ELSE ceil((n - 500) / 11500.0)::BIGINT END AS chunks FROM d")
def t2_chunk_count(spark, sf_dir):
    return chunking.chunked(docs(spark, sf_dir), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query()
def t11_line_diff(spark, sf_dir):
    base = notes(spark, sf_dir).select("note_id", "body")
    both = pairs(spark, sf_dir).join(base.select(F.col("note_id").alias("l_id"), F.col("body").alias("before")), "l_id").join(base.select(F.col("note_id").alias("r_id"), F.col("body").alias("after")), "r_id")
    return chunking.diffed(both.select((F.col("l_id") * 1_000_000_000 + F.col("r_id")).alias("pair_id"), "before", "after"), "pair_id", "before", "after")


@query(
    """WITH s AS (SELECT DISTINCT source_id, replace(source_url, 'vault.example', 'www.youtube.com') AS u FROM sources WHERE source_url IS NOT NULL), x AS (SELECT source_id, regexp_extract(u, '[?&]v=([^&#]*)', 1) AS v FROM s WHERE regexp_matches(u, '^https://(?:youtube.com|www.youtube.com|m.youtube.com|music.youtube.com|youtu.be)(?:[/?#]|$)'))
  SELECT s.source_id, CASE WHEN regexp_matches(v, '^[A-Za-z0-9_-]{11}$') THEN 'https://www.youtube.com/watch?v=' || v END AS url FROM s LEFT JOIN x USING (source_id)"""
)
def t12_url_norm(spark, sf_dir):
    rows = table(spark, sf_dir, "sources").where("source_url is not null").select("source_id", "source_url").distinct()
    return rows.select("source_id", X.video_url(F.replace("source_url", F.lit("vault.example"), F.lit("www.youtube.com"))).alias("url"))


@query(
    """WITH p AS (SELECT DISTINCT note_id, source_id AS page FROM note_sources WHERE note_id IS NOT NULL AND source_id > 0), g AS (SELECT *, page - row_number() OVER (PARTITION BY note_id ORDER BY page) AS island FROM p),
  r AS (SELECT note_id, min(page) AS a, max(page) AS b FROM g GROUP BY note_id, island) SELECT note_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '–' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY note_id"""
)
def w6_page_ranges(spark, sf_dir):
    pages = note_sources(spark, sf_dir).where("source_id > 0").groupBy("note_id").agg(F.collect_set("source_id").alias("pages"))
    return pages.select("note_id", X.page_ranges(F.col("pages")).alias("ranges"))


@query(f"""WITH {N}, t AS (SELECT note_id, list_filter(list_transform(links, lambda x: trim(x, ' ')), lambda x: len(x) > 0) AS a FROM n WHERE links IS NOT NULL), k AS (SELECT note_id, a, list_transform(a, lambda x: lower(x)) AS l FROM t)
  SELECT note_id, array_to_string(list_filter(a, lambda x, i: list_position(l, lower(x)) = i), '|') AS links FROM k""")
def w10_dedup_keep_first(spark, sf_dir):
    return notes(spark, sf_dir).where("links is not null").select("note_id", F.array_join(X.distinct_ignoring_case(F.col("links")), "|").alias("links"))


@query("WITH i AS (SELECT ingest_id, min(transcript) AS t FROM ingest_results WHERE transcript <> '' AND source_type = 'text' GROUP BY 1) SELECT ingest_id, len(list_distinct(list_filter(list_transform(regexp_split_to_array(t, '\\r\\n?|\\n'), lambda x: trim(x, ' ')), lambda x: x <> ''))) AS lines FROM i")
def t14_queue_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "ingest_results").where("transcript <> '' and source_type = 'text'").groupBy("ingest_id").agg(F.min("transcript").alias("t"))
    return rows.select("ingest_id", F.size(X.queue_lines(F.col("t"))).cast("bigint").alias("lines"))


# ---- Markdown -------------------------------------------------------------------------------
SRC = "sr AS (SELECT DISTINCT ON (source_id) * FROM sources WHERE source_id IS NOT NULL)"


def sources(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "sources").where("source_id is not null").dropDuplicates(["source_id"])


def rendered(spark, sf_dir) -> DataFrame:
    """(note_id, markdown) of complete pages with all their sources in id order."""
    cited = note_sources(spark, sf_dir).join(sources(spark, sf_dir), "source_id").groupBy("note_id")
    cited = cited.agg(F.array_sort(F.collect_list(F.struct("source_id", F.coalesce("title", F.lit("")).alias("title"), F.col("source_url").alias("url"), F.array().cast("array<int>").alias("pages"), "content_hash"))).alias("sources"))
    page = notes(spark, sf_dir).where("title is not null and body <> ''").join(cited, "note_id", "left").withColumn("body", F.regexp_replace("body", r"\r\n?", "\n"))
    empty = F.array().cast("array<string>")
    clean = lambda c: F.coalesce(F.filter(c, lambda x: x.isNotNull() & (x != "")), empty)
    return page.select("note_id", M.render_page(F.col("title"), F.col("type"), clean("tags"), clean("links"), F.col("body"), F.coalesce("sources", F.array().cast(cited.schema["sources"].dataType))).alias("markdown"))


_CLAIMS = "list_filter(list_transform(regexp_split_to_array(body, '\\n{2,}'), lambda b: regexp_replace(b, '^\\s+|\\s+$', '', 'g')), lambda b: b <> '')"
_CLEAN = "coalesce(list_filter({0}, lambda x: x IS NOT NULL AND x <> ''), [])"
_LIST = "'[' || array_to_string(list_transform({0}, lambda x: to_json(x)::VARCHAR), ', ') || ']'"
MD = f"""ci AS (SELECT note_id, list({{'t': replace(replace(coalesce(title, ''), '[', '\\['), ']', '\\]'), 'u': source_url, 'h': content_hash}} ORDER BY source_id) AS s FROM ns JOIN sr USING (source_id) GROUP BY 1),
  b AS (SELECT n.note_id, title, type, regexp_replace(body, '\\r\\n?', chr(10), 'g') AS body, {_CLEAN.format('tags')} AS tg, {_CLEAN.format('links')} AS lk, s, array_to_string(list_filter(list_transform(s, lambda x: x.h), lambda x, i: list_position(list_transform(s, lambda y: y.h), x) = i), ',') AS hs FROM n LEFT JOIN ci USING (note_id) WHERE title IS NOT NULL AND body <> ''),
  md AS (SELECT note_id, '---' || chr(10) || 'title: ' || to_json(title)::VARCHAR || chr(10) || 'type: ' || type || chr(10) || 'tags: ' || {_LIST.format('tg')} || chr(10) || 'links: ' || {_LIST.format('lk')} || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10)
    || CASE WHEN s IS NULL THEN body ELSE array_to_string(list_transform({_CLAIMS}, lambda c: c || chr(10) || '<!-- page-claim:' || hs || ' -->'), chr(10) || chr(10)) END
    || CASE WHEN len(lk) > 0 THEN chr(10) || chr(10) || '## Related' || chr(10) || chr(10) || array_to_string(list_transform(lk, lambda x: '- [[' || x || ']]'), chr(10)) ELSE '' END
    || CASE WHEN s IS NULL THEN '' ELSE chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || array_to_string(list_transform(s, lambda x: '- ' || CASE WHEN len(x.u) > 0 THEN '[' || x.t || '](<' || replace(x.u, '>', '%3E') || '>)' ELSE x.t END || '; SHA-256: `' || x.h || '` <!-- page-source:' || x.h || ' -->'), chr(10)) END || chr(10) AS markdown FROM b)"""


@query(f"WITH {N}, {NS}, {SRC}, {MD} SELECT note_id, markdown FROM md")
def m4_render(spark, sf_dir):
    return rendered(spark, sf_dir)


@query(f"WITH {N}, {NS}, {SRC}, {MD}, h AS (SELECT note_id, regexp_extract_all(markdown, '<!-- [a-z]+-source:([a-f0-9]{{64}}) -->', 1) AS a FROM md) SELECT note_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS hashes FROM h")
def m5_source_hashes(spark, sf_dir):
    return rendered(spark, sf_dir).select("note_id", F.array_join(M.source_hashes(F.col("markdown")), ",").alias("hashes"))


@query(f"WITH {N} SELECT note_id, len({_CLAIMS}) AS claims, array_to_string({_CLAIMS}, '|') AS text FROM n WHERE body IS NOT NULL")
def m7_claim_blocks(spark, sf_dir):
    rows = notes(spark, sf_dir).where("body is not null").select("note_id", M.claim_blocks(F.col("body")).alias("c"))
    return rows.select("note_id", F.size("c").cast("bigint").alias("claims"), F.array_join("c", "|").alias("text"))


@query(f"WITH {N}, {NS}, {SRC}, h AS (SELECT note_id, count(DISTINCT content_hash) AS c FROM ns JOIN sr USING (source_id) GROUP BY 1) SELECT n.note_id, unnest({_CLAIMS}) AS claim, coalesce(c, 0) AS sources FROM (SELECT * REPLACE (regexp_replace(body, '\\r\\n?', chr(10), 'g') AS body) FROM n) n LEFT JOIN h USING (note_id) WHERE title IS NOT NULL AND body <> '' AND type IN {PAGE_TYPES_SQL}")
def m8_claim_citations(spark, sf_dir):
    pages = rendered(spark, sf_dir).join(notes(spark, sf_dir).where(F.col("type").isin(*PAGE_TYPES)).select("note_id"), "note_id", "left_semi")
    claims = pages.select("note_id", F.explode(M.claim_citations(F.col("markdown"))).alias("c"))
    return claims.select("note_id", F.col("c.text").alias("claim"), F.size(F.filter("c.hashes", lambda h: h != "")).cast("bigint").alias("sources"))


@query(f"WITH {N} SELECT note_id, title, type, len({_CLEAN.format('links')}) AS links FROM n WHERE title IS NOT NULL AND body <> '' AND type IN {PAGE_TYPES_SQL}")
def m3_parse_round_trip(spark, sf_dir):
    parsed = rendered(spark, sf_dir).select("note_id", M.parsed_page(F.col("markdown")).alias("p")).where("p is not null")
    return parsed.select("note_id", "p.title", "p.type", F.size("p.links").cast("bigint").alias("links"))


@query(
    f"""WITH {N}, p AS (SELECT note_id, title, type, {squeezed_sql('body')} AS t FROM n WHERE title IS NOT NULL AND body <> '' AND type IN {PAGE_TYPES_SQL})
  SELECT CASE type {' '.join(f"WHEN '{t}' THEN '## {h}'" for t, h in HEADINGS.items())} END AS heading, count(*) OVER (PARTITION BY type) AS pages,
    '- [[' || title || ']] — ' || CASE WHEN len(t) > 200 THEN rtrim(substr(t, 1, 197), ' ') || '…' ELSE t END AS line FROM p"""
)
def m9_index(spark, sf_dir):
    # The order of titles is that of a collation which SQL lacks: a test checks positions.
    lines = maintenance.index_lines(notes(spark, sf_dir))
    return lines.join(lines.groupBy("heading").agg(F.max("position").alias("pages")), "heading").select("heading", "pages", "line")


# ---- joins and provenance -------------------------------------------------------------------
@query(f"WITH {N}, {NS} SELECT source_id, note_id, title, row_number() OVER (PARTITION BY source_id ORDER BY created_at, note_id)::INT AS position FROM ns JOIN n USING (note_id)")
def j1_pages_of_source(spark, sf_dir):
    return maintenance.pages_of_sources(note_sources(spark, sf_dir), notes(spark, sf_dir)).select("source_id", "note_id", "title", F.col("position").cast("int").alias("position"))


@query(f"WITH {SRC} SELECT source_id, title FROM sr WHERE source_id IN (SELECT source_id FROM note_sources WHERE note_id IS NOT NULL)")
def j2_sources_of_pages(spark, sf_dir):
    return sources(spark, sf_dir).select("source_id", "title").join(note_sources(spark, sf_dir), "source_id", "left_semi")


@query(f"WITH {SRC}, a AS (SELECT DISTINCT note_id, source_id, coalesce(lower(action), 'reference') AS action FROM note_sources WHERE source_id IS NOT NULL) SELECT note_id, source_id, action, source_type FROM a JOIN sr USING (source_id)")
def j3_provenance(spark, sf_dir):
    acts = table(spark, sf_dir, "note_sources").where("source_id is not null").select("note_id", "source_id", F.coalesce(F.lower("action"), F.lit("reference")).alias("action")).distinct()
    return acts.join(sources(spark, sf_dir).select("source_id", "source_type"), "source_id")


# A page names its sources in the order in which they were attached; of several sources with one hash the lowest id counts.
FIRST_SOURCE = f"""ao AS (SELECT note_id, source_id, min(attached_at) AS t0 FROM note_sources WHERE note_id IS NOT NULL AND source_id IS NOT NULL GROUP BY 1, 2), hs AS (SELECT content_hash, min(source_id) AS primary_source FROM sr GROUP BY 1),
  fh AS (SELECT note_id, content_hash FROM ao JOIN sr USING (source_id) QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY t0, source_id) = 1), fs AS (SELECT note_id, primary_source FROM fh JOIN hs USING (content_hash))"""


def primary_sources(spark, sf_dir) -> DataFrame:
    """(note_id, primary_source): the source of the first hash that a page names."""
    order = table(spark, sf_dir, "note_sources").where("note_id is not null and source_id is not null").groupBy("note_id", "source_id").agg(F.min("attached_at").alias("at"))
    known = sources(spark, sf_dir).select("source_id", "content_hash")
    cited = order.join(known, "source_id").select("note_id", F.struct("at", "source_id").alias("place"), "content_hash")
    return maintenance.primary_sources(cited, known)


@query(f"WITH {SRC}, {FIRST_SOURCE} SELECT note_id, primary_source FROM fs")
def j20_primary_source(spark, sf_dir):
    return primary_sources(spark, sf_dir)


@query(f"WITH {SRC}, {NS} SELECT sr.source_id, count(note_id) AS pages FROM sr LEFT JOIN ns USING (source_id) GROUP BY 1")
def a4_pages_per_source(spark, sf_dir):
    counts = note_sources(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("pages"))
    return sources(spark, sf_dir).select("source_id").join(counts, "source_id", "left").select("source_id", F.coalesce("pages", F.lit(0).cast("bigint")).alias("pages"))


@query(f"WITH {N} SELECT note_id, title, row_number() OVER (ORDER BY created_at DESC, note_id) AS position FROM n ORDER BY created_at DESC, note_id LIMIT 100")
def proj1_newest_notes(spark, sf_dir):
    newest = notes(spark, sf_dir).orderBy(F.desc("created_at"), "note_id").select("note_id", "title", "created_at").limit(100)
    return newest.select("note_id", "title", F.row_number().over(Window.orderBy(F.desc("created_at"), "note_id")).cast("bigint").alias("position"))


@query("SELECT source_id, len(string_split(file_path, '/')) AS parts, (len(file_path) BETWEEN 1 AND 4096 AND NOT regexp_matches(file_path, '^/|^[A-Za-z]:|\\\\') AND len(list_filter(string_split(file_path, '/'), lambda p: p IN ('', '.', '..'))) = 0) AS safe FROM (SELECT DISTINCT source_id, file_path FROM sources WHERE file_path IS NOT NULL)")
def proj12_safe_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "sources").where("file_path is not null").select("source_id", "file_path").distinct()
    return rows.select("source_id", F.size(F.split("file_path", "/")).cast("bigint").alias("parts"), X.safe_relative_path(F.col("file_path")).alias("safe"))


@query("WITH r AS (SELECT DISTINCT note_id, unnest(relationships).type AS type FROM (SELECT DISTINCT ON (note_id) * FROM notes)) SELECT type, count(*) AS pages FROM r GROUP BY 1")
def proj10_relationship_types(spark, sf_dir):
    return notes(spark, sf_dir).select("note_id", F.explode("relationships.type").alias("type")).distinct().groupBy("type").agg(F.count("*").alias("pages"))


@query("WITH o AS (SELECT note_id, source_id, min(attached_at) AS t0 FROM note_sources WHERE note_id IS NOT NULL AND source_id IS NOT NULL GROUP BY 1, 2) SELECT source_id, note_id, row_number() OVER (PARTITION BY source_id ORDER BY t0, note_id)::INT AS position FROM o QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY t0, note_id) <= 12")
def o9_ordered_distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "note_sources").where("note_id is not null and source_id is not null").groupBy("source_id", "note_id").agg(F.min("attached_at").alias("at"))
    order = Window.partitionBy("source_id").orderBy("at", "note_id")
    return rows.withColumn("position", F.row_number().over(order)).where("position <= 12").select("source_id", "note_id", "position")


# ---- history and integrity ------------------------------------------------------------------
HI = "hi AS (SELECT sha256(source_id::VARCHAR) AS history_id, content_hash AS source_hash, source_id, min(attached_at) AS applied_at FROM note_sources JOIN sr USING (source_id) WHERE note_id IS NOT NULL GROUP BY source_id, content_hash)"


def history(spark, sf_dir) -> DataFrame:
    """One ingest for each source: applied when its first note was attached."""
    rows = table(spark, sf_dir, "note_sources").where("note_id is not null").groupBy("source_id").agg(F.min("attached_at").alias("applied_at"))
    joined = rows.join(sources(spark, sf_dir).select("source_id", "content_hash"), "source_id")
    return joined.select(F.sha2(F.col("source_id").cast("string"), 256).alias("history_id"), F.col("content_hash").alias("source_hash"), "source_id", "applied_at")


@query(f"WITH {SRC}, {HI} SELECT source_hash, epoch_us(min(applied_at)) AS archived_at FROM hi GROUP BY 1")
def a8_first_applied(spark, sf_dir):
    return integrity.first_applied(history(spark, sf_dir)).select("source_hash", F.unix_micros("archived_at").alias("archived_at"))


@query("WITH a AS (SELECT note_id, source_id, list_sort(list(DISTINCT action)) AS s FROM note_sources WHERE note_id IS NOT NULL AND source_id IS NOT NULL AND action IS NOT NULL GROUP BY 1, 2) SELECT note_id, source_id, CASE WHEN len(s) = 1 THEN s[1] END AS action, len(s) > 1 AS conflict FROM a")
def a9_action_conflicts(spark, sf_dir):
    return integrity.action_per_page(table(spark, sf_dir, "note_sources").where("note_id is not null and source_id is not null"))


@query(f"WITH {SRC}, {HI} SELECT history_id, source_id, epoch_us(applied_at) AS applied_at FROM hi WHERE source_id % 3 <> 0 ORDER BY hi.applied_at DESC, history_id DESC LIMIT 1")
def w7_latest_undoable(spark, sf_dir):
    all_history = history(spark, sf_dir)
    found = integrity.latest_undoable(all_history, all_history.where("source_id % 3 = 0"))
    return found.select("history_id", "source_id", F.unix_micros("applied_at").alias("applied_at"))


SNAP = "sa AS (SELECT file_path AS path, sha256(coalesce(body, '')) AS hash FROM n WHERE note_id % 5 <> 0), sb AS (SELECT file_path AS path, sha256(coalesce(body, '') || CASE WHEN note_id % 3 = 0 THEN '!' ELSE '' END) AS hash FROM n WHERE note_id % 7 <> 0)"


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    base = notes(spark, sf_dir).select("note_id", F.col("file_path").alias("path"), F.coalesce("body", F.lit("")).alias("b"))
    before = base.where("note_id % 5 <> 0").select("path", F.sha2("b", 256).alias("hash"))
    after = base.where("note_id % 7 <> 0").select("path", F.sha2(F.when(F.col("note_id") % 3 == 0, F.concat("b", F.lit("!"))).otherwise(F.col("b")), 256).alias("hash"))
    return before, after


@query(f"WITH {N}, {SNAP} SELECT coalesce(sa.path, sb.path) AS path, CASE WHEN sa.path IS NULL THEN 'new' WHEN sb.path IS NULL THEN 'removed' ELSE 'changed' END AS change, sa.hash AS before_hash, sb.hash AS after_hash FROM sa FULL JOIN sb ON sa.path = sb.path WHERE sa.path IS NULL OR sb.path IS NULL OR sa.hash <> sb.hash")
def i5_history_diff(spark, sf_dir):
    return integrity.snapshot_diff(*snapshots(spark, sf_dir))


@query(
    f"""WITH {N}, {SNAP}, jo AS (SELECT coalesce(sa.path, sb.path) AS path, sa.hash AS before, sb.hash AS after FROM sa FULL JOIN sb ON sa.path = sb.path WHERE sa.path IS NULL OR sb.path IS NULL OR sa.hash <> sb.hash),
  cu AS (SELECT file_path AS path, CASE note_id % 4 WHEN 0 THEN sha256('other') ELSE sha256(coalesce(body, '')) END AS hash FROM n)
  SELECT jo.path, CASE WHEN hash IS NOT DISTINCT FROM after THEN 'done' WHEN hash IS NOT DISTINCT FROM before THEN 'apply' ELSE 'conflict' END AS step FROM jo LEFT JOIN cu ON cu.path = jo.path"""
)
def i7_journal_classify(spark, sf_dir):
    journal = integrity.snapshot_diff(*snapshots(spark, sf_dir)).select("path", F.col("before_hash").alias("before"), F.col("after_hash").alias("after"))
    text = F.when(F.col("note_id") % 4 == 0, "other").otherwise(F.coalesce("body", F.lit("")))
    current = notes(spark, sf_dir).select(F.col("file_path").alias("path"), F.sha2(text, 256).alias("hash"))
    return integrity.classify_journal(journal, current)


@query("SELECT doc_id, sha256(text) AS computed FROM documents WHERE text IS NOT NULL AND doc_id % 11 = 0")
def i2_hash_verify(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumn("stored", F.when(F.col("doc_id") % 11 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)))
    return integrity.hash_mismatches(rows, "doc_id", F.col("text"), F.col("stored"))


@query(
    f"""WITH {N}, {NS}, {SRC}, lk AS (SELECT DISTINCT lower(l) AS key FROM (SELECT unnest(links) AS l FROM n) WHERE l <> '')
  SELECT 'duplicate_title' AS code, lower(title) AS item FROM n WHERE title IS NOT NULL GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'missing_provenance', note_id::VARCHAR FROM n WHERE note_id NOT IN (SELECT note_id FROM ns WHERE source_id IN (SELECT source_id FROM sr))
  UNION ALL SELECT DISTINCT 'unknown_source', source_id::VARCHAR FROM ns WHERE source_id NOT IN (SELECT source_id FROM sr)
  UNION ALL SELECT 'broken_link', key FROM lk WHERE key NOT IN (SELECT lower(title) FROM n WHERE title IS NOT NULL)
  UNION ALL SELECT 'duplicate_source', content_hash FROM sr GROUP BY 2 HAVING count(DISTINCT source_id) > 1"""
)
def i3_verify(spark, sf_dir):
    return integrity.verify(notes(spark, sf_dir), sources(spark, sf_dir), note_sources(spark, sf_dir))


@query(f"WITH {N}, {PAIRS}, {DEC} SELECT existing_id, string_agg(incoming_id::VARCHAR, ',' ORDER BY incoming_id) AS incoming, CASE WHEN bool_or(action = 'contradict') THEN 'contradict' ELSE 'merge' END AS action FROM dc WHERE existing_id IS NOT NULL GROUP BY 1")
def a10_group_targets(spark, sf_dir):
    of = pairs(spark, sf_dir).groupBy(F.col("r_id").alias("incoming_id")).agg(F.min("l_id").alias("low"))
    kind = F.col("incoming_id") % 3
    decisions = of.select("incoming_id", F.when(kind == 0, "new").when(kind == 1, "merge").otherwise("contradict").alias("action"), F.when(kind > 0, F.col("low")).alias("existing_id"))
    grouped = integrity.grouped_targets(decisions)
    return grouped.select("existing_id", F.array_join(F.transform("incoming", lambda i: i.cast("string")), ",").alias("incoming"), "action")


@query("SELECT source_id, count(*) FILTER (lower(action) = 'new') AS new, count(*) FILTER (lower(action) = 'merge') AS merge, count(*) FILTER (lower(action) = 'contradict') AS contradict, count(*) FILTER (lower(action) = 'reference') AS reference FROM (SELECT DISTINCT note_id, source_id, action FROM note_sources) GROUP BY 1")
def a12_queue_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "note_sources").select("note_id", "source_id", "action").distinct().withColumn("outcome", F.lower("action"))
    return integrity.outcome_counts(rows, "outcome", ("new", "merge", "contradict", "reference"), "source_id")


@query(f"WITH {N} SELECT count(*) AS pages, sum(len(list_distinct(links)))::BIGINT AS links, sum(coalesce(len(flatten(list_transform(relationships, lambda r: r.pageHashes))), 0))::BIGINT AS hashes FROM n")
def a16_verification_totals(spark, sf_dir):
    rows = notes(spark, sf_dir)
    links = F.size(F.filter(F.array_distinct("links"), lambda x: x.isNotNull()))
    hashes = F.coalesce(F.size(F.flatten(F.filter("relationships.pageHashes", lambda h: h.isNotNull()))), F.lit(0))
    return rows.agg(F.count("*").alias("pages"), F.sum(F.when(F.col("links").isNotNull(), links)).alias("links"), F.sum(F.when(F.col("relationships").isNotNull(), hashes).otherwise(0)).alias("hashes"))


@query("WITH m AS (SELECT lower(action) AS action, source_id % 40 AS proposal_id, note_id FROM (SELECT DISTINCT note_id, source_id, action FROM note_sources WHERE source_id IS NOT NULL)), p AS (SELECT proposal_id, count(*) AS n, count(note_id) AS i, count(DISTINCT note_id) AS d FROM m GROUP BY 1) SELECT proposal_id, 'too_many_changes' AS problem FROM p WHERE n > 12 UNION ALL SELECT proposal_id, 'page_twice' FROM p WHERE d < i")
def i12_proposal_problems(spark, sf_dir):
    rows = table(spark, sf_dir, "note_sources").where("source_id is not null").select("note_id", "source_id", "action").distinct()
    return integrity.proposal_problems(rows.select((F.col("source_id") % 40).alias("proposal_id"), "note_id", F.lit(None).cast("string").alias("title")))


@query("SELECT content_hash, min(source_id) AS source_id, count(DISTINCT source_id) AS copies FROM sources GROUP BY 1")
def k1_archive_sink(spark, sf_dir):
    return duplicates.first_of_each(table(spark, sf_dir, "sources"), "content_hash", "source_id")


@query(f"WITH {N}, f AS (SELECT file_path AS path, coalesce(body, '') AS content FROM n) SELECT path, octet_length(encode(content)) AS size, sha256(content) AS hash FROM f")
def k5_export_manifest(spark, sf_dir):
    files = notes(spark, sf_dir).select(F.col("file_path").alias("path"), F.coalesce("body", F.lit("")).cast("binary").alias("content"))
    return integrity.export_manifest(files).select("path", "size", "hash")


# ---- ledgers and streams --------------------------------------------------------------------
MONTHS = "strftime(ts + to_months((event_id % 3)::INT), '%Y-%m')"


def token_events(rows: DataFrame) -> DataFrame:
    return rows.select(F.expr("ts + make_interval(0, cast(event_id % 3 as int))").alias("at"), "value")


@query(f"WITH l AS (SELECT {MONTHS} AS period, sum(floor(value))::BIGINT AS output_tokens FROM events GROUP BY 1) SELECT *, output_tokens > 1000000 AS warning FROM l")
def a19_token_ledger(spark, sf_dir):
    return arrivals.with_advisory(arrivals.token_ledger(token_events(table(spark, sf_dir, "events")), "at", "value"))


@query(f"SELECT {MONTHS} AS period, sum(floor(value))::BIGINT AS output_tokens FROM events GROUP BY 1")
def r5_stream_ledger(spark, sf_dir):
    stream = token_events(arrivals.stream_table(spark, sf_dir, "events"))
    return arrivals.run_to_table(arrivals.token_ledger(stream, "at", "value"), "complete")


@query("SELECT DISTINCT content_hash FROM sources")
def r6_stream_dedup(spark, sf_dir):
    stream = arrivals.stream_table(spark, sf_dir, "sources").select("content_hash")
    return arrivals.run_to_table(arrivals.new_sources(stream))


@query("SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {\"user_id\":' || user_id || ',\"event_id\":' || event_id || '}' || chr(10) || chr(10) AS message FROM events")
def r1_event_log(spark, sf_dir):
    stream = arrivals.stream_table(spark, sf_dir, "events").select("event_id", arrivals.event_message(F.col("event_type"), F.struct("user_id", "event_id")).alias("message"))
    return arrivals.run_to_table(stream)
