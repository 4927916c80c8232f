"""Registered queries on duplicates, discovery, review states and lint, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.validation import PAGE_TYPES_SQL
from tessera.operators import discovery, duplicates, graph, lexical, lint, vectors
from tessera.plans.retrieval import GE, NS, N, V, _rounded, edges, note_rows, note_sources, notes, seeds, sql_candidates, vector_rows
from tessera.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


TERMS = "[\\p{L}\\p{N}]+"
C_STOPS = "[" + ", ".join(f"'{w}'" for w in T.CANDIDATE_STOP_WORDS) + "]"
PAIRS = "pr AS (SELECT least(source_note_id, target_note_id) AS l_id, greatest(source_note_id, target_note_id) AS r_id FROM links WHERE source_note_id <> target_note_id GROUP BY 1, 2)"


def pairs(spark, sf_dir) -> DataFrame:
    """Distinct unordered pairs of the stored suggestions."""
    rows = table(spark, sf_dir, "links").where("source_note_id <> target_note_id")
    return rows.select(F.least("source_note_id", "target_note_id").alias("l_id"), F.greatest("source_note_id", "target_note_id").alias("r_id")).distinct()


def tokens_sql(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '{TERMS}'), lambda t: len(t) >= 2 AND NOT list_contains({C_STOPS}, t)))"


def plain_terms_sql(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '{TERMS}'))"


def jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) ELSE 0 END"


def dice_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) ELSE 0 END"


def grams_sql(key: str) -> str:
    return f"CASE WHEN len({key}) >= 3 THEN list_distinct(list_transform(range(1, len({key}) - 1), lambda i: substr({key}, i, 3))) WHEN len({key}) > 0 THEN [{key}] ELSE [] END"


# ---- similarity and duplicates --------------------------------------------------------------
TK = f"tk AS (SELECT note_id, {tokens_sql('title')} AS tt, {tokens_sql('body')} AS tb FROM n)"
KEY = f"array_to_string(regexp_extract_all(lower(coalesce(title, '')), '{TERMS}'), ' ')"
KD = f"kd AS (SELECT note_id, key, {grams_sql('key')} AS g, {plain_terms_sql('coalesce(body, chr(32))')} AS b, coalesce(body, '') AS body FROM (SELECT note_id, {KEY} AS key, body FROM n))"


@query(f"WITH {N}, {TK} SELECT note_id, len(tt) AS title_tokens, len(tb) AS body_tokens, array_to_string(list_sort(tt), ' ') AS title_set FROM tk")
def c2_token_sets(spark, sf_dir):
    rows = notes(spark, sf_dir).select("note_id", *(T.discovery_tokens(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "body")))
    return rows.select("note_id", F.size("title").cast("bigint").alias("title_tokens"), F.size("body").cast("bigint").alias("body_tokens"), F.array_join(F.array_sort("title"), " ").alias("title_set"))


@query(f"WITH {N}, {TK}, {PAIRS} SELECT l_id, r_id, round(greatest({jaccard_sql('l.tt', 'r.tt')}, 0.65 * {jaccard_sql('l.tb', 'r.tb')}), 6)::DOUBLE AS lexical FROM pr JOIN tk l ON l_id = l.note_id JOIN tk r ON r_id = r.note_id")
def c3_lexical_similarity(spark, sf_dir):
    return _rounded(discovery.pair_similarity(pairs(spark, sf_dir), notes(spark, sf_dir)), "lexical")


@query(f"WITH {N}, {KD}, {PAIRS} SELECT l_id, r_id, round({jaccard_sql('l.b', 'r.b')}, 6)::DOUBLE AS similarity FROM pr JOIN kd l ON l_id = l.note_id JOIN kd r ON r_id = r.note_id")
def d1_jaccard(spark, sf_dir):
    base = notes(spark, sf_dir).select("note_id", F.array_distinct(T.terms(F.lower(F.coalesce("body", F.lit(""))))).alias("b"))
    both = pairs(spark, sf_dir).join(base.select(F.col("note_id").alias("l_id"), F.col("b").alias("lb")), "l_id").join(base.select(F.col("note_id").alias("r_id"), F.col("b").alias("rb")), "r_id")
    return _rounded(both.select("l_id", "r_id", T.jaccard(F.col("lb"), F.col("rb")).alias("similarity")), "similarity")


@query(f"WITH {N}, {KD}, {PAIRS} SELECT l_id, r_id, round(CASE WHEN l.key = r.key THEN 1 ELSE {dice_sql('l.g', 'r.g')} END, 6)::DOUBLE AS similarity FROM pr JOIN kd l ON l_id = l.note_id JOIN kd r ON r_id = r.note_id")
def d3_title_dice(spark, sf_dir):
    title = F.coalesce("title", F.lit(""))
    base = notes(spark, sf_dir).select("note_id", F.array_join(T.terms(F.lower(title)), " ").alias("k"), T.trigrams(title).alias("g"))
    both = pairs(spark, sf_dir).join(base.select(F.col("note_id").alias("l_id"), F.col("k").alias("lk"), F.col("g").alias("lg")), "l_id").join(base.select(F.col("note_id").alias("r_id"), F.col("k").alias("rk"), F.col("g").alias("rg")), "r_id")
    return _rounded(both.select("l_id", "r_id", F.when(F.col("lk") == F.col("rk"), 1.0).otherwise(T.dice(F.col("lg"), F.col("rg"))).alias("similarity")), "similarity")


def duplicates_sql(incoming: str) -> str:
    """CTEs ds (scores) and sd (the strongest duplicate) of the incoming notes that a condition on l names."""
    return f"""ds AS (SELECT l.note_id AS incoming_id, r.note_id AS existing_id, CASE WHEN l.key = r.key THEN 4 WHEN {dice_sql('l.g', 'r.g')} >= 0.88 THEN 3 + {dice_sql('l.g', 'r.g')} WHEN {jaccard_sql('l.b', 'r.b')} >= 0.88 THEN 2 + {jaccard_sql('l.b', 'r.b')} END AS score
  FROM kd l JOIN kd r ON l.note_id <> r.note_id WHERE {incoming}),
  rk AS (SELECT *, row_number() OVER w AS p, lead(score) OVER w AS second FROM ds WHERE score IS NOT NULL WINDOW w AS (PARTITION BY incoming_id ORDER BY score DESC, existing_id)),
  sd AS (SELECT incoming_id, existing_id, score FROM rk WHERE p = 1 AND (score >= 4 OR second IS NULL OR score - second >= 0.08))"""


DS = duplicates_sql("l.note_id % 50 = 0")


def incoming(all_notes: DataFrame) -> DataFrame:
    return all_notes.where("note_id % 50 = 0")


@query(f"WITH {N}, {KD}, {DS} SELECT incoming_id, existing_id, round(score, 6)::DOUBLE AS score FROM ds WHERE score IS NOT NULL")
def j21_duplicate_scores(spark, sf_dir):
    base = note_rows(spark, sf_dir)
    return _rounded(duplicates.duplicate_scores(incoming(base), base), "score")


@query(f"WITH {N}, {KD}, {DS} SELECT incoming_id, existing_id, round(score, 6)::DOUBLE AS score FROM sd")
def d4_strongest_duplicate(spark, sf_dir):
    base = note_rows(spark, sf_dir)
    return _rounded(duplicates.strongest_of(incoming(base), base), "score")


def numbers_sql(c: str) -> str:
    x = f"list_transform(regexp_extract_all({c}, '[-+]?\\d[\\d,]*(?:\\.\\d+)?%?'), lambda z: replace(z, ',', ''))"
    for pattern, to in (("^\\+", ""), ("^(-?)0+([0-9])", "\\1\\2"), ("(\\.[0-9]*?)0+(%?)$", "\\1\\2"), ("\\.(%?)$", "\\1"), ("^-0(%?)$", "0\\1")):
        x = f"list_transform({x}, lambda z: regexp_replace(z, '{pattern}', '{to}'))"
    return f"list_distinct({x})"


@query(f"WITH {N} SELECT note_id, array_to_string(list_sort({numbers_sql('coalesce(body, chr(32))')}), ' ') AS numbers FROM n")
def d5_number_sets(spark, sf_dir):
    return notes(spark, sf_dir).select("note_id", F.array_join(F.array_sort(T.number_set(F.coalesce("body", F.lit("")))), " ").alias("numbers"))


_CORRECTION = T.CORRECTION
CONFLICT = f"""nb AS (SELECT note_id, body, {numbers_sql('body')} AS nums, {plain_terms_sql("regexp_replace(body, '[-+]?\\d[\\d,]*(?:\\.\\d+)?%?', ' number ', 'g')")} AS masked FROM (SELECT note_id, coalesce(body, '') AS body FROM n))"""


def conflict_sql(old: str, new: str) -> str:
    return f"(len({old}.nums) > 0 AND len({new}.nums) > 0 AND len(list_filter({new}.nums, lambda x: NOT list_contains({old}.nums, x))) > 0 AND (regexp_matches({new}.body, '{_CORRECTION}') OR ({jaccard_sql(old + '.masked', new + '.masked')}) >= 0.72))"


@query(f"WITH {N}, {CONFLICT}, {PAIRS} SELECT l_id, r_id, {conflict_sql('l', 'r')} AS conflict FROM pr JOIN nb l ON l_id = l.note_id JOIN nb r ON r_id = r.note_id")
def d6_numeric_conflict(spark, sf_dir):
    base = notes(spark, sf_dir).select("note_id", F.coalesce("body", F.lit("")).alias("b"))
    both = pairs(spark, sf_dir).join(base.select(F.col("note_id").alias("l_id"), F.col("b").alias("lb")), "l_id").join(base.select(F.col("note_id").alias("r_id"), F.col("b").alias("rb")), "r_id")
    return both.select("l_id", "r_id", T.numeric_conflict(F.col("lb"), F.col("rb")).alias("conflict"))


DEC = "dc AS (SELECT r_id AS incoming_id, CASE r_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'merge' ELSE 'contradict' END AS action, CASE WHEN r_id % 3 > 0 THEN min(l_id) END AS existing_id FROM pr GROUP BY r_id)"


@query(
    f"""WITH {N}, {KD}, {PAIRS}, {DEC}, {duplicates_sql("l.note_id IN (SELECT incoming_id FROM dc)")}, {CONFLICT}, jn AS (SELECT dc.incoming_id, action, sd.existing_id AS dup, coalesce(sd.existing_id, dc.existing_id) AS target FROM dc LEFT JOIN sd USING (incoming_id)),
  cf AS (SELECT jn.*, coalesce({conflict_sql('o', 'w')}, false) AS conflict FROM jn LEFT JOIN nb w ON w.note_id = incoming_id LEFT JOIN nb o ON o.note_id = target),
  ac AS (SELECT incoming_id, target, CASE WHEN dup IS NOT NULL THEN CASE WHEN conflict OR action = 'contradict' THEN 'contradict' ELSE 'merge' END WHEN action = 'merge' AND conflict THEN 'contradict' ELSE action END AS action FROM cf)
  SELECT incoming_id, action, CASE WHEN action <> 'new' THEN target END AS existing_id FROM ac"""
)
def d7_decisions(spark, sf_dir):
    base = note_rows(spark, sf_dir)
    of = pairs(spark, sf_dir).groupBy(F.col("r_id").alias("incoming_id")).agg(F.min("l_id").alias("low"))
    kind = F.col("incoming_id") % 3
    decisions = of.select("incoming_id", F.when(kind == 0, "new").when(kind == 1, "merge").otherwise("contradict").alias("action"), F.when(kind > 0, F.col("low")).alias("existing_id"))
    decided = duplicates.only(base, decisions.select(F.col("incoming_id").alias("note_id")))
    found = duplicates.strongest_of(decided, base)
    return duplicates.safeguarded(decisions, found, base)


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(DISTINCT doc_id) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def d11_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return duplicates.first_of_each(docs, "content_hash", "doc_id")


@query("SELECT note_id, string_agg(DISTINCT source_id::VARCHAR, ',' ORDER BY source_id::VARCHAR) AS source_ids, string_agg(DISTINCT lower(action), ',' ORDER BY lower(action)) AS actions FROM note_sources WHERE note_id IS NOT NULL AND source_id IS NOT NULL GROUP BY note_id")
def d12_reference_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "note_sources").where("note_id is not null and source_id is not null")
    merged = rows.groupBy("note_id").agg(F.array_sort(F.collect_set(F.col("source_id").cast("string"))).alias("s"), F.array_sort(F.collect_set(F.lower("action"))).alias("a"))
    return merged.select("note_id", F.array_join("s", ",").alias("source_ids"), F.nullif(F.array_join("a", ","), F.lit("")).alias("actions"))


# ---- discovery ------------------------------------------------------------------------------
EV = "ev AS (SELECT note_id, sha256(to_json({'title': title, 'type': type, 'body': body, 'sourceIds': ids})::VARCHAR) AS evidence_hash FROM n JOIN (SELECT note_id, list(source_id ORDER BY source_id) AS ids FROM ns GROUP BY 1) USING (note_id))"


def hashes(spark, sf_dir) -> DataFrame:
    return discovery.evidence(notes(spark, sf_dir), note_sources(spark, sf_dir))


@query(f"WITH {N}, {NS}, {EV} SELECT * FROM ev")
def c1_evidence_hash(spark, sf_dir):
    return hashes(spark, sf_dir)


@query(
    f"""WITH {N}, {NS}, {EV} SELECT sha256('[' || string_agg('[' || note_id || ',"' || evidence_hash || '"]', ',' ORDER BY note_id) || ']') AS snapshot_hash FROM ev"""
)
def a20_snapshot_hash(spark, sf_dir):
    return discovery.snapshot_hash(hashes(spark, sf_dir))


FP = """'{"promptVersion":"1","model":"stub","left":[' || l_id || ',"' || a.evidence_hash || '"],"right":[' || r_id || ',"' || b.evidence_hash || '"]}'"""
FPS = f"fps AS (SELECT l_id, r_id, sha256({FP}) AS fingerprint FROM pr JOIN ev a ON l_id = a.note_id JOIN ev b ON r_id = b.note_id)"


def fingerprints(spark, sf_dir) -> DataFrame:
    h = hashes(spark, sf_dir)
    both = pairs(spark, sf_dir).join(h.select(F.col("note_id").alias("l_id"), F.col("evidence_hash").alias("lh")), "l_id").join(h.select(F.col("note_id").alias("r_id"), F.col("evidence_hash").alias("rh")), "r_id")
    return both.select("l_id", "r_id", discovery.fingerprint("1", "stub", F.col("l_id"), F.col("lh"), F.col("r_id"), F.col("rh")).alias("fingerprint"))


@query(f"WITH {N}, {NS}, {EV}, {PAIRS}, {FPS} SELECT * FROM fps")
def c7_fingerprint(spark, sf_dir):
    return fingerprints(spark, sf_dir)


# Stored candidates: the suggestions whose smaller id is even, in two generations, with a status by id; a new staging has those whose sum of ids is even.
ST = """stored AS (SELECT fingerprint, 1 + l_id % 4 // 2 AS generation, round((l_id % 100) / 100.0, 2)::DOUBLE AS score, CASE r_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'reviewed' ELSE 'proposed' END AS status FROM fps WHERE l_id % 2 = 0),
  fresh AS (SELECT fingerprint, round((r_id % 100) / 100.0, 2)::DOUBLE AS score FROM fps WHERE (l_id + r_id) % 2 = 0)"""
RS = "rs AS (SELECT coalesce(s.fingerprint, f.fingerprint) AS fingerprint, CASE WHEN f.fingerprint IS NOT NULL THEN 3 ELSE generation END AS generation, coalesce(f.score, s.score) AS score, coalesce(status, 'queued') AS status FROM stored s FULL JOIN fresh f ON s.fingerprint = f.fingerprint)"


def stored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    fps = fingerprints(spark, sf_dir)
    status = F.when(F.col("r_id") % 3 == 0, "queued").when(F.col("r_id") % 3 == 1, "reviewed").otherwise("proposed")
    old = fps.where("l_id % 2 = 0").select("fingerprint", (1 + F.floor((F.col("l_id") % 4) / 2)).cast("bigint").alias("generation"), F.round((F.col("l_id") % 100) / 100, 2).alias("score"), status.alias("status"))
    return old, fps.where("(l_id + r_id) % 2 = 0").select("fingerprint", F.round((F.col("r_id") % 100) / 100, 2).alias("score"))


@query(f"WITH {N}, {NS}, {EV}, {PAIRS}, {FPS}, {ST}, {RS} SELECT fingerprint, generation, score, status FROM rs")
def c8_restage_merge(spark, sf_dir):
    return discovery.restage(*stored(spark, sf_dir), generation=3)


@query(
    f"""WITH {N}, {NS}, {EV}, {PAIRS}, {FPS}, {ST}, {RS}, c AS (SELECT generation, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'reviewed') AS reviewed, count(*) FILTER (status = 'proposed') AS proposed, count(*) AS total FROM rs GROUP BY 1)
  SELECT *, reviewed + proposed AS evaluated, queued AS remaining, queued = 0 AS complete FROM c"""
)
def a2_coverage(spark, sf_dir):
    return discovery.coverage(discovery.restage(*stored(spark, sf_dir), generation=3))


@query(f"WITH {N}, {NS}, {EV}, {PAIRS}, {FPS}, {ST}, {RS} SELECT fingerprint, score, ((row_number() OVER (ORDER BY score DESC, fingerprint) - 1) // 5 + 1)::INT AS batch FROM rs WHERE generation = 3 AND status = 'queued' ORDER BY score DESC, fingerprint LIMIT 20")
def c10_dequeue(spark, sf_dir):
    return discovery.dequeue(discovery.restage(*stored(spark, sf_dir), generation=3), 3)


@query(f"WITH {N}, {NS}, {EV}, {PAIRS}, {FPS}, {ST} SELECT fingerprint, score, 'queued' AS status FROM fresh WHERE fingerprint NOT IN (SELECT fingerprint FROM stored) UNION ALL SELECT fingerprint, score, status FROM stored")
def c13_insert_or_ignore(spark, sf_dir):
    old, fresh = stored(spark, sf_dir)
    return discovery.insert_or_ignore(old.select("fingerprint", "score", "status"), fresh.withColumn("status", F.lit("queued")))


# Discoveries: each note with its linked explicit neighbours; the stored hash of every seventh page is out of date.
DI = f"""di AS (SELECT node AS id, list_sort(list_distinct([node] || list(other))) AS pages FROM inc WHERE kind = 'explicit' GROUP BY node),
  dp AS (SELECT id, unnest(pages) AS note_id FROM di), dv AS (SELECT id, dp.note_id, CASE WHEN dp.note_id % 7 = 0 THEN 'old' ELSE evidence_hash END AS stored, evidence_hash FROM dp LEFT JOIN ev USING (note_id))"""


def discoveries(spark, sf_dir) -> DataFrame:
    linked = graph.incident(edges(spark, sf_dir).where("kind = 'explicit'")).groupBy(F.col("node").alias("id")).agg(F.collect_set("other").alias("o"))
    pages = linked.select("id", F.explode(F.array_union(F.array("id"), "o")).alias("note_id"))
    with_hash = pages.join(hashes(spark, sf_dir), "note_id", "left").select("id", "note_id", F.when(F.col("note_id") % 7 == 0, "old").otherwise(F.col("evidence_hash")).alias("h"))
    whole = with_hash.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("note_id", "h"))).alias("p"))
    return whole.select("id", F.col("p.note_id").alias("page_ids"), F.col("p.h").alias("page_hashes"))


@query(
    f"""WITH {N}, {NS}, {EV}, {GE}, {DI}, ok AS (SELECT id FROM dv GROUP BY id HAVING bool_and(coalesce(stored = evidence_hash, false)))
  SELECT DISTINCT a.note_id AS l, b.note_id AS r FROM dp a JOIN dp b ON a.id = b.id AND a.note_id < b.note_id WHERE a.id IN (SELECT id FROM ok)"""
)
def j11_known_pairs(spark, sf_dir):
    return discovery.known_pairs(discoveries(spark, sf_dir), hashes(spark, sf_dir))


@query(f"WITH {N}, {NS}, {EV}, {GE}, {DI} SELECT id, count(*) FILTER (NOT coalesce(stored = evidence_hash, false)) AS changed FROM dv GROUP BY id")
def c16_stale(spark, sf_dir):
    return discovery.stale(discoveries(spark, sf_dir), hashes(spark, sf_dir))


@query(
    f"""WITH {N}, {NS}, {GE}, {V}, {sql_candidates(16)}, {TK},
  nn AS (SELECT l.id AS l_id, r.id AS r_id, list_cosine_similarity(l.v, r.v) AS s, row_number() OVER (PARTITION BY l.id ORDER BY round(list_cosine_similarity(l.v, r.v), 12) DESC, r.id) AS p FROM v l JOIN v r ON l.id <> r.id WHERE l.id % 50 = 0),
  ca AS (SELECT l_id, r_id, s AS semantic, p FROM nn WHERE p <= 63 UNION ALL SELECT seed_id, note_id, NULL, 0 FROM ic WHERE seed_id <> note_id),
  ap AS (SELECT * FROM ca WHERE l_id IN (SELECT note_id FROM ns) AND r_id IN (SELECT note_id FROM ns) AND NOT EXISTS (SELECT 1 FROM ns x JOIN ns y USING (source_id) WHERE x.note_id = l_id AND y.note_id = r_id)),
  o AS (SELECT * FROM ap WHERE NOT EXISTS (FROM ex WHERE source = least(l_id, r_id) AND target = greatest(l_id, r_id))),
  sc AS (SELECT l_id, r_id, semantic, p, greatest({jaccard_sql('l.tt', 'r.tt')}, 0.65 * {jaccard_sql('l.tb', 'r.tb')}) AS lexical FROM o JOIN tk l ON l_id = l.note_id JOIN tk r ON r_id = r.note_id),
  ok AS (SELECT * FROM sc WHERE coalesce(semantic, 0) >= 0.5 OR lexical >= 0.12),
  q AS (SELECT * FROM ok WHERE semantic IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY p) <= 8 UNION ALL SELECT * FROM ok WHERE semantic IS NULL)
  SELECT least(l_id, r_id) AS left_id, greatest(l_id, r_id) AS right_id, round(max(least(1, greatest(coalesce(greatest(semantic, 0), 0), lexical))), 6)::DOUBLE AS score FROM q GROUP BY 1, 2"""
)
def c4_candidates(spark, sf_dir):
    base, rows = notes(spark, sf_dir), vector_rows(spark, sf_dir)
    near = vectors.nearest_of_all(rows.where("id % 50 = 0"), rows, discovery.NEAREST - 1)
    texts = note_rows(spark, sf_dir)
    hits = lexical.integration_candidates(texts, seeds(texts), limit=discovery.LEXICAL)
    known = graph.explicit_edges(base).select(F.col("source").alias("l"), F.col("target").alias("r"))
    return _rounded(discovery.candidates(near, hits, texts, note_sources(spark, sf_dir), known).select("left_id", "right_id", "score"), "score")


# ---- review states --------------------------------------------------------------------------
GUARD = {"investigating": ("pending",), "confirmed": ("pending", "investigating"), "rejected": ("pending", "investigating")}
STATE = "stt AS (SELECT note_id AS id, CASE note_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'investigating' WHEN 2 THEN 'confirmed' ELSE 'rejected' END AS status FROM n), cmd AS (SELECT note_id AS id, CASE note_id % 3 WHEN 0 THEN 'investigating' WHEN 1 THEN 'confirmed' ELSE 'rejected' END AS \"to\" FROM n WHERE note_id % 5 <> 0)"


@query(
    f"""WITH {N}, {STATE}, g AS (SELECT id, status, "to", CASE WHEN "to" IS NULL THEN NULL ELSE ("to" = 'investigating' AND status = 'pending') OR ("to" IN ('confirmed', 'rejected') AND status IN ('pending', 'investigating')) END AS applied FROM stt LEFT JOIN cmd USING (id))
  SELECT id, CASE WHEN applied THEN "to" ELSE status END AS status, coalesce(applied, false) AS applied FROM g"""
)
def i11_guarded_review(spark, sf_dir):
    base = notes(spark, sf_dir).select(F.col("note_id").alias("id"))
    by = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (F.col("id") % n + 1).cast("int"))
    state = base.select("id", by(4, "pending", "investigating", "confirmed", "rejected").alias("status"))
    commands = base.where("id % 5 <> 0").select("id", by(3, "investigating", "confirmed", "rejected").alias("to"))
    return discovery.guarded(state, commands, GUARD).withColumn("applied", F.coalesce("applied", F.lit(False)))


@query(f"WITH {N}, {STATE} SELECT id, status FROM stt WHERE status IN ('pending', 'investigating')")
def proj5_open_reviews(spark, sf_dir):
    base = notes(spark, sf_dir).select(F.col("note_id").alias("id"))
    status = F.element_at(F.array(*map(F.lit, ("pending", "investigating", "confirmed", "rejected"))), (F.col("id") % 4 + 1).cast("int"))
    return base.select("id", status.alias("status")).where(F.col("status").isin("pending", "investigating"))


# ---- lint -----------------------------------------------------------------------------------
PG = f"ac AS (SELECT DISTINCT note_id, source_id, action FROM note_sources WHERE source_id IS NOT NULL), ok AS (SELECT * FROM n WHERE body IS NOT NULL AND body <> '' AND title IS NOT NULL AND type IN {PAGE_TYPES_SQL}), oc AS (SELECT note_id, title, unnest(links) AS link FROM ok)"
LINT = {
    "l1_missing_provenance": "SELECT 'missing_provenance' AS code, 'warning' AS severity, note_id AS page_id, title AS page_title, NULL::VARCHAR AS related_title FROM n WHERE note_id NOT IN (SELECT note_id FROM ac)",
    "l2_recorded_contradiction": "SELECT 'recorded_contradiction' AS code, 'info' AS severity, note_id AS page_id, title AS page_title, NULL::VARCHAR AS related_title FROM n WHERE note_id IN (SELECT note_id FROM ac WHERE action = 'contradict')",
    "l3_unreadable_page": "SELECT 'unreadable_page' AS code, 'error' AS severity, note_id AS page_id, title AS page_title, NULL::VARCHAR AS related_title FROM n WHERE body IS NULL",
    "l4_legacy_format": "SELECT 'legacy_format' AS code, 'warning' AS severity, note_id AS page_id, title AS page_title, NULL::VARCHAR AS related_title FROM n WHERE body IS NOT NULL AND note_id NOT IN (SELECT note_id FROM ok)",
    "l5_duplicate_title": "SELECT 'duplicate_title' AS code, 'error' AS severity, note_id AS page_id, title AS page_title, lower(title) AS related_title FROM n WHERE lower(title) IN (SELECT lower(title) FROM n WHERE title IS NOT NULL GROUP BY 1 HAVING count(*) > 1)",
    "l6_broken_link": "SELECT 'broken_link' AS code, 'error' AS severity, note_id AS page_id, title AS page_title, link AS related_title FROM oc WHERE link <> '' AND lower(link) NOT IN (SELECT lower(title) FROM n WHERE title IS NOT NULL)",
    "l7_orphan_page": "SELECT 'orphan_page' AS code, 'warning' AS severity, note_id AS page_id, title AS page_title, NULL::VARCHAR AS related_title FROM ok WHERE lower(title) NOT IN (SELECT lower(link) FROM oc WHERE link <> '') AND (SELECT count(*) FROM ok) > 1",
}


def _actions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "note_sources").where("source_id is not null").select("note_id", "source_id", "action").distinct()


def _lint(name: str, f):
    def run(spark, sf_dir):
        return f(notes(spark, sf_dir), _actions(spark, sf_dir))

    run.__name__ = name
    query(f"WITH {N}, {PG} {LINT[name]}")(run)


_lint("l1_missing_provenance", lint.missing_provenance)
_lint("l2_recorded_contradiction", lint.recorded_contradiction)
_lint("l3_unreadable_page", lambda p, s: lint.unreadable(p))
_lint("l4_legacy_format", lambda p, s: lint.legacy_format(p))
_lint("l5_duplicate_title", lambda p, s: lint.duplicate_titles(p))
_lint("l6_broken_link", lambda p, s: lint.broken_links(p))
_lint("l7_orphan_page", lambda p, s: lint.orphan_pages(p))
ALL_LINT = " UNION ALL ".join(LINT.values())


@query(f"WITH {N}, {PG}, f AS ({ALL_LINT}) SELECT severity, count(*) AS findings, (SELECT count(*) FROM n) AS pages, (SELECT count(DISTINCT source_id) FROM ac) AS sources FROM f GROUP BY severity")
def l8_report(spark, sf_dir):
    base, sources = notes(spark, sf_dir), _actions(spark, sf_dir)
    return lint.summary(lint.report(base, sources), base, sources)


@query(f"WITH {N}, {PG} SELECT lower(link) AS key, count(*) AS inbound FROM oc WHERE link <> '' AND lower(link) IN (SELECT lower(title) FROM n WHERE title IS NOT NULL) GROUP BY 1")
def a7_inbound_links(spark, sf_dir):
    return lint.inbound_counts(notes(spark, sf_dir))


@query(f"WITH {N} SELECT lower(title) AS key, count(*) AS pages FROM n WHERE title IS NOT NULL GROUP BY 1")
def a6_title_multiplicity(spark, sf_dir):
    return notes(spark, sf_dir).where("title is not null").groupBy(F.lower("title").alias("key")).agg(F.count("*").alias("pages"))


@query(f"WITH {N}, t AS (SELECT lower(title) AS key, count(*) AS c FROM n WHERE title IS NOT NULL GROUP BY 1), l AS (SELECT note_id, unnest(links) AS link FROM n) SELECT note_id, link, coalesce(c, 0) AS matches FROM l LEFT JOIN t ON key = lower(link) WHERE link <> '' AND coalesce(c, 0) <> 1")
def j16_link_cardinality(spark, sf_dir):
    base = notes(spark, sf_dir)
    counts = base.where("title is not null").groupBy(F.lower("title").alias("key")).agg(F.count("*").alias("c"))
    links = base.select("note_id", F.explode("links").alias("link")).where("link <> ''").withColumn("key", F.lower("link"))
    return links.join(counts, "key", "left").select("note_id", "link", F.coalesce("c", F.lit(0).cast("bigint")).alias("matches")).where("matches <> 1")

