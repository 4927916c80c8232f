"""Registered queries on search, vectors and the page graph, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph, hybrid, lexical, vectors
from tessera.session import parallelism
from tessera.sources.tables import table

DIMS = 128
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each note: repeats of a row are exact. A fixed number of partitions keeps text work on all cores."""
    rows = table(spark, sf_dir, "notes").where("note_id is not null")
    return rows.repartition(parallelism(spark), "note_id").dropDuplicates(["note_id"])


def note_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of notes, repeats included: for operators that count repeats of an id once and so need no shuffle of texts."""
    return table(spark, sf_dir, "notes").where("note_id is not null")


def note_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "note_sources").where("note_id is not null and source_id is not null").select("note_id", "source_id").distinct()


def note_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.usable_vectors(table(spark, sf_dir, "note_vectors"), "note_id", "vector", DIMS)


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.usable_rows(table(spark, sf_dir, "note_vectors"), "note_id", "vector", DIMS)


# ---- SQL fragments --------------------------------------------------------------------------
N = "n AS (SELECT DISTINCT ON (note_id) * FROM notes WHERE note_id IS NOT NULL)"
V = f"""v AS (SELECT note_id AS id, min(vector)::DOUBLE[{DIMS}] AS v FROM note_vectors WHERE note_id IS NOT NULL AND len(vector) = {DIMS}
  AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY note_id)"""
NS = "ns AS (SELECT DISTINCT note_id, source_id FROM note_sources WHERE note_id IS NOT NULL AND source_id IS NOT NULL)"


def fold(column: str) -> str:
    return f"translate(lower({column}), '{T.ACCENTED}', '{T.BASE}')"


def sql_terms(*columns: str) -> str:
    return " || ".join(f"coalesce(regexp_extract_all({fold(c)}, '[\\p{{L}}\\p{{N}}]+'), [])" for c in columns)


P = f"d AS (SELECT note_id, title, {sql_terms('title', 'body')} AS terms FROM n), tf AS (SELECT note_id, term, count(*) AS tf FROM (SELECT note_id, unnest(terms) AS term FROM d) GROUP BY ALL)"


def bm25(words: list[str]) -> str:
    """CTE k(note_id, title, rank): the keyword search over n and tf."""
    wanted = ", ".join(f"('{w}')" for w in words)
    return f"""{P}, q(term) AS (VALUES {wanted}), st AS (SELECT count(*) AS n, sum(len(terms)) / count(*) AS avgdl FROM d),
  fr AS (SELECT term, count(*) AS df FROM tf WHERE term IN (FROM q) GROUP BY term),
  sc AS (SELECT tf.note_id, count(*) AS hits, sum(greatest(1e-6, ln((st.n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d.terms) / avgdl))) AS s
    FROM tf JOIN fr USING (term) JOIN d USING (note_id), st GROUP BY tf.note_id),
  need AS (SELECT CASE WHEN max(hits) = {len(words)} THEN {len(words)} ELSE 1 END AS least FROM sc),
  k AS (SELECT note_id, title, -s AS rank FROM sc JOIN d USING (note_id), need WHERE hits >= least ORDER BY round(-s, 10), note_id LIMIT 20)"""


ALL_TERMS, ANY_TERM = "admission window pilot", "telemetry farmacia kohorte"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- keyword search -------------------------------------------------------------------------
@query(f"WITH {N}, {bm25(ALL_TERMS.split())} SELECT note_id, title, round(rank, 6) AS rank FROM k")
def f2_keyword_and(spark, sf_dir):
    return _rounded(lexical.keyword_search(notes(spark, sf_dir), ALL_TERMS), "rank")


@query(f"WITH {N}, {bm25(ANY_TERM.split())} SELECT note_id, title, round(rank, 6) AS rank FROM k")
def f2_keyword_or_fallback(spark, sf_dir):
    return _rounded(lexical.keyword_search(notes(spark, sf_dir), ANY_TERM), "rank")


@query(f"WITH {N}, {bm25(ALL_TERMS.split())} SELECT note_id, round(-rank, 6) AS score FROM k")
def f7_public_score(spark, sf_dir):
    found = lexical.keyword_search(notes(spark, sf_dir), ALL_TERMS)
    return found.select("note_id", F.round(-F.col("rank"), 6).alias("score"))


@query(f"WITH {N}, {P} SELECT note_id, term, tf FROM tf")
def f5_postings(spark, sf_dir):
    return lexical.postings(notes(spark, sf_dir), "note_id", "title", "body")


@query(f"WITH {N}, {P} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term")
def f3_term_statistics(spark, sf_dir):
    return lexical.postings(notes(spark, sf_dir), "note_id", "title", "body").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_STOPS = "[" + ", ".join(f"'{w}'" for w in T.SEARCH_STOP_WORDS) + "]"


@query(
    f"""WITH s AS (SELECT DISTINCT source_id, title FROM sources WHERE title IS NOT NULL),
  t AS (SELECT source_id, regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+') AS a FROM s),
  u AS (SELECT source_id, list_filter(a, lambda x, i: list_position(a, x) = i)[:16] AS a FROM t),
  w AS (SELECT source_id, a, list_filter(a, lambda x: NOT list_contains({_STOPS}, x)) AS b FROM u)
  SELECT source_id, array_to_string(CASE WHEN len(b) > 0 THEN b ELSE a END, ' ') AS terms FROM w"""
)
def f1_query_terms(spark, sf_dir):
    titles = table(spark, sf_dir, "sources").where("title is not null").select("source_id", "title").distinct()
    return titles.select("source_id", F.array_join(T.query_terms(F.col("title")), " ").alias("terms"))


def sql_candidates(limit: int) -> str:
    """CTE ic(seed_id, note_id, score, position) for seeds whose id is divisible by 50."""
    return f"""{P}, sd AS (SELECT note_id AS seed_id, regexp_extract_all(lower(coalesce(title, '') || chr(10) || coalesce(body, '')), '[\\p{{L}}\\p{{N}}]+') AS a FROM n WHERE note_id % 50 = 0),
  sf AS (SELECT seed_id, list_filter(a, lambda x: len(x) >= 2 AND NOT list_contains({_STOPS}, x)) AS a FROM sd),
  sw AS (SELECT DISTINCT seed_id, {fold("unnest(list_filter(a, lambda x, i: list_position(a, x) = i)[:16])")} AS term FROM sf),
  st AS (SELECT count(*) AS n, sum(len(terms)) / count(*) AS avgdl FROM d), fr AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM sw) GROUP BY term),
  ic AS (SELECT seed_id, tf.note_id, sum(greatest(1e-6, ln((st.n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d.terms) / avgdl))) AS score
    FROM sw JOIN tf USING (term) JOIN fr USING (term) JOIN d USING (note_id), st GROUP BY seed_id, tf.note_id
    QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY round(score, 9) DESC, tf.note_id) <= {limit})"""


def seeds(all_notes: DataFrame) -> DataFrame:
    """The stated query set: notes whose id is divisible by 50."""
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    return all_notes.where("note_id % 50 = 0").select(F.col("note_id").alias("seed_id"), text.alias("text"))


@query(f"WITH {N}, {sql_candidates(8)} SELECT seed_id, note_id, round(score, 6) AS score FROM ic")
def f6_integration_candidates(spark, sf_dir):
    base = note_rows(spark, sf_dir)
    return _rounded(lexical.integration_candidates(base, seeds(base), limit=8), "score").select("seed_id", "note_id", "score")


@query(f"""WITH {N}, b AS (SELECT note_id, trim(regexp_replace(lower(title), '\\s+', ' ', 'g'), ' ') AS k FROM n)
  SELECT note_id, CASE WHEN k = 'training module' THEN 1.0 WHEN starts_with(k, 'training module') THEN 0.25 WHEN contains(k, 'training module') THEN 0.1 ELSE 0.0 END::DOUBLE AS boost FROM b""")
def f8_title_boost(spark, sf_dir):
    return notes(spark, sf_dir).select("note_id", lexical.title_boost(F.col("title"), "Training  Module").alias("boost"))


# ---- vectors --------------------------------------------------------------------------------
QV = "qv AS (SELECT v AS q FROM v ORDER BY id LIMIT 1)"
SEM = "s AS (SELECT id AS note_id, list_cosine_similarity(v, q) AS similarity FROM v, qv ORDER BY round(similarity, 12) DESC, id LIMIT 20)"


def _query_vector(rows: DataFrame) -> list[float]:
    first = rows.orderBy("id").limit(1).collect()
    return list(first[0]["v"]) if first else [1.0] + [0.0] * (DIMS - 1)


@query(f"WITH {V}, {QV}, {SEM} SELECT note_id, round(similarity, 6) AS similarity FROM s")
def v1_semantic_topk(spark, sf_dir):
    rows = note_vectors(spark, sf_dir)
    return _rounded(vectors.nearest_to(rows, _query_vector(rows), 20), "similarity").withColumnRenamed("id", "note_id")


def _nearest_sql(k: int) -> str:
    return f"""nn AS (SELECT l.id AS left_id, r.id AS right_id, list_cosine_similarity(l.v, r.v) AS similarity FROM v l JOIN v r ON l.id <> r.id WHERE l.id % 50 = 0
    QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY round(similarity, 12) DESC, r.id) <= {k})"""


@query(f"WITH {V}, {_nearest_sql(8)} SELECT left_id, right_id, round(similarity, 6) AS similarity FROM nn")
def v2_nearest_excl_self(spark, sf_dir):
    rows = note_vectors(spark, sf_dir)
    return _rounded(vectors.nearest_of_all(rows.where("id % 50 = 0"), rows, 8), "similarity").drop("position")


@query(
    f"""WITH {V}, {NS}, x AS (SELECT DISTINCT a.note_id AS l, b.note_id AS r FROM ns a JOIN ns b USING (source_id)),
  p AS (SELECT l.id AS l, r.id AS r, round(list_cosine_similarity(l.v, r.v), 12) AS s FROM v l JOIN v r ON l.id <> r.id WHERE NOT EXISTS (FROM x WHERE x.l = l.id AND x.r = r.id)),
  k AS (SELECT * FROM p WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY l ORDER BY s DESC, r) <= 8)
  SELECT least(l, r) AS source_note_id, greatest(l, r) AS target_note_id, round(min(s), 6) AS similarity FROM k GROUP BY 1, 2 HAVING count(*) = 2"""
)
def v9_mutual_links(spark, sf_dir):
    return _rounded(vectors.mutual_links(vector_rows(spark, sf_dir), note_sources(spark, sf_dir)), "similarity")


@query(f"WITH {N}, {V} SELECT note_id FROM n WHERE note_id NOT IN (SELECT id FROM v)")
def j4_unembedded(spark, sf_dir):
    return vectors.unembedded(notes(spark, sf_dir), note_vectors(spark, sf_dir))


@query(f"WITH {N}, {V}, c AS (SELECT count(*) AS total, count(v.id) AS embedded FROM n LEFT JOIN v ON id = note_id) SELECT total, embedded, greatest(0, total - embedded) AS remaining, total = embedded AS complete FROM c")
def a1_index_status(spark, sf_dir):
    return vectors.index_status(notes(spark, sf_dir), note_vectors(spark, sf_dir))


# ---- fusion ---------------------------------------------------------------------------------
BOOST = f"CASE WHEN tk = '{ALL_TERMS}' THEN 1.0 WHEN starts_with(tk, '{ALL_TERMS}') THEN 0.25 WHEN contains(tk, '{ALL_TERMS}') THEN 0.1 ELSE 0.0 END"


@query(
    f"""WITH {N}, {V}, {bm25(ALL_TERMS.split())}, {QV}, {SEM}, kp AS (SELECT note_id, row_number() OVER (ORDER BY round(rank, 10), note_id) AS p FROM k),
  sp AS (SELECT note_id, row_number() OVER (ORDER BY round(similarity, 12) DESC, note_id) AS p FROM s),
  f AS (SELECT coalesce(kp.note_id, sp.note_id) AS note_id, kp.p AS a, sp.p AS b FROM kp FULL JOIN sp ON kp.note_id = sp.note_id),
  g AS (SELECT note_id, title, a, b, trim(regexp_replace(lower(title), '\\s+', ' ', 'g'), ' ') AS tk FROM f JOIN n USING (note_id)),
  h AS (SELECT note_id, title, {BOOST} + coalesce(1 / (60 + a), 0) + coalesce(1 / (60 + b), 0) AS score, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'both' WHEN a IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS match_type FROM g)
  SELECT note_id, title, round(score, 6) AS score, match_type FROM h ORDER BY round(h.score, 12) DESC, title, note_id LIMIT 20"""
)
def h1_rrf(spark, sf_dir):
    base, rows = notes(spark, sf_dir), note_vectors(spark, sf_dir)
    keyword = hybrid.positions(lexical.keyword_search(base, ALL_TERMS), F.round("rank", 10), "note_id")
    near = vectors.nearest_to(rows, _query_vector(rows), 20).withColumnRenamed("id", "note_id")
    semantic = hybrid.positions(near, F.round("similarity", 12).desc(), "note_id")
    return _rounded(hybrid.fuse(keyword, semantic, base, ALL_TERMS), "score")


# ---- graph ----------------------------------------------------------------------------------
TI = "ti AS (SELECT lower(title) AS key, min(note_id) AS id FROM n WHERE title IS NOT NULL GROUP BY 1 HAVING count(*) = 1)"
EX = f"""{TI}, ln AS (SELECT note_id, lower(unnest(links)) AS key FROM n), ex0 AS (SELECT DISTINCT least(note_id, id) AS source, greatest(note_id, id) AS target FROM ln JOIN ti USING (key) WHERE id <> note_id),
  rl AS (SELECT note_id, unnest(relationships) AS r FROM n), rt AS (SELECT least(note_id, id) AS source, greatest(note_id, id) AS target, string_agg(r.type, ',' ORDER BY r.type) AS relationships FROM rl JOIN ti ON key = lower(r.target) WHERE id <> note_id GROUP BY 1, 2),
  ex AS (SELECT source, target, coalesce(relationships, '') AS relationships FROM ex0 LEFT JOIN rt USING (source, target))"""
GE = f"""{EX}, sm0 AS (SELECT least(source_note_id, target_note_id) AS source, greatest(source_note_id, target_note_id) AS target, min(similarity) AS similarity FROM links WHERE similarity IS NOT NULL AND source_note_id <> target_note_id GROUP BY 1, 2),
  sm AS (SELECT * FROM sm0 WHERE NOT EXISTS (FROM ex WHERE ex.source = sm0.source AND ex.target = sm0.target) AND source IN (SELECT note_id FROM n) AND target IN (SELECT note_id FROM n)),
  ge AS (SELECT source, target, 'explicit' AS kind, NULL::DOUBLE AS similarity, relationships FROM ex UNION ALL SELECT source, target, 'semantic', similarity, '' FROM sm),
  inc AS (SELECT source AS node, target AS other, * FROM ge UNION ALL SELECT target, source, * FROM ge)"""


def edges(spark, sf_dir) -> DataFrame:
    return graph.graph_edges(notes(spark, sf_dir), table(spark, sf_dir, "links"))


@query(f"WITH {N}, {GE} SELECT source, target, kind, round(similarity, 6) AS similarity, relationships FROM ge")
def g1_graph_edges(spark, sf_dir):
    return _rounded(edges(spark, sf_dir), "similarity")


@query(f"WITH {N}, {TI} SELECT key, id FROM ti")
def j8_title_resolution(spark, sf_dir):
    return graph.title_index(notes(spark, sf_dir))


@query(f"WITH {N}, {GE} SELECT source, target, round(similarity, 6) AS similarity FROM sm")
def j9_semantic_without_explicit(spark, sf_dir):
    return _rounded(edges(spark, sf_dir).where("kind = 'semantic'").select("source", "target", "similarity"), "similarity")


@query(
    f"""WITH {N}, {GE} SELECT node, other, n.title, kind, round(similarity, 6) AS similarity,
  row_number() OVER (PARTITION BY node ORDER BY kind <> 'explicit', similarity DESC NULLS LAST, n.title NULLS FIRST, other)::INT AS position FROM inc JOIN n ON other = n.note_id"""
)
def g2_related(spark, sf_dir):
    return _rounded(graph.related(edges(spark, sf_dir), notes(spark, sf_dir)), "similarity")


@query(
    """WITH l AS (SELECT DISTINCT source_note_id AS a, target_note_id AS b, similarity FROM links WHERE similarity IS NOT NULL),
  u AS (SELECT a AS node, b AS other, similarity FROM l UNION SELECT b, a, similarity FROM l) SELECT node, other, round(similarity, 6) AS similarity FROM u QUALIFY row_number() OVER (PARTITION BY node ORDER BY similarity DESC, other) <= 3"""
)
def so1_related_union(spark, sf_dir):
    from pyspark.sql import Window

    links = table(spark, sf_dir, "links").where("similarity is not null")
    both = links.select(F.col("source_note_id").alias("node"), F.col("target_note_id").alias("other"), "similarity")
    both = both.union(links.select("target_note_id", "source_note_id", "similarity")).distinct()
    ranked = both.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("similarity"), "other")))
    return _rounded(ranked.where("n <= 3").drop("n"), "similarity")


@query(
    f"""WITH {N}, {GE}, m AS (SELECT note_id AS node FROM n WHERE contains(lower(title), 'window')), kp AS (SELECT node FROM m UNION SELECT other FROM inc WHERE node IN (SELECT node FROM m))
  SELECT source, target, kind FROM ge WHERE source IN (SELECT node FROM kp) AND target IN (SELECT node FROM kp)"""
)
def g4_context_subgraph(spark, sf_dir):
    matches = notes(spark, sf_dir).where(F.contains(F.lower("title"), F.lit("window"))).select(F.col("note_id").alias("node"))
    return graph.context_subgraph(edges(spark, sf_dir), matches).select("source", "target", "kind")


@query(f"WITH {N}, {GE} SELECT node, other, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM inc GROUP BY 1, 2")
def g6_neighbour_rows(spark, sf_dir):
    return graph.neighbour_kinds(edges(spark, sf_dir))


_DG = "dg AS (SELECT node, sum(e)::BIGINT AS reviewed, sum(1 - e)::BIGINT AS semantic_only FROM (SELECT node, other, max((kind = 'explicit')::INT) AS e FROM inc GROUP BY 1, 2) GROUP BY node)"


@query(f"WITH {N}, {GE}, {_DG} SELECT * FROM dg")
def a13_degree(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))


@query(
    f"""WITH {N}, {GE}, {_DG}, r AS (SELECT node, semantic_only AS s, least(15, 6 + 2 * sqrt(reviewed)) AS radius FROM dg)
  SELECT node, round(radius, 6) AS radius, round(CASE WHEN s > 0 THEN radius + 3 ELSE radius END, 6) AS halo, round(CASE WHEN s > 0 THEN least(0.22, 0.08 + 0.03 * sqrt(s)) ELSE 0 END, 6) AS opacity FROM r"""
)
def g7_presentation(spark, sf_dir):
    return _rounded(graph.presentation(graph.degrees(edges(spark, sf_dir))), "radius", "halo", "opacity")


@query(
    f"""WITH {N}, {GE}, rg AS (SELECT coalesce(min(similarity), 0) AS lo, coalesce(max(similarity), 1) AS hi FROM ge WHERE kind = 'semantic' AND similarity BETWEEN -1 AND 1),
  sh AS (SELECT source, target, kind, CASE WHEN hi - lo > 2.2e-16 THEN greatest(0, least(1, (similarity - lo) / (hi - lo))) ELSE 0.5 END AS x FROM ge, rg)
  SELECT source, target, kind, round(CASE WHEN kind = 'explicit' THEN 0.08 ELSE 0.22 + 0.58 * x END, 6)::DOUBLE AS strength, round(CASE WHEN kind = 'explicit' THEN 105 ELSE 130 - 80 * x END, 6)::DOUBLE AS distance FROM sh"""
)
def g8_edge_layout(spark, sf_dir):
    return _rounded(graph.layout(edges(spark, sf_dir)), "strength", "distance")


@query(f"WITH {N}, {GE} SELECT round(coalesce(min(similarity), 0), 6) AS low, round(coalesce(max(similarity), 1), 6) AS high FROM ge WHERE kind = 'semantic' AND similarity BETWEEN -1 AND 1")
def a14_similarity_range(spark, sf_dir):
    return _rounded(graph.similarity_range(edges(spark, sf_dir)), "low", "high")


@query(
    f"""WITH {N}, {GE}, t AS (SELECT * FROM inc WHERE kind = 'semantic' QUALIFY row_number() OVER (PARTITION BY node ORDER BY similarity DESC, source, target) <= 2)
  SELECT DISTINCT source, target, kind FROM t UNION ALL SELECT source, target, kind FROM ge WHERE kind = 'explicit'"""
)
def w4_top_incident(spark, sf_dir):
    return graph.top_incident(edges(spark, sf_dir), 2).select("source", "target", "kind")


@query()
def h4_question_context(spark, sf_dir):
    base, rows = notes(spark, sf_dir), note_vectors(spark, sf_dir)
    asked = spark.createDataFrame([(0, "Which admission window did the pilot site use?")], "seed_id bigint, text string")
    keyword = lexical.integration_candidates(note_rows(spark, sf_dir), asked, limit=6).select("note_id", "position")
    near = vectors.nearest_to(rows, _query_vector(rows), 8).withColumnRenamed("id", "note_id")
    semantic = hybrid.positions(near, F.round("similarity", 12).desc(), "note_id").select("note_id", "position")
    return hybrid.question_context(keyword, semantic, edges(spark, sf_dir))
