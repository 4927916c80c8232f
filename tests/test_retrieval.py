"""Search, vectors, fusion and graph on small fixtures with known answers."""

import math

import numpy

from tessera.operators import graph, hybrid, lexical, vectors

NOTES = [
    (1, "Cross-Functional Team Composition", "A team brings together clinical and operational perspectives."),
    (2, "Quality Improvement Definition", "Quality improvement is a structured approach to systems change."),
    (3, "SBARR Communication Framework", "Standardised communication supports safe handovers."),
]


def notes(spark, rows=NOTES):
    return spark.createDataFrame(rows, "note_id bigint, title string, body string")


def ids(df):
    return {r["note_id"] for r in df.collect()}


def test_keyword_search_needs_all_terms_then_any(spark):
    n = notes(spark)
    assert ids(lexical.keyword_search(n, "cross-functional team")) == {1}
    assert ids(lexical.keyword_search(n, "What is quality improvement?")) == {2}
    assert ids(lexical.keyword_search(n, "structured communication")) == {2, 3}
    assert ids(lexical.keyword_search(n, "?!")) == set()


def test_query_parsing():
    assert lexical.parse_query("AND OR NOT ?") == ["not"]
    assert lexical.parse_query("the of and") == ["the", "of", "and"]
    assert lexical.parse_query("?!") == []
    assert len(lexical.parse_query(" ".join(f"w{i}" for i in range(40)))) == 16


def test_search_handles_nulls_empty_table_and_extra_columns(spark):
    rows = [(1, None, "alpha beta", "x"), (2, "alpha", None, "y"), (3, "", "", "z")]
    n = spark.createDataFrame(rows, "note_id bigint, title string, body string, terms string")
    assert ids(lexical.keyword_search(n, "alpha")) == {1, 2}
    assert lexical.keyword_search(n.limit(0), "alpha").count() == 0


def test_phrase_of_an_underscore_term(spark):
    n = notes(spark, [(1, "one two", "x"), (2, "two one", "y")])
    assert ids(lexical.keyword_search(n, "one_two")) == {1}


def test_bm25_matches_a_direct_computation(spark):
    n = notes(spark)
    got = {r["note_id"]: r["rank"] for r in lexical.keyword_search(n, "structured communication").collect()}
    docs = {i: (t + " " + b).lower().replace("-", " ").replace(".", "").split() for i, t, b in NOTES}
    avg = sum(map(len, docs.values())) / 3
    for i, words in docs.items():
        score = 0.0
        for term in ("structured", "communication"):
            df = sum(term in w for w in docs.values())
            idf = max(1e-6, math.log((3 - df + 0.5) / (df + 0.5)))
            tf = words.count(term)
            score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg)) if tf else 0
        assert score == 0 or abs(got[i] + score) < 1e-9


def test_integration_candidates(spark):
    n = notes(spark, [(1, "Café programming", "Naïve loops and types"), (2, "Gardens", "Plants and soil"), (3, "Empty", "")])
    asked = spark.createDataFrame([(10, "CAFÉ naïve"), (11, "the AND or (a) * + -")], "seed_id bigint, text string")
    assert {(r["seed_id"], r["note_id"]) for r in lexical.integration_candidates(n, asked).collect()} == {(10, 1)}


def unit(*head):
    return [float(x) for x in head] + [0.0] * (8 - len(head))


VECTORS = [(1, unit(1)), (2, unit(0.9, 0.4358899)), (3, unit(0.8, 0.6)), (4, unit(0, 1))]
SOURCES = [(1, 1), (2, 1), (3, 2), (4, 3)]


def test_integration_candidates_of_tiles_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TILE", 16)
    words = [f"word{i}" for i in range(12)]
    docs = [(i, None if i % 9 == 0 else f"{words[i % 12]} {words[i % 7]}", " ".join(words[j] for j in range(12) if i * (j + 3) % 5 < 2)) for i in range(90)]
    asked = [(7, "word0 word3 word11 word0"), (8, "word1 unknown"), (9, "")]
    schema = "note_id bigint, title string, body string"
    # A row that stands twice counts once, in whatever tile.
    got = lexical.integration_candidates(spark.createDataFrame(docs + docs[::3], schema), spark.createDataFrame(asked, "seed_id bigint, text string"), limit=5).collect()
    cut = {i: f"{t or ''} {b}".split() for i, t, b in docs}
    avgdl = sum(map(len, cut.values())) / len(cut)
    want = set()
    for seed, text in asked:
        scores = {}
        for term in set(text.split()):
            df = sum(term in x for x in cut.values())
            for i, x in cut.items():
                if tf := x.count(term):
                    scores[i] = scores.get(i, 0) + max(1e-6, math.log((len(cut) - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / avgdl))
        best = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:5]
        want |= {(seed, i, round(scores[i], 6), at) for at, i in enumerate(best, 1)}
    assert {(r["seed_id"], r["note_id"], round(r["score"], 6), r["position"]) for r in got} == want and len(got) == len(want) == 10


def test_mutual_links_leave_out_pages_of_one_source(spark):
    v = vectors.usable_vectors(spark.createDataFrame(VECTORS, "note_id bigint, vector array<float>"), "note_id", "vector", 8)
    s = spark.createDataFrame(SOURCES, "note_id bigint, source_id bigint")
    links = vectors.mutual_links(v, s, k=1).collect()
    assert [(r[0], r[1]) for r in links] == [(2, 3)]


def test_links_need_positive_similarity(spark):
    rows = [(i, unit(1)) for i in range(20)] + [(99, unit(0, 1))]
    v = vectors.usable_vectors(spark.createDataFrame(rows, "note_id bigint, vector array<float>"), "note_id", "vector", 8)
    s = spark.createDataFrame([(i, 1) for i in range(20)] + [(99, 2)], "note_id bigint, source_id bigint")
    assert vectors.mutual_links(v, s, k=1).count() == 0


def test_tiles_give_the_same_as_brute_force_with_ties(spark):
    rows = [(i, unit(1 + i % 3, i % 5, i % 2)) for i in range(60)]
    v = vectors.usable_vectors(spark.createDataFrame(rows, "note_id bigint, vector array<float>"), "note_id", "vector", 8)
    got = {(r["left_id"], r["right_id"]) for r in vectors.nearest_of_all(v, v, 4, tile=16).collect()}
    norm = {i: [x / math.sqrt(sum(y * y for y in a)) for x in a] for i, a in rows}
    want = set()
    for i, a in norm.items():
        sims = sorted(((-round(sum(x * y for x, y in zip(a, b, strict=True)), 12), j) for j, b in norm.items() if j != i))
        want |= {(i, j) for _, j in sims[:4]}
    assert got == want


def test_unusable_vectors_and_index_status(spark):
    rows = [(1, unit(1)), (2, None), (3, [1.0]), (4, [float("nan")] * 8), (5, [0.0] * 8), (1, unit(1))]
    v = vectors.usable_vectors(spark.createDataFrame(rows, "note_id bigint, vector array<float>"), "note_id", "vector", 8)
    assert [r["id"] for r in v.collect()] == [1]
    n = spark.createDataFrame([(1,), (2,), (None,)], "note_id bigint")
    assert vectors.index_status(n, v).first().asDict() == {"total": 2, "embedded": 1, "remaining": 1, "complete": False}
    assert [r[0] for r in vectors.unembedded(n, v).collect()] == [2]


def test_fusion_puts_the_literal_title_first(spark):
    n = notes(spark, [(1, "Plane Limitations", "wings"), (2, "Agent Flow Beta Status", "plane limitations noted")])
    keyword = spark.createDataFrame([(1, 1), (2, 2)], "note_id bigint, position int")
    semantic = spark.createDataFrame([(2, 1), (1, 2)], "note_id bigint, position int")
    first = hybrid.fuse(keyword, semantic, n, "Plane limitations").first()
    assert (first["note_id"], first["match_type"]) == (1, "both")
    only = hybrid.fuse(keyword.where("note_id = 1"), semantic.limit(0), n, "Plane limitations").collect()
    assert [(r["note_id"], r["match_type"]) for r in only] == [(1, "keyword")]


PAGES = "note_id bigint, title string, links array<string>, relationships array<struct<target:string,type:string>>"


def test_explicit_edges_hide_semantic_ones(spark):
    n = spark.createDataFrame([(1, "First", ["Second", "Missing", None], None), (2, "Second", [], None), (3, "Third", None, None)], PAGES)
    stored = spark.createDataFrame([(1, 2, 0.98), (3, 2, 0.83), (2, 3, 0.9), (1, 3, None)], "source_note_id bigint, target_note_id bigint, similarity double")
    edges = graph.graph_edges(n, stored)
    assert {(r["source"], r["target"], r["kind"], r["similarity"]) for r in edges.collect()} == {(1, 2, "explicit", None), (2, 3, "semantic", 0.83)}
    near = graph.related(edges, n).where("node = 2").orderBy("position").collect()
    assert [(r["title"], r["kind"]) for r in near] == [("First", "explicit"), ("Third", "semantic")]
    assert {tuple(r) for r in graph.degrees(edges).collect()} == {(1, 1, 0), (2, 1, 1), (3, 0, 1)}


def test_ambiguous_titles_do_not_resolve(spark):
    n = spark.createDataFrame([(1, "Same", ["same"], None), (2, "SAME", None, None), (3, "Other", ["Same", "other"], None)], PAGES)
    assert graph.explicit_edges(n).count() == 0


def test_breadth_keeps_an_edge_that_either_end_selects(spark):
    edges = spark.createDataFrame([(1, 2, "semantic", 0.9), (1, 3, "semantic", 0.8), (2, 3, "semantic", 0.1), (1, 4, "explicit", None)], "source bigint, target bigint, kind string, similarity double")
    kept = {(r["source"], r["target"]) for r in graph.top_incident(edges, 1).collect()}
    assert kept == {(1, 2), (1, 3), (1, 4)}


def test_question_context_is_seed_then_neighbour(spark):
    seeds = spark.createDataFrame([(1, 1)], "note_id bigint, position int")
    edges = spark.createDataFrame([(1, 2, "explicit"), (1, 3, "semantic")], "source bigint, target bigint, kind string")
    got = hybrid.question_context(seeds, seeds.limit(0), edges).orderBy("position").collect()
    assert [r["note_id"] for r in got] == [1, 2]


def test_seeded_draws_are_stable():
    assert graph.seeded_draws(3) == graph.seeded_draws(3)
    assert all(0 <= x < 1 for x in graph.seeded_draws(100, 5))


def test_mutual_links_of_tiles_and_repeated_rows(spark):
    rows = [(i, [float((i * (j + 3)) % 11 - 5) + 0.1 for j in range(4)]) for i in range(70)]
    held = [(i, i % 9) for i in range(0, 70, 2)] + [(i, 100) for i in range(0, 70, 5)] + [(500, 1), (None, 1), (3, None)]
    v = spark.createDataFrame(rows + rows[::3] + [(7, [9.0, 9.0, 9.0, 9.0])], "id bigint, v array<float>")
    got = vectors.mutual_links(v, spark.createDataFrame(held, "note_id bigint, source_id bigint"), k=3, tile=16).collect()
    unit = {i: [float(numpy.float32(a)) for a in x] for i, x in rows}
    cosine = lambda x, y: round(sum(a * b for a, b in zip(x, y)) / math.hypot(*x) / math.hypot(*y), 12)
    of = {i: {s for n, s in held if n == i and s is not None} for i in unit}
    near = {i: [j for _, j in sorted((-cosine(unit[i], unit[j]), j) for j in unit if j != i and not of[i] & of[j] and cosine(unit[i], unit[j]) > 0)[:3]] for i in unit}
    want = {(i, j) for i in near for j in near[i] if i < j and i in near[j]}
    assert {(r["source_note_id"], r["target_note_id"]) for r in got} == want and len(got) == len(want) > 5
