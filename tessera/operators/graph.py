"""The page graph: titles resolved to pages, explicit and semantic edges, neighbourhoods and presentation.

Edges are undirected, (source, target) with the smaller id first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def title_index(notes: DataFrame) -> DataFrame:
    """(key, id): lower-cased titles that exactly one page has."""
    keyed = notes.where("title is not null").select(F.lower("title").alias("key"), F.col("note_id").alias("id"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


def resolved_links(notes: DataFrame) -> DataFrame:
    """(note_id, id): links whose title one other page has; ambiguous, missing and own titles are dropped."""
    links = notes.select("note_id", F.explode("links").alias("title")).where("title is not null").select("note_id", F.lower("title").alias("key"))
    return links.join(title_index(notes), "key").where("id <> note_id").select("note_id", "id")


def _undirected(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("source"), F.greatest(a, b).alias("target")


def explicit_edges(notes: DataFrame) -> DataFrame:
    """(source, target, relationships): one edge for links in either direction, with both pages' relationship types."""
    edges = resolved_links(notes).select(*_undirected("note_id", "id")).distinct()
    related = notes.select("note_id", F.explode("relationships").alias("r")).select("note_id", F.lower("r.target").alias("key"), F.col("r.type").alias("type"))
    typed = related.join(title_index(notes), "key").where("id <> note_id").select(*_undirected("note_id", "id"), "type")
    types = typed.groupBy("source", "target").agg(F.array_join(F.array_sort(F.collect_list("type")), ",").alias("relationships"))
    return edges.join(types, ["source", "target"], "left").withColumn("relationships", F.coalesce("relationships", F.lit("")))


def semantic_edges(links: DataFrame) -> DataFrame:
    """(source, target, similarity) from stored suggestions: reversed and repeated pairs are one edge, its lowest similarity counts."""
    known = links.where("similarity is not null and source_note_id <> target_note_id")
    return known.select(*_undirected("source_note_id", "target_note_id"), "similarity").groupBy("source", "target").agg(F.min("similarity").alias("similarity"))


def graph_edges(notes: DataFrame, links: DataFrame) -> DataFrame:
    """(source, target, kind, similarity, relationships): explicit edges, and semantic ones between pages that have none."""
    explicit = explicit_edges(notes)
    pages = notes.select(F.col("note_id").alias("page")).distinct()
    found = semantic_edges(links).join(explicit.select("source", "target"), ["source", "target"], "left_anti")
    found = found.join(pages, F.col("source") == F.col("page"), "left_semi").join(pages, F.col("target") == F.col("page"), "left_semi")
    none = F.lit(None).cast("double").alias("similarity")
    return explicit.select("source", "target", F.lit("explicit").alias("kind"), none, "relationships").unionByName(
        found.select("source", "target", F.lit("semantic").alias("kind"), "similarity", F.lit("").alias("relationships"))
    )


def incident(edges: DataFrame) -> DataFrame:
    """edges from both ends: node and other besides the edge's columns."""
    return edges.withColumn("_e", F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("other")), F.struct(F.col("target").alias("node"), F.col("source").alias("other"))))).select("_e.*", *edges.columns)


def related(edges: DataFrame, titles: DataFrame, node: Column | None = None) -> DataFrame:
    """(node, other, title, kind, similarity, position): the neighbours of each node, explicit first, then by similarity and title."""
    rows = incident(edges) if node is None else incident(edges).where(F.col("node") == node)
    order = Window.partitionBy("node").orderBy(F.when(F.col("kind") == "explicit", 0).otherwise(1), F.desc_nulls_last("similarity"), "title", "other")
    named = rows.join(titles.select(F.col("note_id").alias("other"), "title"), "other")
    return named.select("node", "other", "title", "kind", "similarity").withColumn("position", F.row_number().over(order))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, reviewed, semantic_only): distinct explicit neighbours, and those that are semantic alone."""
    per = incident(edges).groupBy("node", "other").agg(F.max(F.when(F.col("kind") == "explicit", 1).otherwise(0)).alias("e"))
    return per.groupBy("node").agg(F.sum("e").alias("reviewed"), F.sum(1 - F.col("e")).alias("semantic_only"))


def context_subgraph(edges: DataFrame, matches: DataFrame) -> DataFrame:
    """Edges among matched nodes and their direct neighbours. matches(node)."""
    keep = incident(edges).join(matches.select("node"), "node", "left_semi").select(F.col("other").alias("node")).unionByName(matches.select("node")).distinct()
    inner = edges.join(keep.select(F.col("node").alias("source")), "source", "left_semi")
    return inner.join(keep.select(F.col("node").alias("target")), "target", "left_semi").select(*edges.columns)


def neighbour_kinds(edges: DataFrame) -> DataFrame:
    """(node, other, kinds): the kinds of edge between two nodes, sorted."""
    return incident(edges).groupBy("node", "other").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def top_incident(edges: DataFrame, breadth: int) -> DataFrame:
    """Semantic edges that one of their ends has among its `breadth` most similar; explicit edges all stay."""
    if breadth < 0:
        raise ValueError("breadth must not be negative")
    order = Window.partitionBy("node").orderBy(F.desc("similarity"), "source", "target")
    kept = incident(edges.where("kind = 'semantic' and source <> target")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= breadth)
    return kept.select(*edges.columns).distinct().unionByName(edges.where("kind = 'explicit'"))


def presentation(degree: DataFrame) -> DataFrame:
    """(node, radius, halo, opacity): drawing sizes from the degree."""
    radius = F.least(F.lit(15.0), 6 + 2 * F.sqrt(F.col("reviewed").cast("double")))
    some = F.col("semantic_only") > 0
    opacity = F.when(some, F.least(F.lit(0.22), 0.08 + 0.03 * F.sqrt(F.col("semantic_only").cast("double")))).otherwise(0.0)
    return degree.select("node", radius.alias("radius"), F.when(some, radius + 3).otherwise(radius).alias("halo"), opacity.alias("opacity"))


def similarity_range(edges: DataFrame) -> DataFrame:
    """(low, high): the range of valid similarities, (0, 1) if there is none."""
    valid = edges.where("kind = 'semantic' and similarity between -1 and 1")
    return valid.agg(F.coalesce(F.min("similarity"), F.lit(0.0)).alias("low"), F.coalesce(F.max("similarity"), F.lit(1.0)).alias("high"))


def layout(edges: DataFrame) -> DataFrame:
    """(source, target, kind, strength, distance): fixed for explicit edges, by similarity within the range for semantic ones."""
    low, high = similarity_range(edges).first()
    width = high - low
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("similarity") - low) / width)) if width > 2.2e-16 else F.lit(0.5)
    explicit = F.col("kind") == "explicit"
    return edges.select(
        "source", "target", "kind", F.when(explicit, 0.08).otherwise(0.22 + 0.58 * share).alias("strength"), F.when(explicit, 105.0).otherwise(130 - 80 * share).alias("distance")
    )


def fitted(nodes: DataFrame, width: float, height: float, most: float = 4.0) -> DataFrame:
    """(points, min_x, max_x, min_y, max_y, scale): the box of nodes(x, y) and the scale at which it fits a frame; an axis without extent counts as 1."""
    box = nodes.agg(F.count("*").alias("points"), *(f(c).cast("double").alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))))
    span = lambda a: F.greatest(F.lit(1.0), F.col(f"max_{a}") - F.col(f"min_{a}"))
    return box.withColumn("scale", F.least(F.lit(float(width)) / span("x"), F.lit(float(height)) / span("y"), F.lit(float(most))))


#: The multiplier, increment and usual seed of the layout's generator.
MULTIPLIER, INCREMENT, SEED = 1_664_525, 1_013_904_223, 0x517A2F19


def seeded_draws(count: int, seed: int = SEED) -> list[float]:
    """Numbers of a 32-bit linear congruential generator in [0, 1): the same for a seed everywhere."""
    out, state = [], seed & 0xFFFFFFFF
    for _ in range(count):
        state = (MULTIPLIER * state + INCREMENT) & 0xFFFFFFFF
        out.append(state / 2**32)
    return out
