"""Keyword retrieval: terms, postings, BM25 ranking, the AND-then-OR search and integration candidates."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import cut_lineage, spread

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6

TILE = 16_384  # documents, or seeds, that are compared at a time
GROUP = 64  # documents of which the best score is looked at first


def parse_query(query: str) -> list[str]:
    """The terms of a search: NFKC, lower case, distinct, the first 16, without stop words unless all are."""
    found = list(dict.fromkeys(re.findall(r"[^\W]+", unicodedata.normalize("NFKC", query).lower())))[: T.MAX_TERMS]
    return [t for t in found if t not in T.SEARCH_STOP_WORDS] or found


def _index_form(term: str) -> list[str]:
    """A query term as the index would cut it: several parts are a phrase."""
    fold = str.maketrans(T.ACCENTED, T.BASE)
    return [p for p in re.split(r"_+", term.lower().translate(fold)) if p]


def document_terms(docs: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """(id, terms, dl) with the terms of all columns; null texts have none."""
    joined = F.concat(*(F.coalesce(T.index_terms(F.col(c)), F.array().cast("array<string>")) for c in text_cols))
    return docs.select(F.col(id_col), joined.alias("terms")).withColumn("dl", F.size("terms").cast("bigint"))


def postings(docs: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """(id, term, tf): how often each term occurs in each document."""
    return document_terms(docs, id_col, *text_cols).select(id_col, F.explode("terms").alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.lit(IDF_FLOOR), F.log((n_docs - df + 0.5) / (df + 0.5)))


def term_score(idf_value: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return idf_value * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _tf(terms: Column, parts: list[str]) -> Column:
    if len(parts) == 1:
        return F.size(F.filter(terms, lambda t: t == parts[0]))
    # A phrase: count the places where its parts stand side by side.
    places = F.sequence(F.lit(1), F.greatest(F.size(terms) - len(parts) + 1, F.lit(1)))
    hit = lambda i: F.array_compact(F.array(*(F.when(F.get(terms, i - 1 + k) == p, 1) for k, p in enumerate(parts))))
    return F.size(F.filter(places, lambda i: F.size(hit(i)) == len(parts)))


def keyword_search(docs: DataFrame, query: str, id_col: str = "note_id", title_col: str = "title", body_col: str = "body", limit: int = 20) -> DataFrame:
    """(id, title, rank): documents with all terms; if there is none, those with any. rank is negative, smaller is better.

    One pass counts document frequencies of the query's terms (at most 16 numbers and two sums reach
    the driver), one pass scores; nothing but the best rows is shuffled. No terms, no rows.
    """
    parts = [p for p in map(_index_form, parse_query(query)) if p]
    counted = docs.select(
        F.col(id_col), F.col(title_col),
        F.concat(*(F.coalesce(T.index_terms(F.col(c)), F.array().cast("array<string>")) for c in (title_col, body_col))).alias("terms"),
    )
    tfs = [f"tf{k}" for k in range(len(parts))]
    counted = counted.select(id_col, title_col, F.size("terms").alias("dl"), *(_tf(F.col("terms"), p).alias(n) for n, p in zip(tfs, parts, strict=True)))
    counted = cut_lineage(counted)  # a few numbers for each document: the text is cut into terms once
    matched = sum((F.when(F.col(n) > 0, 1).otherwise(0) for n in tfs), F.lit(0))
    stats = counted.agg(F.count("*").alias("n"), F.sum("dl").alias("dl"), F.coalesce(F.max(matched), F.lit(0)).alias("best"), *(F.count_if(F.col(n) > 0).alias(n) for n in tfs)).first()
    if not parts or not stats["n"]:
        return docs.select(F.col(id_col), F.col(title_col), F.lit(0.0).alias("rank")).limit(0)
    need = len(parts) if stats["best"] == len(parts) else 1
    avgdl = F.lit((stats["dl"] or 0) / stats["n"])
    score = sum((F.when(F.col(n) > 0, term_score(idf(F.lit(stats["n"]), F.lit(stats[n])), F.col(n), F.col("dl"), avgdl)).otherwise(0.0) for n in tfs), F.lit(0.0))
    return counted.where(matched >= need).select(id_col, title_col, (-score).alias("rank")).orderBy(F.round("rank", 10), id_col).limit(limit)


def title_boost(title: Column, query: str) -> Column:
    """1 for the same text, 0.25 for a prefix, 0.1 for a part, else 0 (normalised texts)."""
    wanted = " ".join(unicodedata.normalize("NFKC", query).lower().split())
    key = F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))
    if not wanted:
        return F.lit(0.0)
    return F.coalesce(F.when(key == wanted, 1.0).when(F.startswith(key, F.lit(wanted)), 0.25).when(F.contains(key, F.lit(wanted)), 0.1).otherwise(0.0), F.lit(0.0))


def _packed(docs: DataFrame, id_col: str, columns: tuple[str, str], words) -> DataFrame:
    """(n, dl, ids, lengths, starts, at, tf): a row for each tile of documents, with the postings of the broadcast sorted hashes `words` as arrays.

    The text is cut where it is read; a document is shuffled as its numbers alone, so that repeats of an id meet and count once.
    """
    spark = docs.sparkSession
    tiles = max(1, math.ceil(docs.count() / TILE))
    hashed = F.transform(F.concat(*(F.coalesce(T.index_terms(F.col(c)), F.array().cast("array<string>")) for c in columns)), lambda t: F.xxhash64(t))
    cut = spread(docs, id_col).select(F.col(id_col).cast("bigint").alias("id"), hashed.alias("h"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = words.value
        for batch in batches:
            terms = batch.column(1)
            lengths = np.diff(terms.offsets.to_numpy())
            flat = terms.flatten().to_numpy()
            at = np.minimum(np.searchsorted(vocabulary, flat), max(len(vocabulary) - 1, 0))
            known = vocabulary[at] == flat if len(vocabulary) else np.zeros(len(flat), bool)
            keys, tf = np.unique(np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)[known] << 32 | at[known], return_counts=True)
            starts = np.searchsorted(keys, np.arange(len(lengths) + 1, dtype=np.int64) << 32)
            blob = lambda values: pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((starts * 4).astype(np.int32)), pa.py_buffer(values.astype(np.int32))])  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths.astype(np.int64)), blob(keys & 0xFFFFFFFF), blob(tf)], names=["id", "dl", "at", "tf"])

    def pack(part: pa.Table) -> pa.Table:
        ids, first = np.unique(part.column("id").to_numpy(), return_index=True)
        part = part.take(pa.array(first)).combine_chunks()
        lengths = part.column("dl").to_numpy()
        starts = np.cumsum([0, *(pa.compute.binary_length(part.column("at")).to_numpy() // 4)])
        joined = lambda name: b"".join(part.column(name).to_pylist())
        row = {"n": len(ids), "dl": int(lengths.sum()), "ids": ids.tobytes(), "lengths": lengths.tobytes(), "starts": starts.astype(np.int64).tobytes(), "at": joined("at"), "tf": joined("tf")}
        return pa.table({k: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for k, v in row.items()})

    counted = cut.mapInArrow(count, "id bigint, dl bigint, at binary, tf binary").withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)))
    whole = counted.repartition(max(2 * tiles, spark.sparkContext.defaultParallelism), "tile").groupBy("tile")
    return cut_lineage(whole.applyInArrow(pack, "n bigint, dl bigint, ids binary, lengths binary, starts binary, at binary, tf binary"))


def best_of_tile(part: dict, seeds: dict, weights: np.ndarray, avgdl: float, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each seed: its id, and ids and scores of the tile's best documents, by rounded score and id."""
    ids, lengths, starts = (np.frombuffer(part[k], np.int64) for k in ("ids", "lengths", "starts"))
    at, tf = (np.frombuffer(part[k], np.int32) for k in ("at", "tf"))
    docs = np.repeat(np.arange(len(ids)), np.diff(starts))
    scores = weights[at] * tf * (K1 + 1) / (tf + (K1 * (1 - B + B * lengths / avgdl))[docs])
    order = np.argsort(at, kind="stable")
    at, docs, scores = at[order], docs[order], scores[order]
    size = -(-len(ids) // GROUP) * GROUP
    dense: dict[int, np.ndarray] = {}
    seed_ids, seed_starts, terms = np.frombuffer(seeds["ids"], np.int64), np.frombuffer(seeds["starts"], np.int64), np.frombuffer(seeds["at"], np.int32)
    low, high = np.searchsorted(at, terms, "left").tolist(), np.searchsorted(at, terms, "right").tolist()
    for k, seed in enumerate(seed_ids.tolist()):
        total = np.zeros(size)
        for j in range(seed_starts[k], seed_starts[k + 1]):
            a, b = low[j], high[j]
            if 4 * (b - a) > len(ids):  # adding a whole column is cheaper than looking up most of it
                if (column := dense.get(a)) is None:
                    column = dense[a] = np.zeros(size)
                    column[docs[a:b]] = scores[a:b]
                total += column
            elif b > a:
                total[docs[a:b]] += scores[a:b]
        tops = total.reshape(-1, GROUP).max(axis=1)  # the limit-th best group has a score that the limit-th best document reaches
        least = np.partition(tops, len(tops) - limit)[len(tops) - limit] if len(tops) > limit else 0.0
        found = np.flatnonzero((total > 0) & (total >= least - 2e-9))
        found = found[np.lexsort((ids[found], -np.round(total[found], 9)))[:limit]]
        yield np.full(len(found), seed), ids[found], total[found]


def integration_candidates(docs: DataFrame, seeds: DataFrame, id_col: str = "note_id", title_col: str = "title", body_col: str = "body", limit: int = 8) -> DataFrame:
    """(seed_id, id, score, position): for each seed (seed_id, text) the documents that share its first 16 terms, by BM25.

    Repeats of an id are exact and count once. Tiles of documents meet tiles of seeds without a shuffle, and only
    the best of each meeting are shuffled. The driver sees the distinct hashes of the seeds' terms and their frequencies.
    """
    spark = docs.sparkSession
    terms = F.transform(T.integration_terms(F.col("text")), lambda t: F.xxhash64(T.folded(t)))
    wanted = cut_lineage(seeds.select(F.col("seed_id").cast("bigint").alias("seed_id"), F.explode(F.array_distinct(terms)).alias("h")).distinct())
    vocabulary = np.sort(wanted.select("h").distinct().toArrow().column("h").to_numpy())
    words = spark.sparkContext.broadcast(vocabulary)
    tiles = _packed(docs, id_col, (title_col, body_col), words)
    whole = tiles.agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).first()
    result = f"seed_id bigint, {id_col} bigint, score double"
    if not whole["n"] or not whole["dl"] or not len(vocabulary):
        return spark.createDataFrame([], f"{result}, position int")
    n, avgdl = whole["n"], whole["dl"] / whole["n"]

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                term, df = np.unique(np.frombuffer(at, np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df)], names=["term", "df"])

    counts = tiles.select("at").mapInArrow(frequencies, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[counts.column("term").to_numpy()] = counts.column("df").to_numpy()
    weights = spark.sparkContext.broadcast(np.maximum(IDF_FLOOR, np.log((n - df + 0.5) / (df + 0.5))))

    def pack(part: pa.Table) -> pa.Table:
        order = np.lexsort((part.column("h").to_numpy(), part.column("seed_id").to_numpy()))
        ids, starts = np.unique(part.column("seed_id").to_numpy()[order], return_index=True)
        row = {"seed_ids": ids.tobytes(), "seed_starts": np.append(starts, len(order)).astype(np.int64).tobytes(), "seed_at": np.searchsorted(words.value, part.column("h").to_numpy()[order]).astype(np.int32).tobytes()}
        return pa.table({k: pa.array([v], pa.binary()) for k, v in row.items()})

    parts = max(1, math.ceil(wanted.count() / (T.MAX_TERMS * TILE)))
    asked = cut_lineage(wanted.groupBy(F.pmod(F.xxhash64("seed_id"), F.lit(parts)).alias("tile")).applyInArrow(pack, "seed_ids binary, seed_starts binary, seed_at binary"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                of = {"ids": row["seed_ids"], "starts": row["seed_starts"], "at": row["seed_at"]}
                found = list(zip(*best_of_tile(row, of, weights.value, avgdl, limit), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=["seed_id", id_col, "score"])

    scored = tiles.select("ids", "lengths", "starts", "at", "tf").crossJoin(asked).mapInArrow(score, result)
    order = Window.partitionBy("seed_id").orderBy(F.round("score", 9).desc(), id_col)
    return scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
