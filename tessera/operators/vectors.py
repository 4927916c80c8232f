"""Exact cosine retrieval by tiles, mutual links and the state of the vector index.

Both sides are cut into tiles by a hash of the id; each tile of the left meets those of the right one after
another by matrix products of bounded size and keeps the best k of each row. This is exact
and therefore quadratic in its inputs; nothing is collected or broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

TILE = 4096
BLOCK = 512  # rows of a matrix product
RESULT = "left_id bigint, right_id bigint, similarity double"


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(id, v): one row per id with exactly dims finite entries that are not all zero."""
    return usable_rows(df, id_col, vector_col, dims).groupBy("id").agg(F.min("v").alias("v"))


def usable_rows(df: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(id, v): the rows of usable_vectors, repeats included: for nearest_of_all, whose tiles see to them."""
    v = F.col(vector_col)
    ok = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(ok, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), v.cast("array<float>").alias("v"))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two arrays in double precision, inside the JVM."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot(left, right) / (F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)))


def nearest_to(vectors: DataFrame, query: list[float], limit: int) -> DataFrame:
    """(id, similarity): the rows nearest to one vector."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select("id", cosine(F.col("v"), q).alias("similarity")).orderBy(F.round("similarity", 12).desc(), "id").limit(limit)


def _packed(rows: DataFrame, groups: DataFrame | None, tile: int, least_tiles: int, side: str) -> DataFrame:
    """(side_at, side_ids, side_v, side_starts, side_groups): a row for each tile of rows(id, v) as arrays; ids in order.

    groups(id, group) come to the tiles by themselves, so that vectors are shuffled once. Where an id has several vectors, the lowest counts.
    """
    n = rows.count()
    n = max(1, math.ceil(n / tile), min(least_tiles, math.ceil(n / BLOCK)))
    vectors = rows.select(F.col("id").cast("bigint").alias("id"), "v", F.lit(None).cast("bigint").alias("group"))
    if groups is not None:
        vectors = vectors.unionByName(groups.select(F.col("id").cast("bigint").alias("id"), F.lit(None).cast("array<float>").alias("v"), "group"))

    def pack(part: pa.Table) -> pa.Table:
        held = part.filter(pa.compute.is_valid(part.column("v")))
        ids = held.column("id").to_numpy()
        v = np.concatenate([c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in held.column("v").chunks if len(c)] or [np.zeros((0, 0))]).astype(np.float32)
        order = np.argsort(ids, kind="stable")
        several = np.flatnonzero(np.diff(ids[order]) == 0)
        if len(several):
            order = np.array(sorted(range(len(ids)), key=lambda k: (ids[k], tuple(v[k]))), np.int64)
        order = order[np.unique(ids[order], return_index=True)[1]]
        ids, v = ids[order], v[order]
        given = part.filter(pa.compute.is_valid(part.column("group")))
        at = np.searchsorted(ids, given.column("id").to_numpy())
        known = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == given.column("id").to_numpy()) if len(ids) else np.zeros(len(at), bool)
        pairs = np.unique(np.stack([at[known], given.column("group").to_numpy()[known]], axis=1), axis=0) if known.any() else np.zeros((0, 2), np.int64)
        row = {"ids": ids, "v": v, "owner": pairs[:, 0].astype(np.int32), "groups": np.ascontiguousarray(pairs[:, 1].astype(np.int64))}
        return pa.table({f"{side}_{k}": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for k, x in row.items()})

    # Right tiles are read again by each left task: a few of them to a partition.
    placed = vectors.withColumn("at", F.pmod(F.xxhash64("id"), F.lit(n))).repartition(2 * n if side == "l" else math.ceil(n / 4), "at").groupBy("at")
    return cut_lineage(placed.applyInArrow(pack, ", ".join(f"{side}_{k} binary" for k in ("ids", "v", "owner", "groups"))))


def _units(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, unit vectors in double precision, and the groups with the rows that have them."""
    ids, owner, groups = np.frombuffer(row[f"{side}_ids"], np.int64), np.frombuffer(row[f"{side}_owner"], np.int32), np.frombuffer(row[f"{side}_groups"], np.int64)
    m = np.frombuffer(row[f"{side}_v"], np.float32).reshape(len(ids), -1).astype(np.float64) if len(ids) else np.zeros((0, 1))
    return ids, m / np.linalg.norm(m, axis=1, keepdims=True), owner, groups


def _best(left: tuple, right: tuple, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in left, ids and similarities of the k nearest in right of each row of left, best first; ties go to the lower id."""
    order = np.argsort(right[3], kind="stable")
    owners, groups = right[2][order], right[3][order]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a in range(0, len(left[0]), BLOCK):
        b = min(len(left[0]), a + BLOCK)
        sims = np.round(left[1][a:b] @ right[1].T, 12)
        at = np.searchsorted(right[0], left[0][a:b])
        own = np.flatnonzero((at < len(right[0])) & (right[0][np.minimum(at, len(right[0]) - 1)] == left[0][a:b]))
        sims[own, at[own]] = -np.inf
        mine = (left[2] >= a) & (left[2] < b)
        low, high = (np.searchsorted(groups, left[3][mine], side=s) for s in ("left", "right"))
        n = high - low
        sims[np.repeat(left[2][mine] - a, n), owners[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]] = -np.inf
        sims[sims <= least] = -np.inf
        if sims.shape[1] > k:
            floor = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
            rows, cols = np.nonzero((sims >= floor) & (sims > -np.inf))
        else:
            rows, cols = np.nonzero(sims > -np.inf)
        out.append((rows + a, right[0][cols], sims[rows, cols]))
    return _first(*(np.concatenate(x) for x in zip(*out, strict=True)), k)


def _first(rows: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest of each row, best first; ties go to the lower id."""
    order = np.lexsort((ids, -sims, rows))
    rows, ids, sims = rows[order], ids[order], sims[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], ids[kept], sims[kept]


def nearest_of_all(left: DataFrame, right: DataFrame, k: int, least: float = -2.0, tile: int = TILE, groups: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id, similarity, position): for each left row the k nearest other right rows above `least`.

    Both have (id, v); rows that share a group of groups(id, group) are no pair. Every left tile meets the right
    tiles one after another where it stands, and only its best are shuffled; vectors are shuffled once, to be packed.
    """
    cores = left.sparkSession.sparkContext.defaultParallelism
    mine, others = _packed(left, groups, tile, 2 * cores, "l"), _packed(right, groups, tile, 1, "r")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, best = None, None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array(part[0][best[0]]), pa.array(best[1]), pa.array(best[2])], names=["left_id", "right_id", "similarity"])
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["l_ids"] != key:
                    if key is not None:
                        yield done()
                    key, part, best = row["l_ids"], _units(row, "l"), None
                if part[1].size and row["r_ids"]:
                    found = _best(part, _units(row, "r"), k, least)
                    best = found if best is None else _first(*(np.concatenate(x) for x in zip(best, found, strict=True)), k)
                else:
                    best = best or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if key is not None:
            yield done()

    # One left partition after another meets all right ones: joined again, its tiles keep their best in one task.
    pairs = mine.crossJoin(others).coalesce(mine.rdd.getNumPartitions())
    found = pairs.mapInArrow(meet, RESULT)
    order = Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def mutual_links(vectors: DataFrame, sources: DataFrame, k: int = 8, tile: int = TILE) -> DataFrame:
    """(source_note_id, target_note_id, similarity): pairs of which each is among the other's k nearest from other sources.

    vectors(id, v), sources(note_id, source_id). Only similarities above 0 count; a note without a
    source never shares one.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    groups = sources.where("note_id is not null and source_id is not null").select(F.col("note_id").alias("id"), F.col("source_id").cast("bigint").alias("group"))
    near = nearest_of_all(vectors, vectors, k, least=0.0, tile=tile, groups=groups)
    pairs = near.select(F.least("left_id", "right_id").alias("source_note_id"), F.greatest("left_id", "right_id").alias("target_note_id"), "similarity")
    return pairs.groupBy("source_note_id", "target_note_id").agg(F.count("*").alias("n"), F.min("similarity").alias("similarity")).where("n = 2").drop("n")


def unembedded(notes: DataFrame, vectors: DataFrame, limit: int | None = None) -> DataFrame:
    """Ids of notes without a vector, in order."""
    ids = notes.select("note_id").where("note_id is not null").distinct()
    out = ids.join(vectors.select(F.col("id").alias("note_id")), "note_id", "left_anti").orderBy("note_id")
    return out.limit(limit) if limit else out


def index_status(notes: DataFrame, vectors: DataFrame, compatible: bool = True) -> DataFrame:
    """(total, embedded, remaining, complete) of the vector index."""
    ids = notes.select("note_id").where("note_id is not null").distinct()
    marked = ids.join(vectors.select(F.col("id").alias("note_id"), F.lit(1).alias("has")), "note_id", "left")
    counts = marked.agg(F.count("*").alias("total"), F.count("has").alias("embedded"))
    left = F.greatest(F.lit(0).cast("bigint"), F.col("total") - F.col("embedded"))
    return counts.select("total", "embedded", left.alias("remaining"), (F.lit(compatible) & (left == 0)).alias("complete"))
