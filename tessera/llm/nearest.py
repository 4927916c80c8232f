"""The most similar vectors of every vector along shifted space-filling curves.

Each curve first puts the unit vectors into cells: the axis, with its sign, that is nearest in a random
rotation of the whole space, so that all directions count. Within a cell it projects them to a few coordinates
(a random rotation within the leading principal directions), quantises these with its own shift and orders
the vectors by their Hilbert index.
Only keys are shuffled for the ordering; each is numbered along its curve, and the curves are cut into
slices of neighbouring rows. A slice also gets the `window` rows before and after it, so every row meets
its whole window wherever the cuts fall. In a slice each block of rows is compared with its window
by one matrix product, the best are reranked in double precision, and the lists of all curves are
merged. Approximate: a neighbour is found if it falls into the window on at least one curve; recall is
measured against brute force in the README.

Exact copies of a vector are folded into one representative with its lowest ids, so that a hot
group neither fills a window nor a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import ranked
from tessera.session import cut_lineage, parallelism

CURVES = 16
WINDOW = 640  # rows on each side of a row's block
BLOCK = 256
COORDINATES = 8
BITS = 6
DIRECTIONS = 24
FIT_ROWS = 20_000  # the bound of the sample that directions and quantiles are fitted on; every row is indexed
SLICE_ROWS = 49_152  # the most rows of a slice, without those of its neighbours
COPIES = 8  # of the table of a representative's ids: a row that is near to very many is joined by so many tasks


def usable(vector: Column, dims: int) -> Column:
    """Exactly `dims` entries, all finite and not null, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The position on the Hilbert curve of each row of cell coordinates (rows, axes), each below 2**bits.

    Works from the top bit down: the octant's Gray code is inverted, and the curve's entry point and
    direction within the octant are carried as a reflection mask and a rotation of the axes.
    """
    rows, axes = cells.shape
    if axes * bits > 63:
        raise ValueError("the index must fit 63 bits")
    entry, turn = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    full, key = (1 << axes) - 1, np.zeros(rows, np.int64)
    rotate_right = lambda x, k: ((x >> k) | (x << (axes - k))) & full
    rotate_left = lambda x, k: ((x << k) | (x >> (axes - k))) & full
    for level in range(bits - 1, -1, -1):
        octant = np.zeros(rows, np.int64)
        for a in range(axes):
            octant |= ((cells[:, a].astype(np.int64) >> level) & 1) << a
        gray = rotate_right(octant ^ entry, (turn + 1) % axes)
        w = gray.copy()
        for k in range(1, axes):
            w ^= gray >> k
        key = (key << axes) | w
        below = np.where(w == 0, 0, (w - 1) & ~np.int64(1))
        entry ^= rotate_left(below ^ (below >> 1), (turn + 1) % axes)
        odd = np.where(w & 1, w, np.maximum(w - 1, 0))
        trailing = np.zeros(rows, np.int64)
        live = w > 0
        for _ in range(axes):
            live = live & ((odd & 1) == 1)
            trailing += live
            odd = odd >> 1
        turn = (turn + np.where(w == 0, 0, trailing) + 1) % axes
    return key


class Curves:
    """The fitted projections: for each curve the rotation that gives the cells, a matrix, the cut points of each coordinate, and a shift."""

    def __init__(self, sample: np.ndarray, curves: int, coordinates: int, bits: int, directions: int, seed: int):
        rng = np.random.default_rng(seed)
        self.bits, self.rotations, self.matrices, self.cuts = bits, [], [], []
        units = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-30)
        self.centre = units.mean(0).astype(np.float32)
        _, spread, axes = np.linalg.svd(units - units.mean(0), full_matrices=False)
        lead = min(directions, len(spread))
        coordinates = min(coordinates, lead)
        for _ in range(curves):
            self.rotations.append(np.linalg.qr(rng.normal(size=(units.shape[1], units.shape[1])))[0].astype(np.float32))
            turn = np.linalg.qr(rng.normal(size=(lead, lead)))[0][:, :coordinates]
            matrix = axes[:lead].T @ turn
            values = units @ matrix
            shift = rng.random(coordinates)
            steps = (np.arange(1, 1 << bits)[:, None] - shift[None, :]) / (1 << bits)
            self.matrices.append(matrix.astype(np.float32))
            self.cuts.append(np.stack([np.quantile(values[:, d], steps[:, d].clip(0, 1)) for d in range(coordinates)]))

    def keys(self, units: np.ndarray, curve: int) -> np.ndarray:
        values = units @ self.matrices[curve]
        cells = np.stack([np.searchsorted(cut, values[:, d]) for d, cut in enumerate(self.cuts[curve])], axis=1)
        turned = (units - self.centre) @ self.rotations[curve]
        axis = np.abs(turned).argmax(axis=1)
        cell = 2 * axis + (turned[np.arange(len(turned)), axis] > 0)
        return (cell << (cells.shape[1] * self.bits)) | hilbert_index(cells, self.bits)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def window_neighbours(vectors: np.ndarray, ids: np.ndarray, k: int, window: int, block: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For the rows first to last in curve order: ids and double-precision cosines of the k best others within the window (-1 where fewer)."""
    n, last = len(vectors), len(vectors) if last is None else last
    exact = vectors.astype(np.float64)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    units = exact.astype(np.float32)
    out_id, out_sim = np.full((last - first, k), -1, np.int64), np.full((last - first, k), -np.inf)
    for a in range(first, last, block):
        b = min(last, a + block)
        lo, hi = max(0, a - window), min(n, b + window)
        sims = units[a:b] @ units[lo:hi].T
        sims[np.arange(b - a), np.arange(a - lo, b - lo)] = -np.inf
        take = min(k + 3, hi - lo - 1)
        if take < 1:
            continue
        near = np.argpartition(-sims, take - 1, axis=1)[:, :take] + lo
        fine = np.einsum("rd,rkd->rk", exact[a:b], exact[near])
        order = np.lexsort((ids[near], -fine), axis=1)[:, :k]
        rows = np.arange(b - a)[:, None]
        out_id[a - first : b - first, : order.shape[1]] = ids[near[rows, order]]
        out_sim[a - first : b - first, : order.shape[1]] = fine[rows, order]
    return out_id, out_sim


def most_similar(
    df: DataFrame, id_col: str = "note_id", vector_col: str = "vector", k: int = 5, dims: int = 128, curves: int = CURVES, window: int = WINDOW, seed: int = 7
) -> DataFrame:
    """(id, neighbour, similarity, rank): the k most similar other vectors of every usable vector, best first.

    A vector is usable if it has `dims` finite entries and is not all zero; other rows take no part.
    Ties go to the lower id. Repeated rows count once; where one id has several vectors, the one
    with the smallest hash counts. Fewer than two usable vectors give no row.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"), dims))
    rows = rows.withColumns({"ha": F.xxhash64("v"), "hb": F.hash("v").cast("bigint")})
    once = cut_lineage(rows.groupBy("id").agg(F.min(F.struct("ha", "hb")).alias("h")).select("id", "h.*"))
    # The lowest k + 1 ids of each vector are all that a tie can ask for; the limit is applied before the shuffle.
    low = Window.partitionBy("ha", "hb").orderBy("id")
    head = once.withColumn("_n", F.row_number().over(low)).where(F.col("_n") <= k + 1)
    folded = cut_lineage(head.groupBy("ha", "hb").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids")))
    owner = folded.select(F.col("rep").alias("id"), "ha", "hb")
    reps = cut_lineage(rows.join(owner, ["id", "ha", "hb"], "left_semi").groupBy(F.col("id").alias("rep")).agg(F.first("v").alias("v")))
    total = reps.count()
    if not total:
        return spark.createDataFrame([], "id bigint, neighbour bigint, similarity double, rank int")
    fit = reps.orderBy(F.xxhash64("rep")).select("v").limit(FIT_ROWS).toArrow().column("v").combine_chunks()
    shared = spark.sparkContext.broadcast(Curves(_matrix(fit).astype(np.float64), curves, COORDINATES, BITS, DIRECTIONS, seed))
    key_schema = pa.schema([("rep", pa.int64()), ("curve", pa.int32()), ("key", pa.int64())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Curves = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(1)).astype(np.float64)
            units = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
            for c in range(curves):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(units), c, np.int32)), pa.array(fitted.keys(units, c))], schema=key_schema)

    # Slices small enough for all cores to have some, but far larger than the rows they share with their neighbours.
    size = max(8 * window, min(SLICE_ROWS, math.ceil(total * curves / parallelism(spark))))
    placed = ranked(reps.select("rep", "v").mapInArrow(index, "rep bigint, curve int, key bigint"), ["curve"], [F.col("key"), F.col("rep")], "at").withColumn("at", F.col("at") - 1)
    own, inside = F.floor(F.col("at") / size), F.col("at") % size
    slices = F.array_compact(F.array(own, F.when((inside < window) & (own > 0), own - 1), F.when(inside >= size - window, own + 1)))
    places = placed.select("rep", "curve", "at", own.alias("own"), F.explode(slices).alias("slice"))
    count = math.ceil(total / size)
    work = places.where(F.col("slice") < count).join(reps, "rep").select((F.col("curve") * count + F.col("slice")).alias("unit"), (F.col("own") == F.col("slice")).alias("inner"), "at", "rep", "v")
    found_schema = pa.schema([("rep", pa.int64()), ("near", pa.list_(pa.int64())), ("sims", pa.list_(pa.float64()))])

    def compare(part: pa.Table) -> pa.Table:
        order = np.argsort(part.column("at").to_numpy())
        ids, inner = part.column("rep").to_numpy()[order], part.column("inner").to_numpy()[order]
        vectors = np.concatenate([_matrix(c) for c in part.column("v").chunks])[order]
        mine = np.flatnonzero(inner)
        near, sims = window_neighbours(vectors, ids, k, window, BLOCK, int(mine[0]), int(mine[-1]) + 1)
        offsets = pa.array(np.arange(len(mine) + 1) * k, pa.int32())
        return pa.Table.from_arrays([pa.array(ids[mine]), pa.ListArray.from_arrays(offsets, pa.array(near.ravel())), pa.ListArray.from_arrays(offsets, pa.array(sims.ravel()))], schema=found_schema)

    units = count * curves
    found = work.repartition(units, "unit").groupBy("unit").applyInArrow(compare, "rep bigint, near array<bigint>, sims array<double>")
    # Merge the curves: at most curves * k entries a representative.
    entries = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip(F.transform("sims", lambda s: -s).alias("far"), F.col("near").alias("near")))))
    merged = found.groupBy("rep").agg(F.slice(F.array_sort(F.filter(entries, lambda e: e["near"] >= 0)), 1, k).alias("best"))
    # Representatives stand for their copies: a neighbour brings its lowest ids, a vector's own copies come first.
    several = folded.where(F.size("ids") > 1).select("rep", "ids")
    copies = several.select(F.col("rep").alias("to"), "ids", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(COPIES - 1).cast("bigint"))).alias("slice"))
    spread = merged.select("rep", F.explode("best").alias("e")).select("rep", F.col("e.near").alias("to"), F.col("e.far").alias("far"), F.pmod(F.xxhash64("rep"), F.lit(COPIES)).alias("slice"))
    others = spread.join(copies, ["to", "slice"], "left").select("rep", F.transform(F.coalesce("ids", F.array("to")), lambda i: F.struct(F.col("far").alias("far"), i.alias("near"))).alias("c"))
    own_copies = several.select("rep", F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("far"), i.alias("near"))).alias("c"))
    lists = others.unionByName(own_copies).groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("c"))), 1, k + 1).alias("c"))
    members = once.join(folded.select("ha", "hb", "rep"), ["ha", "hb"]).select("id", "rep")
    best = members.join(lists, "rep").select("id", F.slice(F.filter("c", lambda e: e["near"] != F.col("id")), 1, k).alias("c"))
    return best.select("id", F.posexplode("c").alias("at", "e")).select("id", F.col("e.near").alias("neighbour"), (-F.col("e.far")).alias("similarity"), (F.col("at") + 1).cast("int").alias("rank"))


def similar_pairs(nearest: DataFrame) -> DataFrame:
    """(left_note_id, right_note_id): pairs in which one is among the other's nearest, each once."""
    return nearest.select(F.least("id", "neighbour").alias("left_note_id"), F.greatest("id", "neighbour").alias("right_note_id")).distinct()
