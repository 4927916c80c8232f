"""Near-duplicate records by tiled exact comparison of parity signatures.

Each record's word set becomes a bit string: every distinct word flips one bit. Two sets that
differ in d words differ in at most d bits, so the exclusive-or's bit count is a lower bound of
the difference and no near pair is lost. Records are sorted into tiles by their population count
(number of distinct words); tile pairs whose counts differ beyond the radius that the similarity
allows are skipped, the others are compared in numpy with exclusive-or and bit counts. What stays
within the radius is verified on the word sets, so results are exact.

Cost: the comparison is quadratic in the number of different word sets, at about 4 ns a pair and
core; exact copies are folded into one representative before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import word_hashes, words
from tessera.operators.components import connected_components
from tessera.session import cut_lineage, parallelism, spread

FIRST, SECOND = 4, 12  # 64-bit words of the first bound, and of the one for what it lets through
TILE, LEAST_TILE = 32_768, 2_048
PROFILE = "note_id bigint, n int, first binary, second binary, fp_a bigint, fp_b bigint, hashes array<bigint>"


def parity_bits(hashes: np.ndarray, n_words: int, shift: int) -> np.ndarray:
    """Each hash flips one of 64 * n_words bits."""
    where = (hashes >> np.uint64(shift)) % np.uint64(64 * n_words)
    odd = (np.bincount(where.astype(np.int64), minlength=64 * n_words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def profiles(notes: DataFrame, id_col: str, title_col: str, body_col: str, min_words: int) -> DataFrame:
    """Signature, fingerprint and word hashes of every record with enough distinct words."""
    schema = pa.schema([("note_id", pa.int64()), ("n", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("fp_a", pa.int64()), ("fp_b", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            for key, title, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = set(words(f"{title or ''} {body or ''}"))
                if len(found) < min_words:
                    continue
                h = np.sort(word_hashes(list(found)))
                raw = h.tobytes()
                values = (key, len(h), parity_bits(h, FIRST, 0).tobytes(), parity_bits(h, SECOND, 20).tobytes())
                prints = np.array([xxhash.xxh3_64_intdigest(raw, 1), xxhash.xxh3_64_intdigest(raw, 2)], dtype=np.uint64).view(np.int64)
                for c, v in zip(cols, (*values, int(prints[0]), int(prints[1]), h.view(np.int64)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    rows = notes.select(F.col(id_col).alias("note_id"), F.col(title_col).alias("title"), F.col(body_col).alias("body")).where("note_id is not null")
    return spread(rows, "note_id").mapInArrow(run, PROFILE)


def _bands(sizes: list[tuple[int, int]], tile: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """(n, tile, tiles, first, last) for each size: neighbouring small sizes share a tile, a large one is split.

    first and last are the tiles of the sizes that a record of size n can be near to.
    """
    out, at, filled = [], 0, 0
    for n, count in sorted(sizes):
        if filled and filled + count > tile:
            at, filled = at + 1, 0
        parts = max(1, math.ceil(count / tile))
        out.append((n, at, parts))
        if parts > 1:
            at, filled = at + parts, 0
        else:
            filled += count
    ns = [n for n, _, _ in out]
    low = np.searchsorted(ns, [math.ceil(n * similarity - 1e-9) for n in ns])
    high = np.searchsorted(ns, [math.floor(n / similarity + 1e-9) for n in ns], side="right") - 1
    return [(n, at, parts, out[a][1], out[b][1] + out[b][2] - 1) for (n, at, parts), a, b in zip(out, low.tolist(), high.tolist(), strict=True)]


def radius(n_left: np.ndarray, n_right: np.ndarray, similarity: float) -> np.ndarray:
    """The most words by which two sets of these sizes can differ at the similarity."""
    return ((1 - similarity) / (1 + similarity)) * (n_left + n_right) + 1e-9


def compare_tiles(left, right, same: bool, similarity: float, rows: int = 64, columns: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two tiles (n, first, second; sorted by n) that the bounds let through."""
    (nl, fl, sl), (nr, fr, sr) = left, right
    share = (1 - similarity) / (1 + similarity)
    found_l, found_r = [], []
    fr_t = np.ascontiguousarray(fr.T)
    for a in range(0, len(nl), rows):
        block, count = fl[a : a + rows], nl[a : a + rows]
        low = np.searchsorted(nr, math.ceil(count[0] * similarity - 1e-9))
        high = np.searchsorted(nr, math.floor(count[-1] / similarity + 1e-9), side="right")
        if same:
            low = max(low, a)
        room_l = np.floor(share * count).astype(np.int16)[:, None]
        for b in range(low, high, columns):
            c = min(high, b + columns)
            bits = np.zeros((len(block), c - b), dtype=np.int16)
            for w in range(FIRST):
                bits += np.bitwise_count(block[:, w, None] ^ fr_t[w, b:c])
            room_r = (np.floor(share * nr[b:c]) + 2).astype(np.int16)
            i, j = np.nonzero(bits <= room_l + room_r)
            if not len(i):
                continue
            i, j = i + a, j + b
            keep = np.bitwise_count(fl[i] ^ fr[j]).sum(1) <= (room := radius(nl[i], nr[j], similarity))
            if same:
                keep &= i < j
            i, j, room = i[keep], j[keep], room[keep]
            keep = np.bitwise_count(sl[i] ^ sr[j]).sum(1) <= room
            found_l.append(i[keep])
            found_r.append(j[keep])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(found_l or [none]), np.concatenate(found_r or [none])


def _tile_arrays(table: pa.Table):
    n = table.column("n").to_numpy().astype(np.int64)
    order = np.argsort(n, kind="stable")
    first = np.frombuffer(b"".join(table.column("first").to_pylist()), dtype=np.uint64).reshape(-1, FIRST)[order]
    second = np.frombuffer(b"".join(table.column("second").to_pylist()), dtype=np.uint64).reshape(-1, SECOND)[order]
    return (n[order], first, second), table.column("rep").to_numpy()[order]


def candidate_pairs(reps: DataFrame, similarity: float, tile: int | None = None) -> DataFrame:
    """(left_id, right_id) of representatives within the radius, from tiled comparison.

    A unit of work is a pair of tiles. Each record goes to the units of its own tile with the tiles of
    sizes it can be near to, so no list of units is made and skipped tile pairs get no rows.
    """
    spark = reps.sparkSession
    # One number for each size that occurs: bounded by the longest record, not by the collection.
    sizes = [(r["n"], r["count"]) for r in reps.groupBy("n").count().collect()]
    if not sizes:
        return spark.createDataFrame([], "left_id bigint, right_id bigint")
    # Tiles as large as memory allows, but enough pairs of them for all cores.
    total, cores = sum(count for _, count in sizes), parallelism(spark)
    tile = tile or max(LEAST_TILE, min(TILE, math.ceil(total / math.sqrt(4 * cores))))
    bands = _bands(sizes, tile, similarity)
    place = spark.createDataFrame(bands, "n int, at int, parts int, first int, last int")
    at = (F.col("at") + F.pmod(F.xxhash64("rep"), F.col("parts"))).cast("int")
    tiled = reps.select("rep", "n", "first", "second").join(F.broadcast(place.withColumnsRenamed({"first": "low", "last": "high"})), "n").withColumn("tile", at)  # a row for each size
    pair = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    none = F.array().cast("array<struct<i:int,j:int,side:int>>")
    later = F.when(F.col("high") >= F.col("tile"), F.transform(F.sequence("tile", "high"), lambda j: pair(F.col("tile"), j, 0))).otherwise(none)
    earlier = F.when(F.col("low") < F.col("tile"), F.transform(F.sequence(F.col("low"), F.col("tile") - 1), lambda i: pair(i, F.col("tile"), 1))).otherwise(none)
    tiled = tiled.select(F.explode(F.concat(later, earlier)).alias("u"), "rep", "n", "first", "second").select("u.*", "rep", "n", "first", "second")
    schema = pa.schema([("left_id", pa.int64()), ("right_id", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        side = group.column("side")
        left, left_ids = _tile_arrays(group.filter(pa.compute.equal(side, 0)))
        same = group.column("i")[0] == group.column("j")[0]
        right, right_ids = (left, left_ids) if same else _tile_arrays(group.filter(pa.compute.equal(side, 1)))
        i, j = compare_tiles(left, right, same, similarity) if len(left[0]) and len(right[0]) else (np.zeros(0, np.int64),) * 2
        return pa.Table.from_arrays([pa.array(left_ids[i], pa.int64()), pa.array(right_ids[j], pa.int64())], schema=schema)

    # A fixed number of partitions, which the planner doesn't merge: units are much work for their bytes.
    tiles = max(last for *_, last in bands) + 1
    partitions = max(cores, min(20 * cores, tiles * (tiles + 1) // 2))
    return tiled.repartition(partitions, "i", "j").groupBy("i", "j").applyInArrow(run, "left_id bigint, right_id bigint")


def near_groups(
    notes: DataFrame, id_col: str = "note_id", title_col: str = "title", body_col: str = "body", similarity: float = 0.7, min_words: int = 20, tile: int | None = None
) -> DataFrame:
    """(note_id, class_id, links): every record that is near another one, its class and its number of near records.

    Two records are near if the Jaccard similarity of their distinct words (title and body, null as
    empty) is at least `similarity` and each has `min_words`; classes are chains of near records.
    class_id is the smallest id; links counts exact copies too. Repeated rows count once; where one id has several texts, the
    one with the smallest fingerprint counts. Short, empty and null texts give no row.
    """
    seen = profiles(notes, id_col, title_col, body_col, min_words)
    seen = cut_lineage(seen.groupBy("note_id").agg(F.min_by(F.struct("n", "first", "second", "fp_a", "fp_b", "hashes"), F.struct("fp_a", "fp_b")).alias("p")).select("note_id", "p.*"))
    reps = cut_lineage(seen.groupBy("fp_a", "fp_b").agg(F.min("note_id").alias("rep"), F.count("*").alias("copies"), F.min_by(F.struct("n", "first", "second", "hashes"), "note_id").alias("p")).select("fp_a", "fp_b", "rep", "copies", "p.*"))
    members = seen.select("note_id", "fp_a", "fp_b").join(reps.select("fp_a", "fp_b", "rep", "copies"), ["fp_a", "fp_b"]).select("note_id", "rep", "copies")
    pairs = candidate_pairs(reps, similarity, tile)
    sets = reps.select("rep", "n", "hashes")
    common = F.size(F.array_intersect("l.hashes", "r.hashes"))
    checked = (
        pairs.join(sets.alias("l"), F.col("l.rep") == F.col("left_id"))
        .join(sets.alias("r"), F.col("r.rep") == F.col("right_id"))
        .where(common >= F.lit(similarity) * (F.col("l.n") + F.col("r.n") - common) - F.lit(1e-9))
        .select("left_id", "right_id")
    )
    links = cut_lineage(checked)
    labels = connected_components(links, "left_id", "right_id")
    # Near records, not word sets: each neighbour counts with its copies, and a record's own copies are near it.
    both = links.select(F.col("left_id").alias("rep"), F.col("right_id").alias("other")).unionByName(links.select(F.col("right_id").alias("rep"), F.col("left_id").alias("other")))
    degree = both.join(reps.select(F.col("rep").alias("other"), "copies"), "other").groupBy("rep").agg(F.sum("copies").alias("near"))
    classes = labels.withColumnRenamed("node", "rep").join(degree, "rep", "left")
    return (
        members.join(classes, "rep", "left")
        .where("component is not null or copies > 1")
        .select("note_id", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("near", F.lit(0).cast("bigint")) + F.col("copies") - 1).alias("links"))
    )


def group_pairs(groups: DataFrame, rows: int = 1000) -> DataFrame:
    """(left_note_id, right_note_id) of all pairs of a class, the smaller id first.

    The result is defined as all pairs, so its size is the sum of squares of the class sizes. A class
    of more than `rows` records has its left side cut into slices of about so many, each with a copy
    of the class on the right: a task makes the pairs of one slice.
    """
    sizes = groups.groupBy("class_id").agg(F.count("*").alias("size")).where(F.col("size") > rows)
    slices = F.coalesce(F.ceil(F.col("size") / rows), F.lit(1).cast("bigint"))
    sized = groups.join(sizes, "class_id", "left").select("class_id", "note_id", slices.alias("slices"))
    left = sized.select("class_id", F.col("note_id").alias("left_note_id"), F.pmod(F.xxhash64("note_id"), F.col("slices")).alias("slice"))
    right = sized.select("class_id", F.col("note_id").alias("right_note_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"))
    return left.join(right, ["class_id", "slice"]).where("left_note_id < right_note_id").select("left_note_id", "right_note_id")
