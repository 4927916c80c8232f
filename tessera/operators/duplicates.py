"""Near-duplicate decisions for incoming notes: strongest existing match, numeric conflicts, safeguarded actions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import cut_lineage, parallelism, spread

SAME, TITLE, BODY, GAP = 4.0, 0.88, 0.88, 0.08


TILE = 16_384  # notes that are compared with as many others at a time
BUCKETS = 1 << 16  # of the entries' frequencies, which only decide on the order of entries
BITS = 256  # of a set's signature
CHUNK = 1 << 21  # pairs that are looked at at a time
NAMED = 2_000_000  # the most ids that are broadcast
#: Of each kind of set: its column, and the share of the entries of both together that two similar sets have in common at least.
KINDS = {"grams": TITLE / 2, "terms": BODY / (1 + BODY)}
_NUMBERS = "l_ids binary, l_n_grams binary, l_sig_grams binary, l_size_grams binary, l_first_grams binary, l_n_terms binary, l_sig_terms binary, l_size_terms binary, l_first_terms binary"


def _keyed(notes: DataFrame) -> DataFrame:
    """note_id, the hash of the normalised title, and as 64-bit hashes the set of title trigrams and that of body terms."""
    title, body = F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))
    hashed = lambda values, name: F.array_distinct(F.transform(values, lambda x: F.xxhash64(x))).alias(name)
    return notes.select("note_id", F.xxhash64(F.array_join(T.terms(F.lower(title)), " ")).alias("key"), hashed(T.trigrams(title), "grams"), hashed(T.terms(F.lower(body)), "terms"))


def only(df: DataFrame, ids: DataFrame, key: str = "note_id") -> DataFrame:
    """The rows of df with one of the distinct ids; their table is broadcast if it is small, so that texts are not shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= NAMED else ids, key, "left_semi")


def _frequencies(keyed: DataFrame) -> dict[str, np.ndarray]:
    """For each kind of set how many entries fall into each bucket of hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            for k in range(2):
                totals[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(batch.column(k).flatten().to_numpy() & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], names=["bucket", "n"])

    counts = keyed.select(*KINDS).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(2 * BUCKETS, np.int64)
    totals[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    return {kind: totals[k * BUCKETS : (k + 1) * BUCKETS] for k, kind in enumerate(KINDS)}


def first_entries(sets: pa.Array, counts: np.ndarray, both: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each set its size, signature, and how many and which of its entries, as 32 bits, have to be looked up.

    In one order of all entries, the rarest first, sets that share at least `share` of the entries of either have
    an entry in common among the first n - ceil(share * n) + 1 of each. A signature has a bit for each entry.
    """
    sizes = np.diff(sets.offsets.to_numpy())
    entries, owner = sets.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
    bits = np.zeros((len(sizes), BITS), bool)
    bits[owner, (entries >> 32) & (BITS - 1)] = True
    order = np.lexsort((entries, counts[entries & (BUCKETS - 1)], owner))
    share = both / (1 - both)
    keep = np.where(sizes > 0, sizes - np.ceil(sizes * share - 1e-9).astype(np.int64) + 1, 0)
    place = np.arange(len(entries)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return sizes, np.packbits(bits, axis=1), keep, (entries[order][place < keep[owner]] & 0xFFFFFFFF).astype(np.uint32)


def _tiles(keyed: DataFrame, frequencies, side: str) -> DataFrame:
    """A row for each tile of notes, with sizes, signatures and first entries of their sets as arrays; a repeated id counts once."""
    n = max(1, math.ceil(keyed.count() / TILE))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, rows = [batch.column(0)], batch.num_rows
            blob = lambda values, ends: pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])  # noqa: E731, B023
            for k, (kind, both) in enumerate(KINDS.items()):
                sizes, signatures, keep, first = first_entries(batch.column(k + 1), frequencies.value[kind], both)
                columns += [pa.array(sizes.astype(np.int32)), blob(signatures, np.arange(1, rows + 1) * (BITS // 8)), blob(first, np.cumsum(keep) * 4)]
            yield pa.RecordBatch.from_arrays(columns, names=["note_id", *(f"{c}_{kind}" for kind in KINDS for c in ("n", "sig", "first"))])

    def pack(part: pa.Table) -> pa.Table:
        ids, at = np.unique(part.column("note_id").to_numpy(), return_index=True)
        part = part.take(pa.array(at))
        row = {f"{side}_ids": ids.astype(np.int64).tobytes()}
        for kind in KINDS:
            first = part.column(f"first_{kind}").to_pylist()
            row |= {f"{side}_n_{kind}": part.column(f"n_{kind}").to_numpy().astype(np.int32).tobytes(), f"{side}_sig_{kind}": b"".join(part.column(f"sig_{kind}").to_pylist())}
            row |= {f"{side}_size_{kind}": np.array([len(x) // 4 for x in first], np.int32).tobytes(), f"{side}_first_{kind}": b"".join(first)}
        return pa.table({k: pa.array([v], pa.binary()) for k, v in row.items()})

    numbers = ", ".join(f"n_{kind} int, sig_{kind} binary, first_{kind} binary" for kind in KINDS)
    placed = keyed.select("note_id", *KINDS).mapInArrow(cut, f"note_id bigint, {numbers}").withColumn("tile", F.pmod(F.xxhash64("note_id"), F.lit(n)))
    return cut_lineage(placed.repartition(2 * n, "tile").groupBy("tile").applyInArrow(pack, _NUMBERS.replace("l_", f"{side}_")))


def _meeting(row: dict, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left ids, right ids) of two tiles whose sets may be similar: an entry looked up in common, and sizes and signatures that allow it."""
    of = {s: {c: np.frombuffer(row[f"{s}_{c}_{kind}"], t) for c, t in (("n", np.int32), ("sig", np.uint64), ("size", np.int32), ("first", np.uint32))} for s in "lr"}
    ids = {s: np.frombuffer(row[f"{s}_ids"], np.int64) for s in "lr"}
    sig = {s: of[s]["sig"].reshape(len(ids[s]), BITS // 64) for s in "lr"}
    owner = {s: np.repeat(np.arange(len(ids[s])), of[s]["size"]) for s in "lr"}
    both = KINDS[kind]
    share = both / (1 - both)
    # Entries of one note after another by its size, so that only notes of a similar size are looked up.
    keyed = lambda s, n: of[s]["first"].astype(np.uint64) << np.uint64(32) | n.astype(np.uint64)
    found = keyed("r", of["r"]["n"][owner["r"]])
    order = np.argsort(found)
    found, owner["r"] = found[order], owner["r"][order]
    size = of["l"]["n"][owner["l"]]
    low = np.searchsorted(found, keyed("l", np.ceil(size * share - 1e-9)), "left")
    high = np.searchsorted(found, keyed("l", np.floor(size / share + 1e-9)), "right")
    ends, a = np.cumsum(high - low), 0
    words = {s: sig[s][:, 0].copy() for s in "lr"}
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")))
        n = (high - low)[a:b]
        x = np.repeat(owner["l"][a:b], n)
        y = owner["r"][np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        a = b
        # An entry of one set whose bit the other lacks is not shared: seen in a part of the bits, then in all.
        p, q, u, v = of["l"]["n"][x], of["r"]["n"][y], words["l"][x], words["r"][y]
        common = u & v
        least = np.minimum(p - np.bitwise_count(u ^ common), q - np.bitwise_count(v ^ common))
        kept = np.flatnonzero(least >= both * (p + q) - 1e-9)
        x, y, p, q = x[kept], y[kept], p[kept], q[kept]
        u, v = sig["l"][x], sig["r"][y]
        least = np.minimum(p - np.bitwise_count(u & ~v).sum(axis=1, dtype=np.int32), q - np.bitwise_count(v & ~u).sum(axis=1, dtype=np.int32))
        kept = np.flatnonzero((least >= both * (p + q) - 1e-9) & (ids["l"][x] != ids["r"][y]))
        yield ids["l"][x[kept]], ids["r"][y[kept]]


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l_id, r_id, kind): a superset of the pairs with similar sets. Tiles meet without a shuffle; only pairs come out."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                for k, kind in enumerate(KINDS):
                    for x, y in _meeting(row, kind):
                        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.full(len(x), k, np.int32))], names=["l_id", "r_id", "kind"])

    return left.crossJoin(right).mapInArrow(meet, "l_id bigint, r_id bigint, kind int").distinct()


def duplicate_scores(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(incoming_id, existing_id, score): every existing note that is a duplicate by title or body.

    4 for the same normalised title, 3 + Dice of title trigrams from 0.88, 2 + Jaccard of body terms
    from 0.88. Pairs come from equality and from sizes, rarest entries and signatures of the sets; the sets themselves are
    only joined for the pairs that these leave. A note is no duplicate of itself; repeated rows are exact and count once.
    """
    spark = incoming.sparkSession
    right = cut_lineage(_keyed(spread(existing, "note_id")))
    left = _keyed(incoming)
    ids = ("l_id", "r_id")
    titled = lambda df, key: df.select(F.col("note_id").alias(key), "key").distinct()
    same = titled(left, "l_id").join(titled(right, "r_id"), "key").select(*ids, F.lit(SAME).alias("score"))
    frequencies = spark.sparkContext.broadcast(_frequencies(right))
    pairs = cut_lineage(_pairs(_tiles(left, frequencies, "l"), _tiles(right, frequencies, "r")))
    named = lambda key: pairs.select(F.col(key).alias("note_id")).distinct()
    sets = lambda df, s: df.select(F.col("note_id").alias(f"{s}_id"), *(F.col(kind).alias(f"{s}_{kind}") for kind in KINDS)).dropDuplicates([f"{s}_id"])
    mine, others = sets(_keyed(only(incoming, named("l_id"))), "l"), sets(only(right, named("r_id")), "r")
    # Comparing sets is much work for few bytes: a fixed number of partitions, which the planner doesn't merge.
    full = pairs.join(mine, "l_id").repartition(parallelism(spark), "r_id").join(others, "r_id")

    def alike(kind: int, name: str, similarity) -> DataFrame:
        common = F.size(F.array_intersect(f"l_{name}", f"r_{name}"))
        counted = full.where(F.col("kind") == kind).select(*ids, common.alias("c"), (F.size(f"l_{name}") + F.size(f"r_{name}")).alias("s"))
        return counted.select(*ids, similarity(F.col("c"), F.col("s")).alias("t"))

    titles = alike(0, "grams", lambda c, s: F.when(s > 0, 2 * c / s).otherwise(0.0))
    bodies = alike(1, "terms", lambda c, s: F.when(s > 0, c / (s - c)).otherwise(0.0))
    found = same.where("l_id <> r_id").unionByName(titles.where(F.col("t") >= TITLE).select(*ids, (3 + F.col("t")).alias("score")))
    found = found.unionByName(bodies.where(F.col("t") >= BODY).select(*ids, (2 + F.col("t")).alias("score")))
    # The kinds of score don't overlap, so the highest is that of the strongest kind.
    return found.groupBy(F.col("l_id").alias("incoming_id"), F.col("r_id").alias("existing_id")).agg(F.max("score").alias("score"))


def strongest_duplicate(scores: DataFrame) -> DataFrame:
    """(incoming_id, existing_id, score): the best match, unless it is below 4 and the next is within 0.08."""
    order = Window.partitionBy("incoming_id").orderBy(F.desc("score"), "existing_id")
    ranked = scores.withColumn("n", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).where("n = 1")
    clear = (F.col("score") >= SAME) | F.col("second").isNull() | (F.col("score") - F.col("second") >= GAP)
    return ranked.where(clear).select("incoming_id", "existing_id", "score")


def strongest_of(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """strongest_duplicate(duplicate_scores(incoming, existing)) without listing all notes of a shared title.

    A note of the same title settles it: only the two lowest ids of each title are looked at, however
    many notes share it. Scores are computed for incoming notes without such a match alone.
    """
    keyed = lambda df, key: df.select(F.col("note_id").alias(key), F.array_join(T.terms(F.lower(F.coalesce("title", F.lit("")))), " ").alias("key")).distinct()
    order = Window.partitionBy("key").orderBy("existing_id")
    lowest = keyed(existing, "existing_id").withColumn("n", F.row_number().over(order)).where("n <= 2").groupBy("key").agg(F.array_sort(F.collect_list("existing_id")).alias("ids"))
    other = F.get(F.filter("ids", lambda i: i != F.col("incoming_id")), F.lit(0))
    same = cut_lineage(keyed(incoming, "incoming_id").join(lowest, "key", "left").select("incoming_id", other.alias("existing_id")))
    settled = same.where("existing_id is not null").select("incoming_id", "existing_id", F.lit(SAME).alias("score"))
    rest = only(incoming, same.where("existing_id is null").select(F.col("incoming_id").alias("note_id")))
    return settled.unionByName(strongest_duplicate(duplicate_scores(rest, existing)))


def safeguarded(decisions: DataFrame, duplicates: DataFrame, notes: DataFrame) -> DataFrame:
    """(incoming_id, action, existing_id) from model decisions (incoming_id, action, existing_id) and duplicate matches.

    A duplicate overrides: contradict on a numeric conflict or if the model said so, else merge. A merge
    whose numbers conflict becomes contradict. Other decisions stay.
    """
    found = duplicates.select("incoming_id", F.col("existing_id").alias("duplicate_id"))
    joined = cut_lineage(decisions.join(found, "incoming_id", "left").withColumn("target", F.coalesce("duplicate_id", "existing_id")))
    # Numbers decide only on merges and duplicates: no other text is read for them.
    asked = joined.where(F.col("duplicate_id").isNotNull() | (F.col("action") == "merge")).select(F.explode(F.array("incoming_id", "target")).alias("note_id"))
    texts = only(notes, asked.where("note_id is not null").distinct()).select("note_id", F.coalesce("body", F.lit("")).alias("body")).dropDuplicates(["note_id"])
    body = lambda name, key: texts.select(F.col("note_id").alias(key), F.col("body").alias(name))
    full = joined.join(body("new", "incoming_id"), "incoming_id", "left").join(body("old", "target"), "target", "left")
    conflict = T.numeric_conflict(F.coalesce("old", F.lit("")), F.coalesce("new", F.lit("")))
    action = (
        F.when(F.col("duplicate_id").isNotNull(), F.when(conflict | (F.col("action") == "contradict"), "contradict").otherwise("merge"))
        .when((F.col("action") == "merge") & conflict, "contradict")
        .otherwise(F.col("action"))
    )
    return full.select("incoming_id", action.alias("action"), F.when(action != "new", F.col("target")).alias("existing_id"))


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df with the first row of each key, and `copies`: identical content is stored once. Aggregated before the shuffle, so a key may be hot."""
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest).alias("_tie")))
    return df.groupBy(key).agg(first.alias("_r"), F.count("*").alias("copies")).select(*(F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns), "copies")


def first_of_each(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, id, copies) by aggregation: for keys of which one may hold a large part of the rows."""
    return df.groupBy(key).agg(F.min(id_col).alias(id_col), F.countDistinct(id_col).alias("copies"))
