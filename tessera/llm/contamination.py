"""Evaluation passages inside a corpus, by greedy string tiling with Karp-Rabin seeds.

The evaluation items are the stated query set. Every run of `least` words of an item has a
rolling-hash seed; documents are rolled over once, and only where a seed occurs are the two texts
tiled: the longest unmarked common run is marked again and again until none of `least` words is
left. Coverage counts an item's marked words, so reordered passages add up.
Matches are extended by hashes of runs and begin only where the words before differ, so repeated
words don't multiply them. Items are hashed by the executors and handled in blocks whose seeds stay
under a fixed size: the driver and each executor hold one block, however many items there are, and
the corpus is read once for each. It is never shuffled for the comparison.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import word_hashes, words
from tessera.session import cut_lineage, spread

BASE = np.uint64(0x9E3779B97F4A7C15)
MAX_BLOCK_SEEDS = 1_000_000
RESULT = "doc_id bigint, item_id bigint, tiles int, longest int, covered int, item_words int"


def seeds_of(hashes: np.ndarray, least: int) -> np.ndarray:
    """The Karp-Rabin hash of each run of `least` words."""
    if len(hashes) < least:
        return np.zeros(0, dtype=np.uint64)
    n = len(hashes) - least + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(least):
        out = out * BASE + hashes[k : k + n]
    return out


def _hash_of(prefix: np.ndarray, powers: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The Karp-Rabin hash of `length` words from each place, from the hashes of all prefixes."""
    return prefix[at + length] - prefix[at] * powers[length]


def _prefixes(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes) + 1, dtype=np.uint64)
    value, base = 0, int(BASE)
    for k, h in enumerate(hashes.tolist(), 1):
        value = (value * base + h) & 0xFFFFFFFFFFFFFFFF
        out[k] = value
    return out


def extend(doc: np.ndarray, item: np.ndarray, d: np.ndarray, i: np.ndarray, least: int) -> np.ndarray:
    """How many words from each pair of places (d, i) are the same, by bisection over hashes of runs; they share `least` at least."""
    longest = min(len(doc), len(item))
    powers = np.ones(longest + 1, dtype=np.uint64)
    powers[1:] = np.cumprod(np.full(longest, BASE), dtype=np.uint64)
    of_doc, of_item = _prefixes(doc), _prefixes(item)
    low, high = np.full(len(d), least), np.minimum(len(doc) - d, len(item) - i)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = _hash_of(of_doc, powers, d, middle) == _hash_of(of_item, powers, i, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def tiles(doc: np.ndarray, item: np.ndarray, d: np.ndarray, i: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from the places where common runs begin: (doc start, item start, length), longest first.

    Each run is extended once; one that a longer tile has cut comes back as the parts that are free.
    Of equally long runs the one that begins first counts.
    """
    free_d, free_i, out = np.ones(len(doc), bool), np.ones(len(item), bool), []
    waiting = list(zip((-extend(doc, item, d, i, least)).tolist(), d.tolist(), i.tolist(), strict=True))
    heapq.heapify(waiting)
    while waiting and free_i.any():
        length, at, place = heapq.heappop(waiting)
        length = -length
        free = free_d[at : at + length] & free_i[place : place + length]
        if free.all():
            free_d[at : at + length] = False
            free_i[place : place + length] = False
            out.append((at, place, length))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for start, end in edges.reshape(-1, 2).tolist():
            if end - start >= least:
                heapq.heappush(waiting, (start - end, at + start, place + start))
    return out


class Seeds:
    """Seed hashes of a block of items, sorted with the word before each, and the item and place of each."""

    FEW = 8  # places of a seed that are compared one by one

    def __init__(self, items: list[tuple[int, np.ndarray]], least: int):
        self.items = items
        parts = [seeds_of(h, least) for _, h in items]
        none = np.zeros(0, np.uint64)
        hashes = np.concatenate([*parts, none])
        before = np.concatenate([*(np.concatenate([[np.uint64(0)], h[: max(0, len(p) - 1)]]) for (_, h), p in zip(items, parts, strict=True) if len(p)), none])
        owner = np.repeat(np.arange(len(items)), [len(p) for p in parts])
        place = np.concatenate([*(np.arange(len(p)) for p in parts), np.zeros(0, np.int64)])
        order = np.lexsort((before, hashes))
        self.hashes, self.before, self.owner, self.place = hashes[order], before[order], owner[order], place[order]

    def starts(self, rolled: np.ndarray, words_of: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Item number to the (doc, item) places where a run of common words begins: the words before differ, or there is none.

        Pairs within a run are never listed, so a word or phrase that is repeated n and m times gives about n + m pairs.
        """
        if not len(rolled) or not len(self.hashes):
            return {}
        low = np.searchsorted(self.hashes, rolled)
        hit = np.flatnonzero(self.hashes[np.minimum(low, len(self.hashes) - 1)] == rolled)
        if not len(hit):
            return {}
        low, high = low[hit], np.searchsorted(self.hashes, rolled[hit], side="right")
        before = np.where(hit > 0, words_of[np.maximum(hit - 1, 0)], np.uint64(1))
        few = high - low <= self.FEW
        counts = (high - low)[few]
        d = np.repeat(hit[few], counts)
        k = np.repeat(low[few], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        begins = self.before[k] != np.repeat(before[few], counts)
        ds, ks = [d[begins]], [k[begins]]
        for at, a, b, word in zip(hit[~few], low[~few], high[~few], before[~few], strict=True):
            # Sorted by the word before: all but those with the document's own.
            x, y = a + np.searchsorted(self.before[a:b], word), a + np.searchsorted(self.before[a:b], word, side="right")
            own = np.concatenate([np.arange(a, x), np.arange(y, b)])
            ds.append(np.full(len(own), at))
            ks.append(own)
        d, k = np.concatenate(ds), np.concatenate(ks)
        out = {}
        order = np.argsort(self.owner[k], kind="stable")
        d, k = d[order], k[order]
        owners, first = np.unique(self.owner[k], return_index=True)
        for owner, a, b in zip(owners.tolist(), first, [*first[1:], len(k)], strict=True):
            out[owner] = (d[a:b], self.place[k[a:b]])
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str, least: int) -> Iterator[Seeds]:
    """The items in blocks of at most MAX_BLOCK_SEEDS seeds (a longer item is a block of its own); words are hashed by the executors."""
    schema = pa.schema([("id", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(key, h.tobytes()) for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if len(h := word_hashes(words(text))) >= least]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [[], []], schema, strict=True)], schema=schema)

    rows = items.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    block, size = [], 0
    for row in rows.mapInArrow(run, "id bigint, words binary").distinct().toLocalIterator():
        hashes = np.frombuffer(bytes(row["words"]), dtype=np.uint64)
        if block and size + len(hashes) > MAX_BLOCK_SEEDS:
            yield Seeds(block, least)
            block, size = [], 0
        block.append((row["id"], hashes))
        size += len(hashes)
    if block:
        yield Seeds(block, least)


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 10, least_covered: float = 0.0
) -> DataFrame:
    """(doc_id, item_id, tiles, longest, covered, item_words): documents that hold an item's words in tiles of at least `least` words.

    covered counts the item's words inside tiles, in whatever order they stand; rows whose share of the
    item is below least_covered drop out. Null, empty and shorter texts give no row; repeated documents
    and items count once, of several texts of an id the largest figures; other columns are ignored. No items: no rows.
    """
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((c, pa.int32()) for c in ("tiles", "longest", "covered", "item_words"))])
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(doc_text).alias("text")).where(F.length("text") > 0)
    rows = spread(rows, "doc_id")

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds: Seeds = shared.value
            for batch in batches:
                out: list[tuple] = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    hashes = word_hashes(words(text))
                    for k, (d, i) in seeds.starts(seeds_of(hashes, least), hashes).items():
                        ident, item = seeds.items[k]
                        marked = tiles(hashes, item, d, i, least)
                        covered = sum(m[2] for m in marked)
                        if marked and covered >= least_covered * len(item):
                            out.append((key, ident, len(marked), marked[0][2], covered, len(item)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 6, schema, strict=True)], schema=schema)

        return run

    result, held = None, None
    for seeds in _blocks(items, item_id, item_text, least):
        if held is not None:  # another block follows: the last one's rows are written, and its seeds let go
            result = result.unionByName(cut_lineage(held[0])) if result is not None else cut_lineage(held[0])
            held[1].destroy()
        shared = spark.sparkContext.broadcast(seeds)
        held = (rows.mapInArrow(scan(shared), RESULT), shared)
    if held is None:
        return spark.createDataFrame([], RESULT)
    result = held[0] if result is None else result.unionByName(held[0])
    # Repeats of a document give equal rows; the few found rows are made distinct, not the corpus.
    return result.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("tiles", "longest", "covered", "item_words")))
