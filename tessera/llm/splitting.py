"""Cutting oversized texts at natural boundaries.

Two rules share the boundary finder. `split_at_boundaries` takes the last place of the best kind
in a fixed window, with an overlap; `split_at_landmarks` is content-defined: rolling-hash
landmarks snap to the nearest natural boundary, so that an edit moves only neighbouring cuts.
Sizes count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import spread

#: Kinds of place, best first: after a blank line, after a line, after a sentence, after white space.
BLANK_LINE = re.compile(r"(?<=\n)[^\S\n]*\n")
LINE = re.compile(r"\n")
SENTENCE = re.compile(r"""[.!?]["'”’»)\]]*\s|[。！？][」』”’）]*""")
SPACE = re.compile(r"\s")
KINDS = (BLANK_LINE, LINE, SENTENCE, SPACE)


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted places (the position after the boundary) of each kind."""
    return [np.fromiter((m.end() for m in kind.finditer(text)), dtype=np.int64) for kind in KINDS]


def cut_windows(text: str, limit: int, least: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (start, end) of at most `limit`: each ends at the last best place in (start+least, start+limit]."""
    places, pieces, start = boundaries(text), [], 0
    while len(text) - start > limit:
        end = start + limit
        for at in places:
            k = int(np.searchsorted(at, start + limit, side="right")) - 1
            if k >= 0 and at[k] > start + least:
                end = int(at[k])
                break
        pieces.append((start, end))
        start = end - overlap
    return [*pieces, (start, len(text))]


def rolling_hash(text: str, window_bits: int = 6) -> np.ndarray:
    """A hash of the 2**window_bits characters that end at each position, independent of what stands before."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = codes * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    for k in range(window_bits):
        back = np.zeros_like(h)
        step = 1 << k
        back[step:] = h[:-step] if step < len(h) else h[:0]
        h = h + (back << np.uint64(step))
    h ^= h >> np.uint64(32)
    return h * np.uint64(0x94D049BB133111EB)


def cut_landmarks(text: str, limit: int, least: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces whose ends are natural boundaries nearest to the smallest rolling hash of the window.

    The landmark of a window depends on the content around it alone, so after an edit the cuts
    fall into step again. Without any boundary in the window the cut is the landmark itself.
    """
    if len(text) <= limit:
        return [(0, len(text))]
    marks, places = rolling_hash(text), boundaries(text)
    natural = np.unique(np.concatenate(places))
    pieces, start, fresh = [], 0, 0
    while len(text) - start > limit:
        low, high = max(start + least, fresh) + 1, start + limit
        mark = low + int(np.argmin(marks[low - 1 : high]))
        near = natural[np.searchsorted(natural, low) : np.searchsorted(natural, high, side="right")]
        end = int(near[np.argmin(np.abs(near - mark))]) if len(near) else mark
        pieces.append((start, end))
        start, fresh = end - overlap, end
    return [*pieces, (start, len(text))]


RULES = {"window": cut_windows, "landmark": cut_landmarks}


def split_texts(
    df: DataFrame, id_col: str, text_col: str, limit: int = 12_000, least: int = 6_000, overlap: int = 500, rule: str = "window"
) -> DataFrame:
    """(id_col, piece_no, start_char, end_char) for every text longer than `limit`.

    Null, empty and short texts give no row. Repeated rows count once. Other columns are ignored.
    Requires overlap < least < limit. Texts are whole: nothing is read as a prefix.
    """
    if not 0 <= overlap < least < limit:
        raise ValueError("need 0 <= overlap < least < limit")
    cut = RULES[rule]
    schema = pa.schema([("_id", pa.int64()), ("piece_no", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (key, n, a, b)
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for n, (a, b) in enumerate(cut(text, limit, least, overlap), 1)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema, strict=True)], schema=schema)

    long = df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text") > limit)
    cuts = spread(long, "_id").mapInArrow(run, "_id bigint, piece_no int, start_char int, end_char int")
    # Repeats of a row give the same pieces: the small result is made distinct, not the texts.
    return cuts.distinct().withColumnRenamed("_id", id_col)


def split_at_boundaries(df: DataFrame, id_col: str, text_col: str, limit: int = 12_000, least: int = 6_000, overlap: int = 500) -> DataFrame:
    return split_texts(df, id_col, text_col, limit, least, overlap, "window")


def split_at_landmarks(df: DataFrame, id_col: str, text_col: str, limit: int = 12_000, least: int = 6_000, overlap: int = 500) -> DataFrame:
    return split_texts(df, id_col, text_col, limit, least, overlap, "landmark")
