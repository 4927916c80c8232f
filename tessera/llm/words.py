"""Words of a text and their hashes, as the problems define them."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
#: Format characters (category Cf) of the basic plane and beyond, found once from the character database.
FORMAT = {c: None for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf"}
_HAS_FORMAT = re.compile("[" + "".join(map(re.escape, map(chr, FORMAT))) + "]")


def normalised(text: str) -> str:
    """NFKC, lower case, without format characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    return text.translate(FORMAT) if not text.isascii() and _HAS_FORMAT.search(text) else text


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the normalised text; none for null."""
    return WORD.findall(normalised(text)) if text else []


def word_hashes(tokens: list[str]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in tokens), dtype=np.uint64, count=len(tokens))
