"""Text functions that Spark has no built-in for, as Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold_title(text: str | None) -> str | None:
    """NFKC and lower case, trimmed, runs of white space as one space; null stays null."""
    if text is None:
        return None
    return " ".join(unicodedata.normalize("NFKC", text).lower().split())


@F.pandas_udf(T.StringType())
def _title_key(titles: pd.Series) -> pd.Series:
    return titles.map(fold_title, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


def title_key(title: Column) -> Column:
    """The key by which titles are compared."""
    return _title_key(title)


def nfkc(text: Column) -> Column:
    return _nfkc(text)


# ---- tokens --------------------------------------------------------------------------------
#: Words that a search leaves out, and those that candidate comparison leaves out.
SEARCH_STOP_WORDS = tuple(
    "a an and are as at be by can could do does for from how in is it of on or should that the this to was were what when where which who why would with".split()
)
CANDIDATE_STOP_WORDS = tuple("a an and are as at be by for from in is it of on or that the this to was were with".split())
TERM = r"[\p{L}\p{N}]+"
QUERY_TERM = r"[\p{L}\p{N}_]+"
MAX_TERMS = 16


def _accents() -> tuple[str, str]:
    """Small Latin letters with marks and their base letters, from the character database."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    kept = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and c == c.lower()]
    return "".join(c for c, _ in kept), "".join(b for _, b in kept)


ACCENTED, BASE = _accents()


def folded(text: Column) -> Column:
    """Lower case without Latin diacritics, as the index stores terms."""
    return F.translate(F.lower(text), ACCENTED, BASE)


def terms(text: Column, pattern: str = TERM) -> Column:
    """All terms of a text in order; null for null."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def index_terms(text: Column) -> Column:
    return terms(folded(text))


def query_terms(text: Column) -> Column:
    """Distinct terms, the first 16, then without stop words unless nothing else is left."""
    found = F.slice(F.array_distinct(terms(F.lower(text), QUERY_TERM)), 1, MAX_TERMS)
    kept = F.filter(found, lambda t: ~t.isin(*SEARCH_STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(found)


def integration_terms(text: Column) -> Column:
    """Terms of at least two characters without stop words, distinct, then the first 16."""
    kept = F.filter(terms(F.lower(text)), lambda t: (F.length(t) >= 2) & ~t.isin(*SEARCH_STOP_WORDS))
    return F.slice(F.array_distinct(kept), 1, MAX_TERMS)


def discovery_tokens(text: Column) -> Column:
    """The distinct terms that candidate discovery compares."""
    return F.array_distinct(F.filter(terms(F.lower(text)), lambda t: (F.length(t) >= 2) & ~t.isin(*CANDIDATE_STOP_WORDS)))


def jaccard(left: Column, right: Column) -> Column:
    """Similarity of two arrays of distinct entries; 0 if one is empty or null."""
    common = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), common / (F.size(left) + F.size(right) - common)).otherwise(F.lit(0.0))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of the terms joined by a space; a shorter text is its own gram."""
    key = F.array_join(terms(F.lower(text)), " ")
    grams = F.transform(F.sequence(F.lit(1), F.length(key) - 2), lambda i: F.substring(key, i, 3))
    return F.when(F.length(key) >= 3, F.array_distinct(grams)).when(F.length(key) > 0, F.array(key)).otherwise(F.array().cast("array<string>"))


def dice(left: Column, right: Column) -> Column:
    both = F.size(left) + F.size(right)
    return F.when((F.size(left) > 0) & (F.size(right) > 0), 2 * F.size(F.array_intersect(left, right)) / both).otherwise(F.lit(0.0))


#: What a number looks like, and the wording of a correction.
NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?%?"
CORRECTION = (
    r"(?i)\b(?:correct(?:ed|ion)?|revis(?:ed|ion)|updated?|supersed(?:e|es|ed|ing)|rather than|instead of|previously reported|no longer)\b"
)


def number_set(text: Column) -> Column:
    """Distinct numbers of a text in canonical form: no thousands commas, plus sign or trailing zeros; % kept."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))

    def canonical(n: Column) -> Column:
        n = F.regexp_replace(n, r"^\+", "")
        n = F.regexp_replace(n, r"^(-?)0+(?=\d)", "$1")
        n = F.regexp_replace(n, r"(\.\d*?)0+(?=%?$)", "$1")
        n = F.regexp_replace(n, r"\.(?=%?$)", "")
        return F.regexp_replace(n, r"^-0(?=%?$)", "0")

    return F.array_distinct(F.transform(raw, canonical))


def numeric_conflict(existing: Column, incoming: Column) -> Column:
    """Both have numbers, the incoming text has a new one, and it corrects or is otherwise nearly the same."""
    old, new = number_set(existing), number_set(incoming)
    masked = lambda t: F.array_distinct(terms(F.lower(F.regexp_replace(t, NUMBER, " number "))))
    same = jaccard(masked(existing), masked(incoming)) >= 0.72
    return F.coalesce((F.size(old) > 0) & (F.size(new) > 0) & (F.size(F.array_except(new, old)) > 0) & (F.rlike(incoming, F.lit(CORRECTION)) | same), F.lit(False))
