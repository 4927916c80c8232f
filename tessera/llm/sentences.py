"""Sentence boundaries across languages and scripts, with statistics learned from the corpus.

Two passes. The first counts, per language, what follows each type that ends in a period, and
which words begin sentences beyond doubt (at the head of a block, after ! or ?). Log-likelihood
ratios then decide which types are abbreviations (their period is followed by the end of a block or
a known sentence starter far less often than other periods), which words are sentence starters, and
which words collocate with a number, an initial or an abbreviation and its period. The second pass
classifies every terminator with these statistics; scripts without periods or spaces follow their own
marks. Each block of a text (what blank lines set apart) has its own language.

Counts cover all documents, and what is learned depends on ratios and fixed counts, not on the size
of the corpus. Learned tables of up to MODEL_ROWS entries are sent to the executors; beyond that each
document is joined with the entries that its own words name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, spread

LEAST_COUNT = 4
ABBREVIATION_LLR = 12.0
STARTER_LLR = 12.0
ORDINAL_LLR = 12.0
COLLOCATION_LLR = 12.0
MODEL_ROWS = 500_000  # the largest learned table that is collected and broadcast
SLICES = 16  # of a frequent word in the join beyond it
USUAL = 0.8  # how often a period closes, in a language all of whose periods belong to abbreviations
CAN_END = 0.04  # an abbreviation that closes this share of its occurrences may end a sentence

# ---- fixed values: marks and languages ------------------------------------------------------
STOPS = ".!?…。！？．｡‼⁇⁈⁉؟۔।॥።"
WIDE = "。！？｡．"  # need no white space after them
CLOSERS = "\"'”’»›」』】）)]}〕〉》“‘*_"
OPENERS = "\"'“‘„‚«‹「『【（([{〔〈《¿¡*_"
PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "‹": "›"}
DASHES = "—–-―"
SURE = ("!", "?", "؟", "।")
GO_ON = ",;:、，；：،؛"
PARTICLES = "とってがをにはもでのへやから"  # after a closing Japanese quote the sentence runs on
#: Ranges of scripts other than Latin, and their languages.
SCRIPTS = ((0x0400, 0x0530, "ru"), (0x0600, 0x0700, "ar"), (0x0900, 0x0980, "hi"), (0x0E00, 0x0E80, "th"), (0x3040, 0x3100, "ja"), (0x3400, 0xA000, "zh"))
FOREIGN = re.compile("[" + "".join(f"{chr(a)}-{chr(b - 1)}" for a, b, _ in SCRIPTS) + "]+")
EDGES = np.array([e for a, b, _ in SCRIPTS for e in (a, b)], dtype=np.uint32)
LATIN = re.compile("[A-Za-zÀ-ɏ]+")
FUNCTION_WORDS = {
    "en": frozenset("the and of was that with is by for from which had to in were or".split()),
    "de": frozenset("die der das und den von wurde ist nicht eine einen für mit im am zu".split()),
    "fr": frozenset("la le les et des une est dans sur pour par du que au aux pas de en un ce qui".split()),
    "es": frozenset("la el los las una que por con del para se al fue más como su y de en un lo".split()),
}
LANGUAGES_OF = {w: tuple(lang for lang, of in FUNCTION_WORDS.items() if w in of) for of in FUNCTION_WORDS.values() for w in of}
BREAK = re.compile(r"\r\n|\r|\n")
HEADING = re.compile(r"^[^\S\n]*#{1,6}(?=\s|$)")
ITEM = re.compile(r"^[^\S\n]*(?:[-*]|\(?\d+\))\s")
TOKEN = re.compile(r"\S+")
TECHNICAL = re.compile(r"[/\\@_=<>{}|]|\w\.\w")
PATHLIKE = re.compile(r"[^\W\d_]+[./@\\_]\w")
QUOTES = re.compile("[" + "".join(set(PAIRS) | set(PAIRS.values())) + "]")
MARKS = re.compile(f"[{re.escape(STOPS)}]+")
THAI_MARKS = re.compile(f"[{re.escape(STOPS)}]+" + r"|(?<=[฀-๿])[ \u00a0]+(?=[฀-๿])")
DASHED = re.compile(rf"[{re.escape(DASHES)}]+\s*")
THAI = re.compile("[฀-๿]")
END = "</>"
NUMBER = "##"
OWN_WORDS = 4  # function words by which a block speaks another language than its text


@dataclass
class Learned:
    """One language's statistics: abbreviations (may it end a sentence?), starters, words after ordinals, other collocations."""

    abbreviations: dict[str, bool] = field(default_factory=dict)
    starters: set[str] = field(default_factory=set)
    ordinal_next: set[str] = field(default_factory=set)
    collocations: set[tuple[str, str]] = field(default_factory=set)

    def add(self, what: str, a: str, b: str, rate: float) -> None:
        if what == "abbreviation":
            self.abbreviations[a] = rate >= CAN_END
        elif what == "collocation":
            self.collocations.add((a, b))
        else:
            (self.starters if what == "starter" else self.ordinal_next).add(a)


def _evidence(text: str) -> tuple[dict[str, int], list[str]]:
    """What speaks for languages: letters by script, Latin under "latin" (empty if all are Latin), and the function words."""
    letters = {}
    if not text.isascii() and (runs := FOREIGN.findall(text)):
        counts = np.bincount(np.searchsorted(EDGES, np.frombuffer("".join(runs).encode("utf-32-le"), dtype=np.uint32), side="right"), minlength=2 * len(SCRIPTS))
        letters = {lang: int(counts[2 * k + 1]) for k, (_, _, lang) in enumerate(SCRIPTS) if counts[2 * k + 1]}
        letters["latin"] = sum(map(len, LATIN.findall(text)))
    return letters, [w for w in text.lower().split() if w in LANGUAGES_OF]


def _decide(letters: dict[str, int], found: list[str]) -> tuple[str, int]:
    """The language, and how many of the function words are its own."""
    if letters:
        letters = dict(letters)
        if letters.get("ja", 0) * 10 > letters.get("zh", 0) > 0:
            letters["ja"] += letters.pop("zh")
        script = max(letters, key=lambda k: letters[k])
        if script != "latin":
            return script, 0
    scores = dict.fromkeys(FUNCTION_WORDS, 0)
    for w in found:
        for lang in LANGUAGES_OF[w]:
            scores[lang] += 1
    best = max(scores, key=lambda k: scores[k])
    return (best, scores[best]) if scores[best] else ("la", 0)


def language_of(text: str) -> str:
    """A script's language, or for Latin script the one whose function words are most frequent."""
    return _decide(*_evidence(text))[0]


def blocks_with_language(text: str) -> list[tuple[int, int, bool, str]]:
    """(start, end, single, language) of each block: its own language where its words or letters name one clearly, else the text's."""
    letters, found = _evidence(text)
    usual, _ = _decide(letters, found)
    own = FUNCTION_WORDS.get(usual, frozenset())
    # Only a text that shows two languages is looked at block by block.
    if len(letters) < 3 and sum(w not in own for w in found) < OWN_WORDS and not (letters and usual in FUNCTION_WORDS):
        return [(a, b, single, usual) for a, b, single in blocks(text)]
    out = []
    for a, b, single in blocks(text):
        letters, found = _evidence(text[a:b])
        best, n = _decide(letters, found)
        clear = n >= OWN_WORDS + 2 * sum(w in own for w in found) if best in FUNCTION_WORDS else best != "la"
        out.append((a, b, single, best if clear else usual))
    return out


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, single): stretches that a blank line, a heading or a list item sets apart; single: one sentence as a whole."""
    at, begin, end = 0, None, 0
    for m in [*BREAK.finditer(text), None]:
        stop, following = (m.start(), m.end()) if m else (len(text), len(text))
        line = text[at:stop]
        if not line.strip():
            if begin is not None:
                yield begin, end, False
                begin = None
        elif HEADING.match(line) or ITEM.match(line):
            if begin is not None:
                yield begin, end, False
                begin = None
            yield at, stop, True
        else:
            begin, end = at if begin is None else begin, stop
        at = following
    if begin is not None:
        yield begin, end, False


_TYPES: dict[str, tuple[str, bool]] = {}


def _type(token: str) -> tuple[str, bool]:
    """(type, ends in one period) of a token without its outer quotes; numbers are one type."""
    known = _TYPES.get(token)
    if known is not None:
        return known
    core = token.strip(OPENERS + CLOSERS).rstrip(",;:")
    dotted = core.endswith(".") and not core.endswith("..")
    core = core.rstrip(".!?…")
    found = (NUMBER, dotted) if core[:1].isdigit() else (core.lower() if dotted else core, dotted)
    if len(_TYPES) > 100_000:
        _TYPES.clear()
    if len(token) < 40:  # long tokens hardly ever come again
        _TYPES[token] = found
    return found


LETTERS = re.compile(r"[^\W\d_]+")
OPENED = re.compile(f"[{re.escape(OPENERS)}]*")


def _starts_low(text: str, at: int = 0) -> bool:
    """What begins at a place begins as the middle of a sentence does: a small letter, and not a name such as mRNA."""
    first = LETTERS.match(text, OPENED.match(text, at).end())
    return bool(first) and first[0][0].islower() and first[0] == first[0].lower()


def _bare(token: str) -> str:
    return token.strip(OPENERS + CLOSERS).rstrip(".,")


def count_text(text: str, counts: Counter) -> None:
    """Adds a text's events: (language, kind, a, b). p: periods of a type before b; s: sure starts; w: all places of a word."""
    for a, b, single, lang in blocks_with_language(text):
        if single or lang in ("zh", "ja", "th"):
            continue
        tokens = text[a:b].split()
        types = [_type(t) for t in tokens]
        words = [_bare(t) if dotted else word for t, (word, dotted) in zip(tokens, types, strict=True)]
        counts.update([(lang, "w", w, "") for w in words if w])
        last = len(tokens) - 1
        sure = [0, *(k + 1 for k, t in enumerate(tokens[:-1]) if t.rstrip(CLOSERS)[-1:] in SURE and not _starts_low(tokens[k + 1]))]
        counts.update([(lang, "s", words[k], "") for k in sure if words[k]])
        for k, (word, dotted) in enumerate(types):
            if not dotted or not word:
                continue
            follows = END
            if k < last:
                nxt, (kind, next_dotted) = tokens[k + 1], types[k + 1]
                follows = "<" if _starts_low(nxt) or nxt[0] in GO_ON + DASHES else kind or "<"
                if next_dotted and follows not in ("<", NUMBER):
                    follows = _bare(nxt)
            counts[lang, "p", word, follows] += 1


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(lang, kind, a, b, n) over all rows of texts(text): counted per batch, then added up."""
    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            cols = [*zip(*counts, strict=True)] if counts else [[], [], [], []]
            out = pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(list(counts.values()), pa.int64())], schema=schema)
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                count_text(text, counts)
            if len(counts) > 200_000:
                yield flush()
        yield flush()

    counted = texts.mapInArrow(run, "lang string, kind string, a string, b string, n bigint")
    return counted.groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))


def _ll(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of k of n events at rate p."""
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return k * F.log(p) + (n - k) * F.log(1 - p)


def _llr(k: Column, n: Column, p: Column) -> Column:
    """Twice the log-likelihood ratio of the own rate k / n against rate p."""
    return 2 * (_ll(k, n, k / n) - _ll(k, n, p))


def learn(counts: DataFrame) -> DataFrame:
    """(lang, what, a, b, rate): the statistics of each language; what is abbreviation, starter, ordinal or collocation."""
    counts = cut_lineage(counts)
    n, k = F.col("n"), F.col("k")
    of_kind = lambda kind, name: F.sum(F.when(F.col("kind") == kind, n).otherwise(0)).alias(name)
    starts = counts.where("kind in ('s', 'w')").groupBy("lang", "a").agg(of_kind("s", "k"), of_kind("w", "n"))
    totals = starts.groupBy("lang").agg(F.sum("k").alias("all_k"), F.sum("n").alias("all_n"))
    rate = F.col("all_k") / F.col("all_n")
    starters = (
        starts.join(F.broadcast(totals), "lang")  # a row for each language
        .where((k >= LEAST_COUNT) & (k / n > 2 * rate) & (_llr(k, n, rate) > STARTER_LLR) & (F.col("a") != NUMBER))
        .select("lang", "a")
    )
    starters = cut_lineage(starters)
    periods = counts.where("kind = 'p'").select("lang", "a", "b", "n").join(starters.select("lang", F.col("a").alias("b"), F.lit(True).alias("starter")), ["lang", "b"], "left")
    closes = (F.col("b") == END) | F.coalesce("starter", F.lit(False))
    types = periods.groupBy("lang", "a").agg(F.sum(F.when(closes, n).otherwise(0)).alias("k"), F.sum("n").alias("n"))
    # The usual rate is that of types whose period mostly closes; abbreviations would pull it down.
    usual = types.groupBy("lang").agg((F.sum(F.when(k * 2 > n, k)) / F.sum(F.when(k * 2 > n, n))).alias("usual"))
    judged = types.join(F.broadcast(usual.withColumn("usual", F.coalesce("usual", F.lit(USUAL)))), "lang").where(n >= LEAST_COUNT)  # a row for each language
    abbreviations = judged.where((F.col("a") != NUMBER) & (k / n < 0.75 * F.col("usual")) & (_llr(k, n, F.col("usual")) > ABBREVIATION_LLR)).select("lang", "a", (k / n).alias("rate"))
    abbreviations = cut_lineage(abbreviations)
    # Ordinals: words that follow a number's period, and not other periods.
    within = periods.where(~closes & (F.col("b") != "<") & (F.col("b") != NUMBER))
    numbered = lambda c: F.sum(F.when(F.col("a") == NUMBER, F.col(c)).otherwise(0))
    nexts = within.groupBy("lang", "b").agg(numbered("n").alias("k"), F.sum("n").alias("n"))
    base = periods.groupBy("lang").agg((numbered("n") / F.sum("n")).alias("usual"), F.sum("n").alias("all_n"))
    ordinals = nexts.join(F.broadcast(base), "lang").where((k >= LEAST_COUNT) & (k / n > 0.5) & (_llr(k, n, F.col("usual")) > ORDINAL_LLR))  # a row for each language
    # Collocations: an abbreviation or an initial whose period comes before a word more often than that word follows other periods.
    short = within.where(F.col("a") != NUMBER).join(abbreviations.select("lang", "a", F.lit(True).alias("short")), ["lang", "a"], "left").where("short or length(a) = 1")
    after = periods.groupBy("lang", "b").agg(F.sum("n").alias("of_b"))
    pairs = short.select("lang", "a", "b", "n").where(n >= LEAST_COUNT).join(types.select("lang", "a", F.col("n").alias("of_a")), ["lang", "a"]).join(after, ["lang", "b"]).join(F.broadcast(base.select("lang", "all_n")), "lang")
    chance = F.col("of_b") / F.col("all_n")
    collocations = pairs.where((n / F.col("of_a") > chance) & (_llr(n, F.col("of_a"), chance) > COLLOCATION_LLR))
    text, none, zero = lambda what: F.lit(what).alias("what"), F.lit("").alias("b"), F.lit(0.0).alias("rate")
    return (
        abbreviations.select("lang", text("abbreviation"), "a", none, "rate")
        .unionByName(starters.select("lang", text("starter"), "a", none, zero))
        .unionByName(ordinals.select("lang", text("ordinal"), F.col("b").alias("a"), none, zero))
        .unionByName(collocations.select("lang", text("collocation"), "a", "b", zero))
    )


def models(rows) -> dict[str, Learned]:
    """Learned statistics by language, from rows of learn()."""
    out: dict[str, Learned] = {}
    for row in rows:
        out.setdefault(row["lang"], Learned()).add(row["what"], row["a"], row["b"], row["rate"])
    return out


def named_types(text: str) -> set[tuple[str, str]]:
    """(language, type) of all that a text can ask the learned tables: types with a period and the words after any."""
    out = set()
    for a, b, single, lang in blocks_with_language(text):
        if single:
            continue
        tokens = text[a:b].split()
        for k, token in enumerate(tokens):
            if any(c in STOPS for c in token):
                # A stop may stand inside a token too, where a space is missing.
                parts = [p for p in re.split(f"(?<=[{re.escape(STOPS)}])", token) if p] + tokens[k + 1 : k + 2]
                out.update((lang, t) for p in parts for t in (_type(p)[0], _type(p.rstrip(CLOSERS + STOPS) + ".")[0], _bare(p), _type(token)[0], _type(token.rstrip(CLOSERS + STOPS) + ".")[0]))
    return out


def _word_before(text: str, at: int, low: int) -> str:
    """The run of non-space characters before position at, without opening marks."""
    k = at
    while k > low and not text[k - 1].isspace():
        k -= 1
    return text[k:at].lstrip(OPENERS + DASHES)


def _period_ends(text: str, at: int, nxt: int, low: int, high: int, spaced: bool, quoted: bool, known: Learned) -> bool:
    """Whether the single period at `at` ends a sentence; nxt: where the next text begins."""
    word = _word_before(text, at, low)
    m = TOKEN.match(text, nxt, high)
    following = m[0] if m else ""
    bare = following.lstrip(OPENERS)
    if not spaced:
        if quoted:
            return not _starts_low(following)
        # A missing space: a word, its period, and the capital or opening mark of the next sentence.
        if TECHNICAL.search(word) or _type(word + ".")[0] in known.abbreviations:
            return False
        if following[:1] in "“„«‹「『¿¡":
            return True
        head = LETTERS.match(bare)
        return bool(head) and len(word) > 1 and word[-1].isalnum() and not word[-2:].isupper() and head[0][0].isupper() and (len(head[0]) == 1 or not head[0].isupper()) and not PATHLIKE.match(bare)
    if _starts_low(following):
        return False
    kind, _ = _type(word + ".")
    first, first_dotted = _type(following)
    if first_dotted:
        first = following.strip(OPENERS + CLOSERS).rstrip(".,")
    starter = first in known.starters
    if kind == NUMBER:
        return first not in known.ordinal_next
    if (kind, first) in known.collocations:
        return False
    if len(kind) == 1 and kind.isalpha() and word[-1:].isupper() and not (starter and not first_dotted):
        return False
    if kind in known.abbreviations:
        if first == NUMBER:
            return False
        return starter or known.abbreviations[kind]
    if "." in kind and len(kind.replace(".", "")) <= 3 and kind.replace(".", "").isalpha():
        return starter  # dotted letters that were too rare to learn
    return True


def _wide_runs_on(text: str, sentence: int, mark: int, after: int, high: int) -> bool:
    """Whether speech closed by a quote goes on: a particle follows, or the sentence began with the quote and its speaker follows."""
    if after >= high or after == mark + 1:
        return False
    nxt = text[after]
    if nxt in GO_ON:
        return True
    if text[after - 1] in "」』":
        return nxt in PARTICLES
    return text[sentence] in "“‘\"「『" and text[after - 1] in "”’\"" and nxt.isalnum()


def split_block(text: str, low: int, high: int, known: Learned, thai: bool) -> Iterator[tuple[int, int]]:
    """Sentence spans of one block of running text."""
    start = low
    while start < high and text[start].isspace():
        start += 1
    inside: dict[int, int] = {}  # a paired quote's inner places up to the place of its closing mark
    stack: list[tuple[str, int]] = []
    for m in QUOTES.finditer(text, low, high):
        if stack and m[0] == PAIRS[stack[-1][0]]:
            opened = stack.pop()[1]
            if not stack:
                inside[opened] = m.start()
        elif m[0] in PAIRS:
            stack.append((m[0], m.start()))
    spans = sorted(inside.items())
    marks = THAI_MARKS if thai else MARKS
    at, straight, counted = low, 0, low
    k = 0
    while m := marks.search(text, at, high):
        a, b = m.span()
        at = b
        if a <= start and text[a].isspace():
            continue
        if text[a].isspace():  # Thai: a space between words of the script
            yield start, a
            start = b
            continue
        straight += text.count('"', counted, b)
        counted = b
        after = b
        while after < high and (text[after] in CLOSERS or (text[after] in "   " and text[after + 1 : after + 2] in ("»", "›") and after + 1 < high)):
            c = text[after]
            if c == '"' and straight % 2 == 0 and (after == b or text[after - 1] != " "):
                break  # it opens the next sentence
            if c in "“‘" and not _closes(text, after, low):
                break
            straight += c == '"'
            after += 1
        counted = after
        at = max(at, after)
        while k < len(spans) and spans[k][1] < a:
            k += 1
        if k < len(spans) and spans[k][0] < a and spans[k][1] >= after:
            continue  # inside a quotation that goes on
        if after >= high:
            break
        nxt = after
        while nxt < high and text[nxt].isspace():
            nxt += 1
        if nxt >= high:
            break
        run, spaced, quoted = m[0], nxt > after, after > b
        if any(c in WIDE for c in run):
            ends = not _wide_runs_on(text, start, b - 1, after, high)
        elif text[nxt] in GO_ON:
            ends = False
        elif text[nxt] in DASHES and spaced and (n := DASHED.match(text, nxt, high)) and _starts_low(text, n.end()):
            ends = False
        elif run[-1] == "…" or (set(run) == {"."} and len(run) > 1):
            ends = spaced and not _starts_low(text, nxt) and (quoted or _type(TOKEN.match(text, nxt)[0])[0] in known.starters)
        elif run == ".":
            ends = _period_ends(text, a, nxt, low, high, spaced, quoted, known)
        else:
            after_mark = text[nxt]
            ends = not _starts_low(text, nxt) if spaced or quoted else not (after_mark.islower() or after_mark.isdigit() or after_mark in "=&/\\#%")
        if ends:
            yield start, after
            start = at = nxt
    while high > start and text[high - 1].isspace():
        high -= 1
    if high > start:
        yield start, high


def _closes(text: str, at: int, low: int) -> bool:
    """Whether “ or ‘ closes a quotation that „ or ‚ opened."""
    opener = {"“": "„", "‘": "‚"}[text[at]]
    opened = text.rfind(opener, low, at)
    return opened >= 0 and text.find(text[at], opened, at) < 0


NOTHING = Learned()


def sentences(text: str, model: dict[str, Learned]) -> list[tuple[int, int]]:
    """(start, end) of every sentence, without white space around it."""
    if not text or not text.strip():
        return []
    out = []
    for a, b, single, lang in blocks_with_language(text):
        if single:
            piece = text[a:b]
            out.append((a + len(piece) - len(piece.lstrip()), a + len(piece.rstrip())))
        else:
            out += split_block(text, a, b, model.get(lang) or NOTHING, bool(THAI.search(text, a, b)))
    return out


def _with_entries(rows: DataFrame, learned: DataFrame) -> DataFrame:
    """rows(_id, _text) with `entries`: the learned rows that a text's own words name. The table of a frequent word is repeated over slices."""
    schema = pa.schema([("_id", pa.int64()), ("lang", pa.string()), ("a", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(key, lang, a) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for lang, a in named_types(text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [[]] * 3, schema, strict=True)], schema=schema)

    asked = rows.mapInArrow(run, "_id bigint, lang string, a string").withColumn("slice", F.pmod(F.xxhash64("_id"), F.lit(SLICES)))
    table = learned.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SLICES - 1).cast("bigint"))))
    held = asked.join(table, ["lang", "a", "slice"]).groupBy("_id").agg(F.collect_set(F.struct("lang", "what", "a", "b", "rate")).alias("entries"))
    return rows.join(held, "_id", "left").select("_id", "_text", "entries")


def sentence_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_rows: int = MODEL_ROWS) -> DataFrame:
    """(id_col, start_char, end_char), a row for every sentence of every document.

    Null, empty and blank texts give no row. Repeated rows count once; of an id with several texts
    the one with the smallest hash counts. The language column is not asked for: it may be null or
    wrong, so a block's own script and function words decide.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text") > 0)
    rows = spread(rows, "_id")
    learned = cut_lineage(learn(corpus_counts(rows.select("_text"))))
    schema = pa.schema([("_id", pa.int64()), ("at", pa.int64()), ("spans", pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32())])))])
    shared = docs.sparkSession.sparkContext.broadcast(models(learned.collect())) if learned.count() <= model_rows else None
    if shared is None:
        rows = _with_entries(rows, learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, hashes = [], []
            own = batch.column(2).to_pylist() if shared is None else None
            for k, text in enumerate(batch.column(1).to_pylist()):
                model = shared.value if own is None else models(own[k] or ())
                spans.append([{"start_char": a, "end_char": b} for a, b in sentences(text, model)])
                hashes.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.int64()), pa.array(spans, schema.field("spans").type)], schema=schema)

    cut = rows.mapInArrow(run, "_id bigint, at bigint, spans array<struct<start_char:int,end_char:int>>")
    once = cut.groupBy("_id").agg(F.min_by("spans", "at").alias("spans"))
    return once.select(F.col("_id").alias(id_col), F.explode("spans").alias("s")).select(id_col, "s.start_char", "s.end_char")
