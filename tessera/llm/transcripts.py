"""Raw speech transcripts into clean, ordered speaker turns.

An Aho-Corasick automaton finds hesitation sounds and sound annotations, another one, built from
the people known to take part, finds their labels. Context rules settle what a match means (the
language, word borders, brackets, numbers before a unit), the matched intervals are subtracted
from the text, and what is left is counted. Spark windows then order the pieces by time, join
neighbours of one speaker and number the turns.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.words import WORD, normalised
from tessera.session import parallelism

# ---- fixed values -------------------------------------------------------------------------
#: Sounds that mean nothing in any of the languages, and those that do so in one language only.
HESITATIONS = ("uh", "uhh", "uhhh", "uhm", "uhmm", "umm", "ummm", "erm", "ermm", "hm", "hmm", "hmmm", "mm", "mmm", "mmh", "äh", "ähh", "ähm", "ähmm", "öh", "öhm", "euh", "euhh", "euhm", "ehm")
HESITATIONS_OF = {"en": ("um", "er", "err", "errr"), "de": (), "fr": ("heu", "hum", "hem", "beuh"), "es": ("em", "eeh"), "": ("um", "er", "heu", "hum")}
#: Words of sound annotations in round brackets or between notes; square brackets always hold one.
SOUNDS = (
    "laughter", "laughs", "laughing", "laugh", "chuckles", "cough", "coughs", "coughing", "sighs", "sigh", "applause", "music", "noise", "door closes", "door opens",
    "inaudible", "unintelligible", "crosstalk", "silence", "pause", "clears throat", "sniffs", "cheering", "soft music", "music playing", "phone rings", "knocking", "whispers",
    "lachen", "lacht", "husten", "hustet", "seufzt", "beifall", "applaus", "musik", "unverständlich", "rires", "rire", "toux", "tousse", "soupir", "applaudissements", "musique", "bruit",
    "risas", "aplausos", "tos", "música", "ruido",
)
#: Labels that name nobody in particular.
NOBODY = (
    "q", "a", "audience", "audience member", "unknown", "unknown speaker", "unidentified", "unidentified speaker", "voice from the room", "voice", "man", "woman", "male speaker", "female speaker",
    "participant", "all", "everyone", "narrator", "operator", "speaker", "question", "answer", "publikum", "unbekannt", "public", "inconnu",
)
STOPWORDS = {
    "en": ("the", "and", "of", "was", "that", "you", "with", "is", "by", "has"),
    "de": ("die", "der", "das", "und", "wir", "ist", "nicht", "eine", "den", "wurde"),
    "fr": ("la", "le", "les", "et", "une", "que", "pas", "des", "est", "été"),
    "es": ("el", "los", "las", "una", "que", "por", "con", "del", "fue", "y"),
}
TITLES = ("dr", "prof", "mr", "mrs", "ms", "herr", "frau", "mme", "m", "sr", "sra")
# ---- layouts ------------------------------------------------------------------------------
TIME = r"(?:\d{1,3}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?"
CUE = re.compile(rf"^\s*({TIME})\s*-->\s*{TIME}")
LEADING = re.compile(rf"^\s*(?:\[({TIME})\]|\(({TIME})\)|({TIME}))[\s:\-–]+(?=\S)(.*)$", re.S)
INNER = re.compile(rf"^\s*([^\s:\[\]()][^:\[\]()\n]*(?:\([^()\d]+\))?)\s*[\[(]({TIME})[\])]\s*:?\s*(.*)$", re.S)
HEADER = re.compile(rf"^\s*(\S.*?)\s+[\[(]?({TIME})[\])]?\s*$")
LABEL = re.compile(r"^\s*([^:\n<>]+):(?:\s+|$)(.*)$", re.S)
CHANGE = re.compile(r"(?:^|(?<=\s))>>+\s*")
DASH = re.compile(r"^\s*[-–—]\s+(?=\S)")
VOICE = re.compile(r"<v(?:\.[^\s>]*)?\s+([^>]*)>")
TAG = re.compile(r"</?(?:c|i|b|u|v|lang|ruby|rt|font)\b[^>]*>|<\d[\d:.,]*>", re.I)
BRACKETS = re.compile(r"\[[^\[\]]*\]|【[^【】]*】|［[^［］]*］|<(?=[^\W\d_]|/)[^<>]*>|\*(?=\S)[^*\n]+(?<=\S)\*")
ROUND = re.compile(r"[(（]([^()（）]+)[)）]")
NOTE = re.compile("[♪♫]")
STAMP = re.compile(TIME)
DRAWN_OUT = re.compile(r"([^\W\d_])\1{2,}")
NUMBERED = re.compile(r"^(?:speaker|sprecher|sprecherin|locuteur|locutrice|intervenant|hablante|spk|s)[\s_#.\-]*0*(\d{1,4})$")


@lru_cache(maxsize=8)
def _automaton(lang: str) -> ahocorasick.Automaton:
    """Hesitations of a language and sound annotations."""
    found = ahocorasick.Automaton()
    for sound in SOUNDS:
        found.add_word(sound, ("sound", len(sound)))
    for word in HESITATIONS + HESITATIONS_OF.get(lang, ()):
        found.add_word(word, ("hesitation", len(word)))
    found.make_automaton()
    return found


def guess_language(text: str) -> str:
    """The language whose function words are most frequent; '' if there are none."""
    counts: dict[str, int] = {}
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        counts[w] = counts.get(w, 0) + 1
    scores = {lang: sum(counts.get(w, 0) for w in of) for lang, of in STOPWORDS.items()}
    best = max(scores, key=lambda k: scores[k])
    return best if scores[best] else ""


def _seconds(stamp: str) -> float:
    total = 0.0
    for part in stamp.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def _same_length_lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _subtract(text: str, spans: list[tuple[int, int]]) -> str:
    """text with a space in place of each interval; intervals may overlap."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a > at:
            out += [text[at:a], " "]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _matches(low: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the automaton finds; a letter drawn out (uhhhhh) counts as written twice."""
    if not DRAWN_OUT.search(low):
        return [(end - n + 1, end + 1, kind) for end, (kind, n) in automaton.iter(low)]
    kept = [k for k, c in enumerate(low) if not (k > 1 and c == low[k - 1] == low[k - 2] and c.isalpha())]
    squeezed, ends = "".join(low[k] for k in kept), [*(k for k in kept[1:]), len(low)]
    return [(kept[end - n + 1], ends[end], kind) for end, (kind, n) in automaton.iter(squeezed)]


def count_words(text: str, lang: str) -> int:
    """Words said in a piece of transcript without its labels: annotations and hesitations don't count."""
    text = BRACKETS.sub(" ", text)
    low = _same_length_lower(text)
    matches = _matches(low, _automaton(lang))
    border = lambda a, b: not (a and (low[a - 1].isalnum() or low[a - 1] in "'’")) and not (b < len(low) and (low[b].isalnum() or low[b] in "'’"))
    whole = [(a, b, kind) for a, b, kind in matches if border(a, b)]
    sounds = [(a, b) for a, b, kind in whole if kind == "sound"]
    spans: list[tuple[int, int]] = []
    def annotation(start: int, end: int) -> bool:
        """Begins or ends with a sound and has no number but times: "(about 6 beds)" and a lone note in speech stay."""
        inside = [(a, b) for a, b in sounds if start <= a and b <= end]
        return any(not WORD.search(text[start:a]) or not WORD.search(text[b:end]) for a, b in inside) and not re.search(r"\d", STAMP.sub("", text[start:end]))

    spans += [m.span() for m in ROUND.finditer(text) if annotation(*m.span(1))]
    notes = [m.start() for m in NOTE.finditer(text)]
    k = 0
    while k + 1 < len(notes):  # a note that stands alone opens nothing
        if paired := annotation(notes[k] + 1, notes[k + 1]):
            spans.append((notes[k], notes[k + 1] + 1))
        k += 1 + paired
    for a, b, kind in whole:
        if kind != "hesitation":
            continue
        raw = text[a:b]
        joined = (a > 1 and low[a - 1] in "-‐" and low[a - 2].isalnum()) or (b + 1 < len(low) and low[b] in "-‐" and low[b + 1].isalnum())
        unit = raw == "mm" and re.search(r"\d\s?$", text[:a][-3:])
        acronym = len(raw) == 2 and raw.isupper() and raw.isascii()
        if not (joined or unit or acronym):
            spans.append((a, b))
    return len(WORD.findall(normalised(_subtract(text, spans))))


def _within_one_edit(a: str, b: str) -> bool:
    """Equal but for one letter lost, added, changed, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    x, y = a[k:], b[k:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def _plain(label: str) -> str:
    return " ".join(normalised(label).replace("_", " ").split())


class People:
    """The people of a transcript and the ways in which a label can name them."""

    def __init__(self, people: list[tuple[int, str | None, str | None]]):
        self.numbers = {no for no, _, _ in people}
        self.names = [(no, _plain(name or "").split()) for no, name, _ in people]
        forms: dict[str, set[int]] = {}
        self.roles: dict[str, set[int]] = {}
        for no, name, role in people:
            parts = _plain(name or "").split()
            if role and _plain(role):
                self.roles.setdefault(_plain(role), set()).add(no)
            if not parts:
                continue
            first, last = parts[0], parts[-1]
            ways = [" ".join(parts), last, first, "".join(p[0] for p in parts), ".".join(p[0] for p in parts) + "."]
            ways += [f"{last}, {' '.join(parts[:-1])}", f"{last} {' '.join(parts[:-1])}", f"{first[0]}. {last}", f"{first[0]} {last}", f"{first} {last[0]}.", f"{first} {last[0]}", f"{last}, {first[0]}."]
            ways += [f"{t}{dot} {rest}" for t in TITLES for dot in ("", ".") for rest in (last, " ".join(parts))]
            for way in ways if len(parts) > 1 else (" ".join(parts),):
                forms.setdefault(way, set()).add(no)
        self.forms = forms
        self.known = ahocorasick.Automaton()
        for way, who in {**forms, **{r: w for r, w in self.roles.items() if r not in forms}}.items():
            self.known.add_word(way, (len(way), frozenset(who)))
        for label in NOBODY:
            if label not in self.known:
                self.known.add_word(label, (len(label), frozenset()))
        self.known.make_automaton()
        self.cache: dict[str, int | None] = {}

    def who(self, label: str) -> int | None:
        """speaker_no; 0 for a label that means none of them; None if it doesn't look like a label."""
        if label not in self.cache:
            self.cache[label] = self._who(label)
        return self.cache[label]

    def _who(self, label: str) -> int | None:
        plain = _plain(label).strip(" .,;-–—")
        if not plain:
            return None
        if m := NUMBERED.match(plain):
            return int(m[1]) if int(m[1]) in self.numbers else 0
        bare = re.sub(r"\s*[(\[][^()\[\]]*[)\]]", "", plain).strip(" .,;-–—") or plain
        for text in dict.fromkeys((plain, bare)):
            for end, (length, people) in self.known.iter(text):
                if end == len(text) - 1 and length == len(text):
                    return next(iter(people)) if len(people) == 1 else 0
        if bare != plain and (m := NUMBERED.match(bare)):
            return int(m[1]) if int(m[1]) in self.numbers else 0
        # A full name and what its bearer is: "Dr. Ann Bee, head of the ward".
        if (m := re.match(r"([^,(–—]*\s[^,(–—]*?)\s*[,(–—]", bare)) and len(who := self.forms.get(m[1].strip(), ())) == 1:
            return next(iter(who))
        loose = re.sub(rf"^(?:{'|'.join(TITLES)})\.?\s+", "", bare).replace(".", "").replace(",", "")
        near = {no for way, who in self.forms.items() for no in who if len(way) > 3 and _within_one_edit(loose, way.replace(".", "").replace(",", ""))}
        if len(near) == 1:
            return near.pop()
        if near:
            return 0
        # A name that is nobody's: two or three capitalised words, or one in capitals.
        raw = re.sub(r"\s*[(\[][^()\[\]]*[)\]]", "", label).strip()
        if re.fullmatch(r"[A-ZÀ-Þ]{3,}|(?:[^\W\d_a-zß-ÿ][\w'’\-]*\.?,?\s+){1,2}[^\W\d_a-zß-ÿ][\w'’\-]*", raw) and not re.search(r"[.!?]\s*$", raw[:-1]):
            return 0
        return None


def _clean_line(line: str) -> str:
    return html.unescape(TAG.sub("", line)).replace("\u200b", "").strip()


def _cues(lines: list[str]) -> list[tuple[float, str | None, str]]:
    """(start, voice, line) of caption cues in time order, a line shown again directly after itself once."""
    cues: list[tuple[float, int, list[str]]] = []
    current: list[str] | None = None
    for n, line in enumerate(lines):
        if m := CUE.match(line):
            current = []
            cues.append((_seconds(m[1]), n, current))
        elif not line.strip():
            current = None
        elif current is not None and not (line.strip().isdigit() and n + 1 < len(lines) and CUE.match(lines[n + 1])):
            current.append(line)
    out: list[tuple[float, str | None, str]] = []
    last: tuple[str | None, str] | None = None
    for start, _, body in sorted(cues, key=lambda c: (c[0], c[1])):
        voice = None
        for line in body:
            at = 0
            parts: list[tuple[str | None, str]] = []
            for m in VOICE.finditer(line):
                parts.append((voice, line[at : m.start()]))
                voice, at = html.unescape(m[1]).strip(), m.end()
            parts.append((voice, line[at:]))
            for who, text in parts:
                text = _clean_line(text)
                if text and (who, text) != last:
                    out.append((start, who, text))
                    last = (who, text)
    return out


def _densest(marked: list[bool]) -> int:
    """The largest surplus of marked over other lines in any stretch of lines."""
    best = here = 0
    for m in marked:
        here = max(0, here + (1 if m else -1))
        best = max(best, here)
    return best


def pieces(transcript: str, people: People) -> list[tuple[float | None, int, str]]:
    """(time, speaker_no, text) of each marked turn, in the order written (captions: shown)."""
    lines = re.split(r"\r\n|\r|\n", transcript.lstrip("\ufeff"))
    turns: list[list] = []

    def start(time: float | None, who: int | None) -> None:
        turns.append([time, who or 0, []])

    def say(text: str) -> None:
        if text:
            if not turns:
                start(None, 0)
            turns[-1][2].append(text)

    def labelled(text: str, time: float | None) -> bool:
        """Starts a turn if text begins with a label."""
        if (m := LABEL.match(text)) and (who := people.who(m[1].strip())) is not None:
            start(time, who)
            say(m[2].strip())
            return True
        return False

    def spoken(text: str, time: float | None, forced: bool = False) -> None:
        """Text that may hold changes of speaker (>>) and may begin with a label; forced: a turn starts here anyway."""
        parts = CHANGE.split(text)
        for k, part in enumerate(parts):
            part = part.strip()
            if k == 0 and not part and len(parts) > 1:
                continue
            marked = forced or k > 0
            if k == 0 and not forced and DASH.match(part) and dashed:
                part, marked = DASH.sub("", part), True
            if not labelled(part, time):
                if marked:
                    start(time, 0)
                say(part)

    dashed = sum(bool(DASH.match(x)) for x in lines) >= 2
    if any(CUE.match(x) for x in lines):
        voice = None
        for time, who, text in _cues(lines):
            if who is not None and who != voice:
                start(time, people.who(who) or 0)
            voice = who
            spoken(text, time)
        return [(t, who, " ".join(text)) for t, who, text in turns]
    body = [x for x in (_clean_line(line) for line in lines) if x]
    stamped = [bool(LEADING.match(x)) for x in body]
    leading = sum(stamped)
    inner = sum(bool((m := INNER.match(x)) and people.who(m[1].strip()) is not None) for x in body)
    headers = sum(bool((m := HEADER.match(x)) and people.who(m[1]) is not None) for x in body)
    if 2 * leading < len(body) and _densest(stamped) < 3:  # a paragraph may begin with a time of day
        leading = 0
    top = max(leading, inner, headers)
    for line in body:
        if top and headers == top and (m := HEADER.match(line)) and (who := people.who(m[1])) is not None:
            start(_seconds(m[2]), who)
        elif top and inner == top and (m := INNER.match(line)) and (who := people.who(m[1].strip())) is not None:
            start(_seconds(m[2]), who)
            say(m[3].strip())
        elif top and leading == top and headers < top and inner < top and (m := LEADING.match(line)):
            spoken(m[4], _seconds(m[1] or m[2] or m[3]), forced=True)
        else:
            spoken(line, turns[-1][0] if turns else None)
    return [(t, who, " ".join(text)) for t, who, text in turns]


def speaker_turns(results: DataFrame, speakers: DataFrame) -> DataFrame:
    """(ingest_id, turn_no, speaker_no, n_words) of non-empty transcripts of source_type youtube.

    Turns are ordered by their times, else as written; one without words is dropped; then
    neighbours of one known speaker are one turn. A label that names nobody of the transcript's
    people, or more than one of them, is speaker 0. Repeated rows count once; null and empty
    transcripts give no row; transcripts without people give turns of speaker 0; other columns are ignored.
    """
    raw = results.where((F.col("source_type") == "youtube") & (F.length("transcript") > 0) & F.col("ingest_id").isNotNull()).select("ingest_id", "transcript")
    # Copies of a row are told apart by a hash; the long text itself is carried once.
    raw = raw.repartition(parallelism(results.sparkSession), "ingest_id").groupBy("ingest_id").agg(F.min_by("transcript", F.xxhash64("transcript")).alias("transcript"))
    known = speakers.where("ingest_id is not null and speaker_no is not null").groupBy("ingest_id").agg(F.array_sort(F.collect_set(F.struct("speaker_no", "full_name", "role_title"))).alias("people"))
    schema = pa.schema([("ingest_id", pa.int64()), ("seq", pa.int32()), ("time", pa.float64()), ("speaker_no", pa.int32()), ("n_words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text, people in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lang = guess_language(TAG.sub("", text))
                found = pieces(text, People([(p["speaker_no"], p["full_name"], p["role_title"]) for p in people or []]))
                timed = [t for t, _, _ in found if t is not None]
                for seq, (time, who, said) in enumerate(found):
                    if n := count_words(said, lang):
                        out.append((key, seq, time if time is not None else (min(timed) if timed else 0.0), who, n))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)

    said = raw.join(known, "ingest_id", "left").mapInArrow(run, "ingest_id bigint, seq int, time double, speaker_no int, n_words int")
    order = Window.partitionBy("ingest_id").orderBy("time", "seq")
    changed = (F.col("speaker_no") == 0) | ~F.col("speaker_no").eqNullSafe(F.lag("speaker_no").over(order))
    numbered = said.withColumn("turn_no", F.sum(F.when(changed, 1).otherwise(0)).over(order).cast("int"))
    return numbered.groupBy("ingest_id", "turn_no", "speaker_no").agg(F.sum("n_words").cast("int").alias("n_words"))
