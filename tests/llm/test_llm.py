"""Training-data operators against brute force, exact round trips and known answers."""

from __future__ import annotations

import math
import os
import random
import re
import time
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bpe, contamination, near_duplicates, nearest, sentences, splitting, transcripts
from tessera.llm.words import words

VOCAB = bpe.DEFAULT_VOCAB
DATA = "/root/testdata/sf0.001"


def plain_words(text):
    text = unicodedata.normalize("NFKC", text or "").lower()
    out, cur = [], ""
    for ch in text:
        c = unicodedata.category(ch)
        if c == "Cf":
            continue
        if c[0] in "LN":
            cur += ch
        elif cur:
            out.append(cur)
            cur = ""
    return out + [cur] * bool(cur)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words_follow_the_definition(text):
    assert words(text) == plain_words(text)


# ---- 1 nearest vectors ----------------------------------------------------------------------
def test_hilbert_neighbours_touch():
    for axes, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * axes)).reshape(axes, -1).T
        order = cells[np.argsort(nearest.hilbert_index(cells, bits))]
        assert np.abs(np.diff(order, axis=0)).sum(1).max() == 1


def brute_nearest(rows, k):
    unit = {i: np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) for i, v in rows}
    return {i: [j for _, j in sorted((-round(float(a @ b), 12), j) for j, b in unit.items() if j != i)[:k]] for i, a in unit.items()}


def test_nearest_with_copies_ties_and_dirt(spark):
    rng = random.Random(1)
    good = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(100 + i, [1.0] * 8) for i in range(30)]
    good = [(i, [float(np.float32(x)) for x in v]) for i, v in good]
    bad = [(500, None), (501, [1.0]), (502, [0.0] * 8), (503, [float("nan")] * 8), (504, [None] * 8), (505, [float("inf")] * 8), (None, [1.0] * 8), good[0]]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + bad], "note_id bigint, vector array<float>, rep string")
    got: dict = {}
    for r in nearest.most_similar(df, dims=8, curves=4).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    want = brute_nearest(good, 5)
    assert set(got) == set(want)
    # Copies come before everything else, the lowest ids first.
    assert got[105] == [100, 101, 102, 103, 104] and got[100] == [101, 102, 103, 104, 105]
    hits = sum(len(set(got[i]) & set(want[i])) for i in want) / sum(map(len, want.values()))
    assert hits >= 0.99


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0] * 8)], "note_id bigint, vector array<float>")
    assert nearest.most_similar(df.limit(0), dims=8).count() == 0
    assert nearest.most_similar(df, dims=8).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_recall_on_stored_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/note_vectors.parquet")
    got: dict = {}
    for r in nearest.most_similar(df, window=64).collect():  # a window far below the table, as at larger scale
        got.setdefault(r["id"], set()).add(r["neighbour"])
    rows = {r["note_id"]: list(r["vector"]) for r in df.where(nearest.usable(F.col("vector"), 128)).collect()}
    want = brute_nearest(list(rows.items()), 5)
    assert sum(len(got[i] & set(want[i])) for i in want) / sum(map(len, want.values())) >= 0.9


def test_few_rows_of_many_hold_the_nearest():
    rng = np.random.default_rng(4)
    centres = np.repeat(rng.normal(size=(5000, 128)), 6, axis=0)  # all directions alike
    units = centres + 0.33 * rng.normal(size=centres.shape)
    units = (units / np.linalg.norm(units, axis=1, keepdims=True)).astype(np.float32)
    fitted = nearest.Curves(units[::3].astype(np.float64), nearest.CURVES, nearest.COORDINATES, nearest.BITS, nearest.DIRECTIONS, 7)
    met = np.zeros((len(units), 5), bool)
    for c in range(nearest.CURVES):
        at = np.empty(len(units), np.int64)
        at[np.argsort(fitted.keys(units, c), kind="stable")] = np.arange(len(units))
        at = at.reshape(-1, 6)
        met |= np.concatenate([np.abs(at[:, [i]] - np.delete(at, i, 1)) for i in range(6)]) <= 16  # a two-thousandth of the rows
    assert met.mean() >= 0.95


def test_windows_are_whole_across_slices(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 1)  # rows of a block share their windows
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(900, 8)).astype(np.float32))]
    df = spark.createDataFrame(rows, "note_id bigint, vector array<float>").repartition(3)
    want = {(r["id"], r["neighbour"]) for r in nearest.most_similar(df, dims=8, curves=2, window=40).collect()}
    # Without cuts: one slice holds each curve, and gives the same.
    monkeypatch.setattr(nearest, "parallelism", lambda spark: 1)
    assert {(r["id"], r["neighbour"]) for r in nearest.most_similar(df, dims=8, curves=2, window=40).collect()} == want


# ---- 2 near duplicates ----------------------------------------------------------------------
def test_parity_never_exceeds_the_difference():
    rng = random.Random(2)
    for _ in range(50):
        a = {rng.getrandbits(64) for _ in range(rng.randrange(1, 300))}
        b = set(list(a)[: rng.randrange(len(a) + 1)]) | {rng.getrandbits(64) for _ in range(rng.randrange(60))}
        bits = [near_duplicates.parity_bits(np.array(sorted(s), dtype=np.uint64), 4, 0) for s in (a, b)]
        assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= len(a ^ b)


def test_groups_match_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(40):
        base = rng.sample(vocab, rng.choice((12, 25, 60)))
        rows.append((len(rows), "t", " ".join(base)))
        for _ in range(rng.randrange(4)):
            edited = [w if rng.random() > 0.12 else rng.choice(vocab) for w in base]
            rng.shuffle(edited)
            rows.append((len(rows), "T", " ".join(edited)))
    rows += [(900 + i, None, " ".join(vocab[:30])) for i in range(6)] + [(990, None, None), (991, "", ""), rows[0]]
    df = spark.createDataFrame([(*r, 7) for r in rows], "note_id bigint, title string, body string, n int")
    pairs = {tuple(r) for r in near_duplicates.group_pairs(near_duplicates.near_groups(df, tile=16)).collect()}
    sets = {i: set(plain_words(f"{t or ''} {b or ''}")) for i, t, b in rows}
    sets = {i: s for i, s in sets.items() if len(s) >= 20}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and len(a & b) / len(a | b) >= 0.7:
                root[find(j)] = find(i)
    want = {(i, j) for i in sets for j in sets if i < j and find(i) == find(j)}
    assert pairs == want and want
    near = {i: sum(j != i and len(a & b) / len(a | b) >= 0.7 for j, b in sets.items()) for i, a in sets.items()}
    assert {r["note_id"]: r["links"] for r in near_duplicates.near_groups(df, tile=16).collect()} == {i: n for i, n in near.items() if n}
    assert {tuple(r) for r in near_duplicates.group_pairs(near_duplicates.near_groups(df), rows=2).collect()} == want
    assert near_duplicates.near_groups(df.limit(0)).count() == 0


# ---- 4 transcripts --------------------------------------------------------------------------
PEOPLE = [(1, "Ada Lovel", "Host"), (2, "Ben Carter", "Guest"), (3, "Cleo Dunn", None)]


def turns(spark, text, people=PEOPLE):
    raw = spark.createDataFrame([(1, text, "youtube", 0)], "ingest_id bigint, transcript string, source_type string, seq int")
    known = spark.createDataFrame([(1, *p) for p in people], "ingest_id bigint, speaker_no int, full_name string, role_title string")
    return [(r["speaker_no"], r["n_words"]) for r in transcripts.speaker_turns(raw, known).orderBy("turn_no").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ada Lovel: Hello the world.\nBEN: Yes uh, the (um) thing [laughs] is it.\nHost: Good.", [(1, 3), (2, 5), (1, 1)]),
        ("00:09 Ben Carter: later the one\n00:01 Ada Lovel: first the one", [(1, 3), (2, 3)]),
        ("Ada Lovel  0:01\nsome words the here\n\nCarter, Ben  0:05\nmore (about 6 beds) the", [(1, 4), (2, 5)]),
        ("&gt;&gt; Dr. Lovel: one the &gt;&gt; two the &gt;&gt; AUDIENCE: three of &gt;&gt; Q: four of", [(1, 2), (0, 2), (0, 2), (0, 2)]),
        ("WEBVTT\n\n00:01.000 --> 00:02.000\nAda Lovel: the first line<00:01.500><c> here</c>\n\n00:02.000 --> 00:03.000\nAda Lovel: the first line here\nand then more\n\n00:03.000 --> 00:04.000\nand then more\nSPEAKER_02: the end", [(1, 7), (2, 2)]),
        ("1\n00:00:05,000 --> 00:00:06,000\nBen: the second\n\n2\n00:00:01,000 --> 00:00:02,000\nAda: the first one", [(1, 3), (2, 2)]),
        ("Ada Lovl: dropped the letter\nC. Dunn: the initial\nNobody Known: the stranger", [(1, 3), (3, 2), (0, 2)]),
        ("Ada: wenn er die und der Hilfe braucht, fragt er um äh Hilfe das ist", [(1, 13)]),
        ("Ada: the mm, uh\nBen: um...\nAda: There is one rule: keep the beds", [(1, 8)]),
        ("just the words without a label", [(0, 6)]),
        ("Ben [0:04]: the ♪ soft music ♪ word <cough> *sighs* 【noise】 5 mm long", [(2, 5)]),
    ],
)
def test_turns(spark, text, want):
    assert turns(spark, text) == want


def test_turns_of_dirty_tables(spark):
    raw = spark.createDataFrame(
        [(1, None, "youtube"), (2, "", "youtube"), (3, "Ada: the word", "text"), (4, "Ada: the word", "youtube"), (4, "Ada: the word", "youtube"), (5, "[Music]", "youtube"), (None, "x", "youtube")], "ingest_id bigint, transcript string, source_type string"
    )
    none = spark.createDataFrame([], "ingest_id bigint, speaker_no int, full_name string, role_title string")
    assert [tuple(r) for r in transcripts.speaker_turns(raw, none).collect()] == [(4, 1, 0, 3)]  # nobody is known: the label is no label
    known = spark.createDataFrame([(4, 2, "Ada Bell", None), (4, 3, None, None)], "ingest_id bigint, speaker_no int, full_name string, role_title string")
    assert [tuple(r) for r in transcripts.speaker_turns(raw, known).collect()] == [(4, 1, 2, 2)]
    assert transcripts.speaker_turns(raw.limit(0), known).count() == 0


# ---- 5 splitting ----------------------------------------------------------------------------
def slow_cuts(text, limit, least, overlap):
    closers, wide = "\"'”’»)]", "」』”’）"

    def kind(p):
        before = text[:p]
        if re.search(r"\n[^\S\n]*\n$", before):
            return 1
        if before.endswith("\n"):
            return 2
        if before[-1].isspace() and before[:-1].rstrip(closers)[-1:] in tuple(".!?"):
            return 3
        if before.rstrip(wide)[-1:] in tuple("。！？") and text[p : p + 1] not in tuple(wide):
            return 3
        return 4 if before[-1].isspace() else 5

    out, start = [], 0
    while len(text) - start > limit:
        window = range(start + least + 1, start + limit + 1)
        best = min(map(kind, window))
        end = max(p for p in window if kind(p) == best)
        out.append((start, end))
        start = end - overlap
    return [*out, (start, len(text))]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n\r\"’)。」 ", min_size=30, max_size=220))
def test_windows_match_the_definition(text):
    assert splitting.cut_windows(text, 24, 12, 3) == slow_cuts(text, 24, 12, 3)


def test_landmarks_resynchronise_after_an_edit():
    rng = random.Random(6)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) + rng.choice(["", "", ".", "\n"]) for _ in range(12_000))
    edited = text[:5_000] + " inserted words here " + text[5_000:]
    cuts = [{t[a:b] for a, b in splitting.cut_landmarks(t, 2_000, 1_000, 100)} for t in (text, edited)]
    assert len(cuts[0] - cuts[1]) <= 4 and len(cuts[0]) > 20
    pieces = splitting.cut_landmarks(text, 2_000, 1_000, 100)
    assert all(b - a <= 2_000 for a, b in pieces) and pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(c == b - 100 for (_, b), (c, _) in zip(pieces, pieces[1:], strict=False))
    assert splitting.cut_landmarks("x" * 5_000, 2_000, 1_000, 100)[-1][1] == 5_000


def test_split_texts_of_dirty_rows(spark):
    df = spark.createDataFrame([(1, "a b " * 100, 5), (1, "a b " * 100, 5), (2, None, 5), (3, "", 5), (4, "short", 5)], "ingest_id bigint, transcript string, piece_no int")
    for rule in splitting.RULES:
        rows = splitting.split_texts(df, "ingest_id", "transcript", 100, 50, 10, rule).collect()
        assert {r["ingest_id"] for r in rows} == {1} and len(rows) == len(set(rows))
    assert splitting.split_texts(df.limit(0), "ingest_id", "transcript").count() == 0
    with pytest.raises(ValueError):
        splitting.split_texts(df, "ingest_id", "transcript", 10, 20, 5)


# ---- 6 tokenizer ----------------------------------------------------------------------------
TEXTS = [
    None, "", " ", "Hello world", "don't I'll we've  \n\n x\t", "<|endoftext|> [INST]", "日本語のテキスト。候诊名单", "नमस्ते दुनिया สวัสดี مرحبا", "🙂🙃 é é ﬁ №½ ‍​\xa0 ", "=" * 300, "a" * 500, "x1y22z333 1234567", "\r\n\r\n\x00\x1f\x85", "Привет, мир! " * 40,
    "=" * 5000, " " * 999 + "x", "ab" * 700, "候诊名单更新" * 500, "ไม่มีช่องว่าง" * 200, "-=" * 400, "!!!!", "Ünïcödé ſtraße",
]


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary")
def test_ids_equal_the_reference_encoder_and_decode_back(spark):
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.load_ranks(VOCAB), special_tokens={})
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x")]
    out = bpe.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"))
    got = {r["doc_id"]: list(r["ids"]) for r in out.collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    back = {r[0]: r[1] for r in out.select("doc_id", bpe.decode_ids(F.col("ids"))).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# ---- 7 contamination ------------------------------------------------------------------------
def test_leaks_match_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(5, 40)))) for i in range(20)]
    docs = []
    for i in range(80):
        text = rng.choices(vocab, k=30)
        source = items[rng.randrange(20)][1].split()
        n = rng.choice((8, 9, 10, 11, 30))
        docs.append((i, " ".join([*text, *source[:n], *text]).upper() if i % 3 else " ".join(text)))
    docs += [(900, None), (901, ""), (902, items[7][1]), docs[1]]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, tiles int")
    e = spark.createDataFrame([*items, (50, None), (51, ""), items[7]], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contamination.leaked_items(d, e).collect()}
    runs = lambda t: {tuple(w[k : k + 10]) for w in [plain_words(t)] for k in range(len(w) - 9)}
    want = {(i, j) for i, t in docs for j, u in items if runs(t) & runs(u)}
    assert got == want and want
    assert contamination.leaked_items(d.limit(0), e).count() == 0 and contamination.leaked_items(d, e.limit(0)).count() == 0


def tiled(doc, item, least=10):
    doc, item = (np.array(x, dtype=np.uint64) for x in (doc, item))
    starts = contamination.Seeds([(1, item)], least).starts(contamination.seeds_of(doc, least), doc)
    return contamination.tiles(doc, item, *starts[0], least) if starts else []


def slow_tiles(doc, item, least):
    """Marks the longest free common run again and again."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and free_d[d + n] and free_i[i + n]:
                    n += 1
                if n > best[2]:
                    best = (d, i, n)
        if best[2] < least:
            return out
        out.append(best)
        for k in range(best[2]):
            free_d[best[0] + k] = free_i[best[1] + k] = False


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(5, 7), max_size=24), st.lists(st.integers(5, 7), max_size=16))
def test_tiles_match_brute_force(doc, item):
    assert tiled(doc, item, 3) == slow_tiles(doc, item, 3)


def test_reordered_passages_add_up(spark):
    marked = tiled([*range(20, 40), 99, *range(20)], range(40))
    assert sum(m[2] for m in marked) == 40 and len(marked) == 2
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(40)))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in [*range(28, 40), *range(12, 28), *range(12)])), (2, " ".join(f"w{k}" for k in range(12)))], "doc_id bigint, text string")
    assert {r["doc_id"]: r["covered"] for r in contamination.leaked_items(docs, items, least=5).collect()} == {1: 40, 2: 12}
    assert [r["doc_id"] for r in contamination.leaked_items(docs, items, least=5, least_covered=0.5).collect()] == [1]


def test_repeated_words_stay_cheap():
    began = time.process_time()
    assert tiled([7] * 10_000, [7] * 10_000) == [(0, 0, 10_000)]
    assert sum(m[2] for m in tiled([7, 8] * 5_000, [8, 7] * 40)) == 80
    assert len(tiled([7] * 10_000, [7] * 25 + [9] + [7] * 12)) == 2
    assert time.process_time() - began < 6


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(contamination, "MAX_BLOCK_SEEDS", 30)
    texts = [" ".join(f"x{i}y{k}" for k in range(15)) for i in range(6)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contamination.leaked_items(docs, items).collect()} == {(i, i) for i in range(6)}


# ---- 8 sentences ----------------------------------------------------------------------------
MODEL = {
    "en": sentences.Learned({"dr": False, "e.g": False, "fig": False, "no": False, "a.m": True, "al": False}, {"The", "We", "It", "See"}),
    "de": sentences.Learned({"z": False, "b": False, "ca": False}, {"Die", "Eine"}, {"Juli"}),
    "fr": sentences.Learned({"m": False}, {"La", "Le"}),
}


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Lu said no to the plan.", "We met at 5.30 with J. K. Fox.", "See Fig. 3 and No. 7 in a/b.md for the rest."],
        ["It opens at 8 a.m. and the rest is of use.", "It opens at 8 a.m.", "The rest is."],
        ["“Is it for the ward?” asked the nurse.", 'The nurse wrote, "Close the ward."', "“Nothing changed in the log,” was the reply, “except the list.”"],
        ["Well... the plan was … unclear to the team.", "What is that?!", "mRNA levels of the kind rose."],
        ["La relève est-elle sûre ? La note est dans la liste.".split(" La")[0], "La note est dans la liste !", "« La note est sûre ? » demanda la reine."],
        ["Die Akte begann am 17. Juli und wurde für ca. 5 Tage geführt.", "Eine Liste, z. B. die neue, ist nicht da.", "„Ist das die Akte?“, fragte die Frau."],
        ["缺失的图谱被撤回。", "“候诊名单安全吗？”规划员问道。", "评审员写道：“请保留引文。”", "在冬季，引文迟到了！"],
        ["「監査は安全ですか。」と看護師が尋ねた。", "査読者は「残そう。」と書いた。", "増えた。"],
        ["यह सूची बदली गई।", "क्या यह सुरक्षित है?", "यह रही।"],
    ],
)
def test_sentences(parts):
    wide = any(c in parts[0] for c in "。？")
    text = ("" if wide else " ").join(parts)
    assert [text[a:b] for a, b in sentences.sentences(text, MODEL)] == parts


def test_sentence_blocks_and_missing_spaces():
    text = "# Title of the page\nThe first line of\nthe text.The second is of use.\n \n- item one. with two\n1) other\nThe end of it\n\ndef f(x):\n    return x.y\n\n   "
    got = [text[a:b] for a, b in sentences.sentences(text, MODEL)]
    assert got == ["# Title of the page", "The first line of\nthe text.", "The second is of use.", "- item one. with two", "1) other", "The end of it", "def f(x):\n    return x.y"]
    assert sentences.sentences("  \n ", MODEL) == [] and sentences.sentences("", MODEL) == []
    thai = "เพราะหน้าสรุปถูกถอน พบแบบสำรวจ 14839 รายการที่ศูนย์ คลังยาใหม่"
    assert [thai[a:b] for a, b in sentences.sentences(thai, {})] == ["เพราะหน้าสรุปถูกถอน", "พบแบบสำรวจ 14839 รายการที่ศูนย์", "คลังยาใหม่"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB .!?…\n\"“”«»()。」「-#1ก।'", max_size=120))
def test_sentences_cover_every_character(text):
    spans, at = sentences.sentences(text, MODEL), 0
    for a, b in spans:
        assert at <= a < b and not text[at:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
        at = b
    assert not text[at:].strip()


def test_abbreviations_are_learned(spark):
    rng = random.Random(9)
    names = ["".join(rng.choices("bcdfg", k=2)).title() + "".join(rng.choices("aeiou", k=3)) for _ in range(300)]
    rows = []
    for i in range(300):
        said = [f"The plan of Dr. {names[i]} was with the ward.", f"It rose in approx. {i} beds of the ward.", f"We met {names[-i]} and the rest."]
        rows.append((i, " ".join(said[i % 3 :] + said[: i % 3])))
    df = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "  "), rows[0]], "doc_id bigint, text string")
    model = sentences.models(sentences.learn(sentences.corpus_counts(df.where("length(text) > 0").select("text"))).collect())
    assert {"dr", "approx"} <= set(model["en"].abbreviations) and "ward" not in model["en"].abbreviations
    spans = sentences.sentence_spans(df)
    assert spans.count() == 900 and spans.where("doc_id >= 900").count() == 0
    assert sentences.sentence_spans(df.limit(0)).count() == 0
    # Tables too large to send give the same sentences through a join.
    assert {tuple(r) for r in sentences.sentence_spans(df, model_rows=0).collect()} == {tuple(r) for r in spans.collect()}


def test_what_is_learned_does_not_depend_on_the_size_of_the_corpus(spark):
    few = [(i, f"The ward of Prof. {n} was with the plan. It is so.") for i, n in enumerate(["Bado", "Cemi", "Difo", "Gule", "Hano", "Jipe", "Kalo", "Mure"])]
    many = [(100 + i, f"The bed number {i} was with the ward. It is of use to the plan. We have it.") for i in range(20_000)]
    for rows in (few + many[:50], few + many):
        frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        model = sentences.models(sentences.learn(sentences.corpus_counts(frame.select("text"))).collect())
        assert "prof" in model["en"].abbreviations


def test_each_block_has_its_own_language():
    text = "The plan of the ward was with the nurse and it is of use to the rest.\n\nDie Liste der Station ist nicht mit dem Plan und wurde für den Arzt am 17. Juli neu geführt.\n\nПлан был готов. Он новый."
    assert [b[3] for b in sentences.blocks_with_language(text)] == ["en", "de", "ru"]
    assert [text[a:b] for a, b in sentences.sentences(text, MODEL)][1].endswith("Juli neu geführt.")


def test_everything_together_is_registered():
    from tessera.llm import queries

    assert {"p1_found", "p2_found", "p4_found", "p5_found", "p6_ids", "p7_found", "p8_found"} <= set(queries.queries())
    assert math.isclose(near_duplicates.radius(np.array([100]), np.array([100]), 0.7)[0], 200 * 0.3 / 1.7, rel_tol=1e-6)


def test_times_after_a_long_introduction(spark):
    intro = "\n".join(["words before the"] * 45)
    timed = [f"0:{n:02} {who}: said the" for n, who in zip(range(1, 51), ["Ada", "Ben"] * 25, strict=True)]
    assert turns(spark, "\n".join([intro, timed[0], *reversed(timed[1:])])) == [(0, 135), *[(1, 2), (2, 2)] * 25]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        # Annotations, labels and hesitations of any length.
        ("Ada: one the [" + "noise from the corridor " * 10 + "] two the", [(1, 4)]),
        ("Dr. Ada Lovel, professor emerita of the department of obstetrics and of the history of medicine in the north: the first one\nBen: and two", [(1, 3), (2, 2)]),
        ("Ada: uhhhhhhh the ummmmm word (laughter continues loudly) hmmmmmm and the rest", [(1, 5)]),
        ("Ada: a lone ♪ note and ♪ soft music ♪ the rest (about 6 beds)", [(1, 9)]),
        ("Ada: the moon, vacuum and aaah of it", [(1, 7)]),
        # A timed part between a long introduction and a long rest, and a time of day at the head of a paragraph.
        ("\n".join(["words before the"] * 60 + [f"[0:{n:02}] {w}: said the" for n, w in ((3, "Ada"), (1, "Ben"), (2, "Cleo"))] + ["and after"] * 60), [(0, 180), (2, 2), (3, 122), (1, 2)]),
        ("8:30 was the hour\nthen the rest\nAda: the word", [(0, 8), (1, 2)]),
    ],
)
def test_turns_without_limits(spark, text, want):
    assert turns(spark, text) == want
