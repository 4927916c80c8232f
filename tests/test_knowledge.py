"""Duplicates, discovery, lint, orphans and components."""

import datetime as dt
import random
import re
from dataclasses import replace

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import discovery, duplicates, lint, orphans
from tessera.operators.components import connected_components

NOTE = "note_id bigint, title string, body string"


def test_number_sets_and_conflicts(spark):
    rows = [("costs 1,000 or 5.0% and +5, -0.50", "1000 5% 5 -0.5"), ("none", ""), (None, None), ("007 v2.1", "7 2.1")]
    for text, want in rows:
        got = spark.createDataFrame([(text,)], "t string").select(T.number_set(F.col("t"))).first()[0]
        assert got == (None if want is None else want.split())
    pair = spark.createDataFrame([("stay was 5 days", "6.5 days rather than 5 days"), ("stay 5", "other words 5"), (None, "5")], "a string, b string")
    assert [r[0] for r in pair.select(T.numeric_conflict(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_strongest_duplicate_and_safeguards(spark):
    existing = spark.createDataFrame([(7, "Length of stay", "Stay was 5 days on the ward"), (8, "Clinical escalation protocol", "Call early"), (9, "Unrelated", "Other things")], NOTE)
    new = spark.createDataFrame([(100, "Length of stay", "Stay was 6.5 days rather than 5 days"), (101, "Clinical escalation protocols", "Ask for help"), (102, "Nothing like it", "Plain")], NOTE)
    scores = duplicates.duplicate_scores(new, existing)
    best = duplicates.strongest_duplicate(scores)
    assert {(r["incoming_id"], r["existing_id"]) for r in best.collect()} == {(100, 7), (101, 8)}
    said = spark.createDataFrame([(100, "new", None), (101, "merge", 7), (102, "new", None)], "incoming_id bigint, action string, existing_id bigint")
    got = {r["incoming_id"]: (r["action"], r["existing_id"]) for r in duplicates.safeguarded(said, best, existing.union(new)).collect()}
    assert got == {100: ("contradict", 7), 101: ("merge", 8), 102: ("new", None)}


def test_duplicates_of_tiles_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "TILE", 16)
    monkeypatch.setattr(duplicates, "CHUNK", 7)
    rng = random.Random(2)
    words = [f"word{i}" for i in range(40)]
    rows = [(0, None, None), (1, "", ""), (2, "ab", "x")]
    for i in range(3, 90):
        body = rng.sample(words, 30) if i % 3 else rows[i - 1][2].split() + ["more"] if rows[i - 1][2] else ["x"]
        rows.append((i, f"The {rng.choice(words)} of {rng.choice(words)} and {'others' if i % 2 else 'other'} than those", " ".join(body)))
    frame = spark.createDataFrame(rows + rows[::4], "note_id bigint, title string, body string")
    got = [tuple(r) for r in duplicates.duplicate_scores(frame.where("note_id % 2 = 0"), frame).collect()]
    key = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    grams = lambda k: {k[i : i + 3] for i in range(len(k) - 2)} if len(k) >= 3 else {k} - {""}
    want = {}
    for a, ta, ba in rows[::2]:
        for b, tb, bb in rows:
            g, h, x, y = grams(key(ta)), grams(key(tb)), set((ba or "").split()), set((bb or "").split())
            dice, jaccard = (2 * len(g & h) / (len(g) + len(h)) if g and h else 0), (len(x & y) / len(x | y) if x and y else 0)
            score = 4 if key(ta) == key(tb) else 3 + dice if dice >= 0.88 else 2 + jaccard if jaccard >= 0.88 else 0
            if score and a != b:
                want[a, b] = round(score, 9)
    assert {(a, b): round(s, 9) for a, b, s in got} == want and len(got) == len(want)
    assert {int(s) for s in want.values()} == {2, 3, 4}


def test_close_rivals_are_no_duplicate(spark):
    existing = spark.createDataFrame([(1, "ward round checklist a", ""), (2, "ward round checklist b", "")], NOTE)
    new = spark.createDataFrame([(10, "ward round checklist c", "")], NOTE)
    assert duplicates.strongest_duplicate(duplicates.duplicate_scores(new, existing)).count() == 0


def test_prefix_joins_lose_no_pair(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.sample(words, 3)), " ".join(rng.sample(words, 12))) for i in range(60)]
    rows += [(100 + i, t[:-1] + "x", b + " extra") for i, t, b in rows[:20]]
    df = spark.createDataFrame(rows, NOTE)
    got = {(r[0], r[1]): round(r[2], 9) for r in duplicates.duplicate_scores(df, df).collect()}
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    want = {}
    for i, t, b in rows:
        for j, u, c in rows:
            if i == j:
                continue
            g, h, x, y = grams(t), grams(u), set(b.split()), set(c.split())
            dice, jac = 2 * len(g & h) / (len(g) + len(h)), len(x & y) / len(x | y)
            score = 4 if t == u else 3 + dice if dice >= 0.88 else 2 + jac if jac >= 0.88 else None
            if score:
                want[i, j] = round(score, 9)
    assert got == want


def test_restaging_keeps_the_status(spark):
    old = spark.createDataFrame([("a", 1, 0.5, "reviewed"), ("b", 1, 0.4, "queued")], "fingerprint string, generation int, score double, status string")
    new = spark.createDataFrame([("a", 0.9), ("c", 0.3)], "fingerprint string, score double")
    got = {r["fingerprint"]: (r["generation"], r["score"], r["status"]) for r in discovery.restage(old, new, 2).collect()}
    assert got == {"a": (2, 0.9, "reviewed"), "b": (1, 0.4, "queued"), "c": (2, 0.3, "queued")}


def test_guarded_states(spark):
    state = spark.createDataFrame([(1, "pending"), (2, "confirmed"), (3, "investigating")], "id int, status string")
    cmd = spark.createDataFrame([(1, "confirmed"), (2, "rejected")], "id int, to string")
    allowed = {"confirmed": ("pending", "investigating"), "rejected": ("pending", "investigating")}
    got = {r["id"]: (r["status"], r["applied"]) for r in discovery.guarded(state, cmd, allowed).collect()}
    assert got == {1: ("confirmed", True), 2: ("confirmed", False), 3: ("investigating", None)}


def test_lint_report(spark):
    schema = "note_id bigint, title string, type string, body string, links array<string>"
    pages = spark.createDataFrame(
        [
            (1, "Treatment effect", "concept", "x", ["Confidence assessment", "Missing endpoint"]), (2, "Confidence assessment", "concept", "x", ["Treatment effect"]),
            (3, "Orphan finding", "concept", "x", []), (4, "orphan finding", "note", "x", None), (5, "Unreadable page", "concept", None, None),
        ], schema,
    )
    held = spark.createDataFrame([(1, 1, "contradict"), (2, 1, "new")], "note_id bigint, source_id bigint, action string")
    found = lint.report(pages, held)
    counts = {r["severity"]: r["findings"] for r in lint.summary(found, pages, held).collect()}
    assert counts == {"error": 4, "warning": 5, "info": 1}
    assert [r["code"] for r in lint.ordered(found).collect()] == [
        "duplicate_title", "duplicate_title", "broken_link", "unreadable_page", "legacy_format", "missing_provenance", "missing_provenance", "orphan_page", "missing_provenance", "recorded_contradiction",
    ]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (10, 11), (7, 7), (None, 1), (5, 4)], "src bigint, dst bigint")
    assert {tuple(r) for r in connected_components(edges).collect()} == {(2, 2), (3, 2), (4, 2), (5, 2), (10, 10), (11, 10)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "src bigint, dst bigint")
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    assert connected_components(edges.limit(0)).count() == 0


# ---- orphan references ----------------------------------------------------------------------
def at(day):
    return dt.datetime(2025, 1, day)


def frames(spark, parents, references, removals):
    return (
        spark.createDataFrame(parents, orphans.PARENTS), spark.createDataFrame(references, orphans.REFERENCES), spark.createDataFrame(removals, orphans.REMOVALS),
    )


def rows_of(state):
    return {(r["ref_field"], r["note_id"], r["target"], r["orphan"]) for r in state.references.collect()}


def test_orphans_late_removed_and_missing(spark):
    parents = [("note", "a", 1, at(1)), ("note", "b", 2, at(20)), ("note", "c", 3, at(1)), ("note", "c", 4, at(9)), ("note", "a", 1, at(1))]
    refs = [("links", 10, t, "note", t, at(10)) for t in "abcd"] + [("links", 11, "c", "note", "c", at(2)), ("links", 12, "a", "note", "a", None)]
    state = orphans.advance(orphans.empty_state(spark), *frames(spark, parents, refs, [("note", 3)]))
    assert {(n, t) for _, n, t, o in rows_of(state) if o} == {(10, "b"), (10, "d"), (11, "c")}


def test_batches_in_any_order_give_the_same_state(spark):
    rng = random.Random(5)
    parents = [("note", f"k{rng.randrange(12)}", i, at(rng.randrange(1, 28))) for i in range(20)]
    refs = [("links", rng.randrange(6), f"k{rng.randrange(14)}", at(rng.randrange(1, 28))) for _ in range(40)]
    refs = [(f, n, t, "note", t, w) for f, n, t, w in refs]
    gone = [("note", i) for i in range(0, 20, 4)]
    whole = rows_of(orphans.advance(orphans.empty_state(spark), *frames(spark, parents, refs, gone)))
    state = orphans.empty_state(spark)
    for p, r, g in ((parents[10:], refs[:15], []), (parents[:3], refs[15:], gone[2:]), (parents[3:10], refs[:5], gone[:2])):
        state = orphans.advance(state, *frames(spark, p, r, g))
    assert rows_of(state) == whole
    for k, some in ((0, state), (1, replace(state, version=2)), (2, replace(state, version=1))):
        counts = orphans.snapshot_counts(some).agg(F.sum("orphans"), F.sum("references")).first()
        held = rows_of(some)
        assert (counts[0], counts[1]) == (sum(o for *_, o in held), len(held)) and (k or held == whole)


def test_state_resolves_and_reopens_and_a_small_batch_reads_its_keys_alone(spark):
    refs = [("links", n, f"t{k}", "note", f"t{k}", at(10)) for k in range(40) for n in range(5)]
    state = orphans.advance(orphans.empty_state(spark), *frames(spark, [], refs, []))
    assert sum(o for *_, o in rows_of(state)) == 200
    state = orphans.advance(state, *frames(spark, [("note", "t7", 7, at(5)), ("note", "t8", 8, at(20))], [], []))
    assert {t for *_, t, o in rows_of(state) if not o} == {"t7"}  # resolved; t8 came too late
    # Only the five references that were resolved have a row of the second version.
    assert state.log("references").where("version = 2").count() == 5
    state = orphans.advance(state, *frames(spark, [], [], [("note", 7)]))
    assert sum(o for *_, o in rows_of(state)) == 200  # reopened
    touched = spark.createDataFrame([("note", "t7")], "kind string, key string")
    buckets, few = orphans._places(state, touched, ("kind", "key"))
    plan = orphans._touching(state, "references", touched, ("kind", "key"), buckets, few)._jdf.queryExecution().executedPlan().toString()
    assert len(buckets) == 1 and few == ["t7"] and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") or "bucket#" in plan
    again = orphans.advance(state, *frames(spark, [], refs[:3], [("note", 7)]))
    assert rows_of(again) == rows_of(state)


def test_orphans_of_empty_and_dirty_tables(spark):
    n = "note_id bigint, title string, links array<string>, relationships array<struct<target:string,confirmedAt:string>>, created_at timestamp, since string, key string"
    rows = [(1, "Home ", ["  HOME", "Ｈome", "", None, "Away"], [("home", "2025-01-09T00:00:00+02:00"), ("Home", "not a time"), (None, None)], at(2), "x", "y"), (2, None, None, None, None, None, None)]
    notes = spark.createDataFrame(rows, n)
    sources = spark.createDataFrame([(5, at(1))], "source_id bigint, created_at timestamp")
    ns = spark.createDataFrame([(1, 5, at(3)), (1, None, at(3)), (None, 9, at(3)), (2, 5, at(1))], "note_id bigint, source_id bigint, attached_at timestamp")
    gone = spark.createDataFrame([], "record_kind string, record_id bigint")
    got = {(f, i, t) for f, i, t, o in rows_of(orphans.orphan_state(notes, sources, ns, gone)) if o}
    assert got == {("links", 1, "Away"), ("note_sources", None, "9")}
    assert orphans.orphan_state(notes.limit(0), sources.limit(0), ns.limit(0), gone).references.count() == 0
