"""Extraction, consolidation, decisions, rewriting and sweeps with scripted models."""

from pyspark.sql import functions as F

from tessera.operators import distil


def scripted():
    """A model as a nested function, which the workers get by value."""
    import json

    def model(prompt, tokens, temperature):
        if "Extract" in prompt:
            if tokens < 8_000 and "long" in prompt:
                return '{"findings": [', True
            page = [2, 9] if "PDF page 2" in prompt else []
            kind = "bad" if "wrong type" in prompt else "concept"
            return json.dumps({"findings": [{"title": "Beds", "body": prompt[-20:], "type": kind, "tags": ["A", "a", "b", "c", "d"], "links": None, "pages": page}]}), False
        if "Merge" in prompt:
            return json.dumps({"merged": [{"title": "All beds", "body": "merged", "type": "concept", "from": list(range(prompt.count("] Beds")))}]}), False
        if "New, merge" in prompt:
            return 'so: ```json\n{"decisions": [{"action": "merge", "existing_id": 1},]}\n```', False
        return "nothing", False

    return model


def test_findings_of_short_long_and_failed_sources(spark):
    rows = [(1, "a long text"), (2, "## PDF page 1\n\n" + "one. " * 20 + "\n\n## PDF page 2\n\n" + "two. " * 3000), (3, None), (4, "wrong type"), (5, "w " * 230_000)]
    found, errors = distil.distilled(spark.createDataFrame(rows, "source_id bigint, text string"), scripted())
    got = {r["source_id"]: r for r in found.collect()}
    assert set(got) == {1, 2} and got[1]["title"] == "Beds" and got[1]["tags"] == ["A", "b", "c"]
    assert got[2]["title"] == "All beds" and got[2]["pages"] == [2]  # page 9 is not in the text
    assert {r["source_id"] for r in errors.collect()} == {5}


def test_bad_replies_fall_back(spark):
    silent = lambda prompt, tokens, temperature: ("no json", False)
    assert distil.reply_of(silent, "p", "findings") == (None, "no JSON object in the reply")
    finding = "struct<title:string,body:string,type:string,tags:array<string>,links:array<string>,pages:array<int>>"
    rows = [(1, c, 0, (t, f"b{c}", "concept", [], [], [])) for c, t in ((1, "X"), (2, "x"), (3, "Y"))]
    out = distil.consolidated(spark.createDataFrame(rows, f"source_id bigint, chunk_no bigint, at int, finding {finding}"), silent)
    assert [(r["title"], r["body"]) for r in out.orderBy("position").collect()] == [("X", "b1"), ("Y", "b3")]
    targets = spark.createDataFrame([(1, "old", ["A"], None, "new", ["a", "B"], ["L"])], "note_id bigint, body string, tags array<string>, links array<string>, added_body string, added_tags array<string>, added_links array<string>")
    assert [tuple(r) for r in distil.rewritten(targets, silent).collect()] == [(1, "old\n\nnew", ["A", "B"], ["L"])]


def test_decisions_are_completed_and_safeguarded(spark):
    schema = "note_id bigint, title string, body string"
    notes = spark.createDataFrame([(1, "Beds", "There are 5 beds."), (2, "Wards", "w")], schema)
    incoming = spark.createDataFrame([(10, "Other", "text"), (11, "wards", "else"), (12, "Alone", "z")], schema)
    pool = spark.createDataFrame([(10, 1), (11, 2)], "incoming_id bigint, existing_id bigint")
    got = {r["incoming_id"]: (r["action"], r["existing_id"]) for r in distil.decided(incoming, pool, notes, scripted()).collect()}
    # 11: the model names a page outside its candidates, but its title is that of page 2.
    assert got == {10: ("merge", 1), 11: ("merge", 2), 12: ("new", None)}


def test_a_sweep_can_stop_and_go_on(spark):
    rows = [(f"f{i:02}", 1, i / 100, "queued", None) for i in range(50)]
    stored = spark.createDataFrame(rows, "fingerprint string, generation bigint, score double, status string, discovery_id bigint")
    review = lambda batch: batch.select("fingerprint", F.lit("reviewed").alias("status"), F.lit(None).cast("bigint").alias("discovery_id"))
    half = distil.sweep(stored, 1, review, rounds=1)
    assert {r["fingerprint"] for r in half.where("status = 'reviewed'").collect()} == {f"f{i:02}" for i in range(30, 50)}
    assert distil.sweep(half, 1, review).where("status = 'queued'").count() == 0
    assert distil.sweep(stored, 1, lambda b: review(b).limit(0)).where("status = 'queued'").count() == 50
