"""Callbacks, sinks, gates of checks and the entry point."""

import json

import pytest
from palimpsest.__main__ import main, resolve, settings
from palimpsest.operators import checks, planner
from palimpsest.plans.revise import revise
from palimpsest.sources import sinks

MAPPING = "pair_id long, source_idx int, heading string, content string, level int, action string, base_idx int, base_heading string, base_level int"


def test_answers():
    good = json.dumps([{"a": 1}])
    assert planner.answered(lambda m: good, "x") == [{"a": 1}]
    said = iter(["no", "```json\n" + good + "\n```"])
    assert planner.answered(lambda m: next(said), "x") == [{"a": 1}]
    with pytest.raises(planner.Unreadable):
        planner.answered(lambda m: "no", "x")
    noted = []
    assert planner.answered(lambda m: "no", "x", noted.append) == [] and len(noted) == 1


def test_map_batches_and_repeats(spark):
    """Seventy sections in three requests; equal headings go by their number; unknown bases are null."""

    def ask(messages):
        request = json.loads(messages[0]["content"])
        assert len(request["sections"]) <= 30 and all(len(x["preview"]) <= 200 for x in request["sections"])
        return json.dumps([{"source_heading": x["heading"], "base_heading": x["heading"] if x["heading"] != "h7" else "nowhere", "action": "replace"} for x in request["sections"]])

    rows = [(1, i, f"h{i % 35}", "c" * 500) for i in range(70)]
    schema = "pair_id long, sec_idx int, heading string, content string"
    source, base = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[:35], schema)
    got = planner.section_map(source, base, ask).orderBy("ord").collect()
    assert [r.source_idx for r in got] == list(range(70))
    assert [r.base_idx for r in got] == [None if i % 35 == 7 else i % 35 for i in range(70)]
    empty = spark.createDataFrame([], schema)
    assert planner.section_map(empty, base, ask).count() == 0
    assert all(r.base_idx is None for r in planner.section_map(source, empty, ask).collect())


def test_plan_failures(spark):
    """Broken content is mended or preserved, an unreadable batch is preserved, bullets are counted."""
    bullets = "* one\n* two\n* three"

    def ask(messages):
        request = json.loads(messages[0]["content"])
        if "broken" in request:
            return json.dumps([{"content": "<w:p/>"}]) if request["section"]["target"] == "mendable" else "no"
        if any(x["heading"] == "deaf" for x in request["sections"]):
            return "no"
        made = {"mendable": "<w:p>", "hopeless": "<w:p>", "list": "<w:p>ListBullet</w:p>", "kept": "<w:p/>"}
        return json.dumps([{"kind": "preserve" if x["heading"] == "kept" else "replace", "target": x["target"], "content": made.get(x["heading"], "<w:p/>")} for x in request["sections"]])

    rows = [(1, i, h, bullets if h == "list" else "x" * (9000 if h == "deaf" else 5), 1, "replace", i, h, 1) for i, h in enumerate(["mendable", "hopeless", "list", "kept", "deaf", "after"])]
    rows += [(2, 0, "only", None, 1, "insert", None, None, None), (2, 1, "same", "y", 1, "unchanged", 0, "same", 1)]
    got = planner.edit_plan(spark.createDataFrame(rows, MAPPING), ask).orderBy("pair_id", "ord").collect()
    assert [(r.kind, r.target, r.content) for r in got] == [
        ("replace", "mendable", "<w:p/>"), ("preserve", "hopeless", None), ("replace", "list", "<w:p>ListBullet</w:p>"),
        ("preserve", None, None), ("replace", "after", "<w:p/>"), ("replace", "(end)", "<w:p/>"),
    ]
    assert got[2].warning == "bullet loss: 1 of 3" and "batch" in got[3].warning and got[0].warning is None


def test_gates(spark):
    found = spark.createDataFrame([(1, "A", "FAIL"), (1, "B", "FAIL"), (2, "A", "PASS"), (2, "B", "INCONCLUSIVE"), (3, "A", "FAIL")], "d long, issue_id string, status string")
    sets = spark.createDataFrame([(1, "x"), (2, "y")], "d long, doc_set string")
    got = {r.d: tuple(r)[1:] for r in checks.verdicts(checks.gated(found, sets, "d", {"A": ["x"], "B": ["all"]}), "d").collect()}
    assert got == {1: ("A, B", "none", "none", "none"), 2: ("none", "none", "B", "A"), 3: ("none", "none", "none", "A")}


def test_arguments():
    assert resolve(["a"], None, None) == ("a", None) and resolve(["a", "b"], None, None) == ("a", "b")
    assert resolve(["b"], "a", None) == ("a", "b") and resolve(["x"], "a", "b") == ("a", "b") and resolve([], "a", "b") == ("a", "b")
    for bad in (["a", "b", "c"], []):
        with pytest.raises(ValueError):
            resolve(bad, None, None)
    assert settings(["# no=1", "", "export A='b c'", "D=e=f", "nothing"]) == {"A": "b c", "D": "e=f"}


def test_files(spark, tmp_path):
    """Unedited documents are copied as they are; the entry point writes texts and tables."""
    rows = [(1, "## A b\n\nkept   as it is  \n"), (2, "## A b\n\nThe quick brown fox jumps over the dog\n")]
    base = spark.createDataFrame(rows, "id long, text string")
    new = spark.createDataFrame([rows[0], (2, rows[1][1].replace("jumps", "jumped"))], "id long, text string")
    got = {r.pair_id: r for r in sinks.output_texts(base, revise(base, new, "id"), "id").collect()}
    assert got[1].copied and got[1].text == rows[0][1]
    assert not got[2].copied and "jumped" in got[2].text
    base.write.parquet(f"{tmp_path}/base")
    new.write.parquet(f"{tmp_path}/new")
    main([f"{tmp_path}/new", "-b", f"{tmp_path}/base", "--out", f"{tmp_path}/out", "--id", "id"])
    files = {p.parent.name: p.read_text() for p in tmp_path.glob("out/texts/*/part-*")}
    assert files["pair_id=1.md"].rstrip("\n") == rows[0][1].rstrip("\n") and "jumped" in files["pair_id=2.md"]
    assert spark.read.parquet(f"{tmp_path}/out/log").count() > 0
