"""Queries without SQL, held against plain Python over whole tables, and rules that need rivals."""

import re
from difflib import SequenceMatcher

from palimpsest.operators import patch
from palimpsest.plans.queries import QUERIES
from palimpsest.sources import views as V

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_similar_neighbours(spark):
    want = {}
    for r in V.read(spark, SF, "documents").collect():
        lines = (r.text or "").lower().split("\n")
        for i, (a, b) in enumerate(zip(lines, lines[1:], strict=False)):
            x = SequenceMatcher(None, a, b, autojunk=False)
            if a and b and x.quick_ratio() >= 0.9 and x.ratio() >= 0.9:
                want[r.doc_id, i] = round(x.ratio(), 6)
    found = {(r.doc_id, r.pos): r.similarity for r in QUERIES["similar_neighbours"](spark, SF).collect()}
    assert found == want and want


def test_unchanged_sections_on_both_sides_of_the_threshold(spark):
    turns = V.turns(spark, LARGER).collect()
    found = {(r.conv_id, r.turn): r.unchanged for r in QUERIES["unchanged_sections"](spark, LARGER).collect()}
    assert len(found) == len(turns)
    near = set()
    plain = lambda x: " ".join(re.sub(r"[*_#`\[\]()!|]", "", x).lower().split())
    for t in turns:
        words = t.text.split(" ")
        md = " ".join({1: [w for i, w in enumerate(words) if i % 12 != 5], 2: words[::3]}.get(t.k, words))
        a, b = plain(md), plain(t.text)
        r = SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert found[t.conv_id, t.turn] == (a != "" and b != "" and "|" not in md and r >= 0.9), (t, r)
        if 0.85 < r < 1.0:
            near.add(r >= 0.9)
    assert near == {True, False}


def test_a_line_renames_one_heading_only(spark):
    heads = spark.createDataFrame(
        [(1, 0, "PAYMENT TERMS AND FEES"), (1, 1, "PAYMENT TERMS AND FEE"), (1, 2, "GOVERNING LAW"), (2, 0, "PAYMENT TERMS AND FEES")], "conv_id long, sec_idx int, heading string"
    )
    source = spark.createDataFrame(
        [(1, "PAYMENT TERMS AND FEES X\nsmall letters\nPAYMENT TERMS OR FEES\nGOVERNMENT LAW\nGOVERNING LAWS"), (2, "# PAYMENT TERMS AND FEES X")], "conv_id long, text string"
    )
    lines = ["PAYMENT TERMS AND FEES X", "PAYMENT TERMS OR FEES", "GOVERNMENT LAW", "GOVERNING LAWS"]
    want, used = {}, set()
    for i, h in enumerate(["PAYMENT TERMS AND FEES", "PAYMENT TERMS AND FEE", "GOVERNING LAW"]):
        free = [x for x in lines if x not in used]
        best = max(free, key=lambda x: SequenceMatcher(None, h, x, autojunk=False).ratio())
        want[i] = best
        used.add(best)
    found = {r.sec_idx: r.new_heading for r in patch.rename_candidates(heads, source, "conv_id").collect()}
    assert found == want == {0: lines[0], 1: lines[1], 2: lines[3]}
