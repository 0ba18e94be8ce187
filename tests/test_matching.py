"""Similarity bounds, assignments and patches against plain versions of their rules."""

import random
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import similarity as S
from palimpsest.operators import assign as A
from palimpsest.operators import edits, patch, styles, tables

WORDS = st.text(alphabet="abc d", max_size=12)


def test_ratio_depends_on_order():
    assert S.ratio("tide", "diet") == 0.25 and S.ratio("diet", "tide") == 0.5


def test_bounds(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde ") for _ in range(rng.randrange(15)))
    rows = [(word(), word()) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.length_bound(F.col("a"), F.col("b")).alias("l"), S.multiset_bound(F.col("a"), F.col("b")).alias("m"))
    for r in df.collect():
        ratio = SequenceMatcher(None, r.a, r.b, autojunk=False).ratio() if r.a or r.b else 0.0
        assert r.l >= r.m - 1e-12 and r.m >= ratio - 1e-12


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, max_size=6), st.lists(WORDS, max_size=6), st.booleans())
def test_match_global_is_plain_greedy(left, right, descending):
    pairs = [(S.ratio(a, b), i, j) for i, a in enumerate(left) for j, b in enumerate(right) if a and b and S.ratio(a, b) >= 0.5]
    assert A.match_global(left, right, 0.5, descending) == A.greedy_global(pairs, descending)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.lists(WORDS, max_size=6), st.sampled_from([0.0, 0.5, 0.75]))
def test_argmax_is_plain(a, pool, least):
    best, at = 0.0, -1
    for j, b in enumerate(pool):
        r = S.ratio(a, b) if a and b else 0.0
        if r > best and r >= least:
            best, at = r, j
    assert A.argmax(a, pool, least) == (at, best)


def test_tie_breaks():
    pairs = [(0.8, 1, 2), (0.8, 0, 5), (0.8, 1, 3)]
    assert A.greedy_global(pairs) == {1: (2, 0.8), 0: (5, 0.8)}
    assert A.greedy_global(pairs, ties_descending=True) == {1: (3, 0.8), 0: (5, 0.8)}


def block(pos, kind, text):
    return {"pos": pos, "kind": kind, "text": text}


def test_bullets():
    base = [block(0, "para", "Intro with a word about grapes"), block(1, "list", "apples and pears"), block(2, "list", "bread and butter"), block(3, "list", "qqqq zzzz")]
    source = "* apples and pears\n* bread and butter with a lot of jam\n* grapes\n* 12345 67890\n"
    got = [(a, pos, anchor, side) for _, a, pos, anchor, side, _, _ in patch.patch_bullets(base, source)]
    assert got == [("keep", 1, None, None), ("update", 2, None, None), ("present", None, None, None), ("insert", None, 2, "after")]
    assert [x[2] for x in patch.stale_bullets(base, source)] == [3]
    assert patch.stale_bullets(base, "no bullets") == []


def test_text_and_orphans():
    base = [block(0, "para", "The quick brown fox jumps"), block(1, "para", "Second line stays"), block(2, "list", "an item")]
    source = "The quick brown fox jumped\nSecond line stays\nA wholly new closing remark\n* an item\n"
    assert [(x[2], x[5]) for x in patch.correct_text(base, source)] == [(0, "The quick brown fox jumped")]
    assert [(x[3], x[4], x[5]) for x in patch.orphan_lines(base, source)] == [(1, "after", "A wholly new closing remark")]
    assert patch.orphan_lines([*base, block(3, "table_row", "a b")], source) == []


def test_bold_and_order():
    base = [block(0, "para", "Do not enter; a notice says not now")]
    assert patch.bold_emphasis(base, "Do **not** enter; a notice says not now")[0][5] == "3:6"
    assert patch.bold_emphasis(base, "Do not enter; a notice says **not** now")[0][5] == "28:31"
    items = [block(0, "list", "alpha one"), block(1, "list", "other zzz"), block(2, "list", "beta two")]
    moves = [(x[2], x[3]) for x in patch.bullet_order(items, "* beta two\n* alpha one\n")]
    assert sorted(moves) == [(0, 2), (2, 0)]


@settings(max_examples=200, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=4), WORDS)
def test_spliced_runs_give_the_new_text(runs, new):
    if "".join(runs):
        assert "".join(patch.splice_runs(runs, new)) == new


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_row_patch_cases(spark):
    def run(base, new):
        f = lambda rows: spark.createDataFrame([(1, i, c) for i, c in enumerate(rows)], "table_id long, row_idx int, cells array<string>")
        return {(r.action, r.base_row, r.new_row) for r in tables.row_patch(f(base), f(new)).collect()}

    head = ["id", "name"]
    assert ("remove", 2, None) in run([head, ["1", "apple tart"], ["2", "plum cake"]], [head, ["1", "apple tart"]])
    replaced = run([head, ["k1", "qqqqqqqqqqqq"], ["k2", "plum cake"]], [head, ["k1", "9999999999999999"], ["k2", "plum cake"]])
    assert {("insert", None, 1), ("remove", 1, None), ("keep", 2, 2)} <= replaced
    many = run([head], [head] + [[str(i), f"{i}" * 9] for i in range(10, 20)])
    assert sum(a == "skip" for a, _, _ in many) == 10


def test_edits(spark):
    blocks = spark.createDataFrame([(1, i, "heading" if i % 2 == 0 else "para", f"t{i}") for i in range(6)], "doc long, pos int, kind string, text string")
    e = [(1, 0, "insert", "t2", ["x"]), (1, 1, "insert", "t2", ["y", "z"]), (1, 2, "delete", "t4", []), (1, 3, "insert", "(end)", ["w"]), (1, 4, "replace", "none", ["q"])]
    out, skipped = edits.apply_edits(blocks, spark.createDataFrame(e, "doc long, ord int, kind string, target string, texts array<string>"), "doc")
    assert [r.text for r in out.orderBy("pos").collect()] == ["t0", "t1", "t2", "t3", "x", "y", "z", "w"]
    assert [r.target for r in skipped.collect()] == ["none"]


def test_versions(spark):
    # A path's own version plus one, past the versions that are taken.
    names = ["report", "report_v001", "report_v012", "a.docx", "a_v003.docx", "b_v999", "b_v1000"]
    out = edits.next_versions(spark.createDataFrame([(n,) for n in names], "path string"), "path")
    assert {r.path: r.next_path for r in out.collect()} == {
        "report": "report_v002", "report_v001": "report_v002", "report_v012": "report_v013", "a.docx": "a_v001.docx", "a_v003.docx": "a_v004.docx",
        "b_v999": "b_v1001", "b_v1000": "b_v1001",
    }


def test_style_levels(spark):
    rows = [(1, "Base", 0, None), (1, "Child", None, "Base"), (1, "Grand", None, "Child"), (1, "X", None, "Y"), (1, "Y", None, "X"), (1, "Heading3", None, None), (1, "Deep", 9, "Heading3")]
    out = styles.style_levels(spark.createDataFrame(rows, "doc long, style_id string, outline_lvl int, based_on string"), "doc")
    assert {r.style_id: r.level for r in out.collect()} == {"Base": 1, "Child": 1, "Grand": 1, "Heading3": 3, "Deep": 3}


def test_long_chains_and_spaced_heading_ids(spark):
    rows = [(1, "Heading 12", None, None), (1, "C0", None, "Heading 12"), *((1, f"C{i}", None, f"C{i - 1}") for i in range(1, 41))]
    rows += [(2, "C0", 99, "C1"), (2, "C1", None, "C0"), (2, "heading2", None, None), (2, "HEADING3", None, None)]
    out = styles.style_levels(spark.createDataFrame(rows, "doc long, style_id string, outline_lvl int, based_on string"), "doc")
    got = {(r.doc, r.style_id): r.level for r in out.collect()}
    assert got == {(1, "Heading 12"): 12, (2, "heading2"): 2, **{(1, f"C{i}"): 12 for i in range(41)}}


def test_copies_and_their_short_leads(spark):
    from palimpsest.operators import dedup

    long, other = "a paragraph of the preserved section, long enough", "another paragraph, which is long enough to be compared"
    rows = [(0, 0, "heading", "Kept", False), (1, 0, "para", long, False), (2, 1, "heading", "Edited", True), (3, 1, "para", "x" * 60, True), (4, 1, "para", long, True),
            (5, 1, "list", "short item", True), (6, 1, "para", long, True), (7, 1, "para", long, True), (8, 1, "para", other, True), (9, 1, "list", other, True),
            (10, 1, "para", "lead", True), (11, 1, "para", "kept", True)]
    df = spark.createDataFrame([(1, p, s, k, t, t.lower(), e) for p, s, k, t, e in rows], "doc long, pos int, sec_idx int, kind string, text string, norm string, edited boolean")
    # A lead of 40 to 99 characters goes, a list item before a copy stays, a copy is nobody's lead.
    assert {(r.pos, r.reason) for r in dedup.across_sections(df, "doc").collect()} == {(4, "copy"), (3, "orphan"), (6, "copy"), (7, "copy")}
    assert {r.pos for r in dedup.repeated_in_section(df, "doc").collect()} == {6, 7, 9}
    assert {(r.pos, r.reason) for r in dedup.preserved_headings(df, "doc").collect()} == {(11, "heading"), (10, "orphan")}


def test_a_long_pair(spark):
    """500 sections of one pair: headings are aligned in one group, contents are not."""
    from palimpsest.operators import align

    doc = lambda word: "".join(f"## part {i} of the text\n\nbody {i} {word if i % 50 == 0 else 'same'}\n\n" for i in range(500))
    base, source = (spark.createDataFrame([(1, doc(w))], "pair long, text string") for w in ("old", "another"))
    out = align.section_diff(base, source, "pair").select("source_idx", "base_idx", "action").collect()
    assert len(out) == 500 and all(r.source_idx == r.base_idx and (r.action == "identical") == (r.source_idx % 50 != 0) for r in out)
