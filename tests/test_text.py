"""Text functions on documented literals and on the traps of their definitions."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import json_text as J
from palimpsest.functions import text as T
from palimpsest.operators import tables
from palimpsest.operators.sections import line_table, md_sections


@pytest.fixture(scope="module")
def value(spark):
    def of(fn, *texts):
        df = spark.createDataFrame([tuple(texts)], ", ".join(f"c{i} string" for i in range(len(texts))))
        return df.select(fn(*[F.col(f"c{i}") for i in range(len(texts))]).alias("v")).first().v

    return of


def test_normalizations(value):
    assert value(T.normalize_text, "  **Bold**\u00a0 [x](y)|  É ") == "bold xy e\u0301"
    assert value(T.normalize_text, "\u201cq\u201d \u2014") == "\u201cq\u201d \u2014"  # quotes and dashes stay
    assert value(T.normalize_emphasis, "__A__ #  *b*") == "a # b"
    assert value(T.normalize_match, "A -- b__c...d") == "a b c d"
    assert value(T.normalize_heading, "**Schedule**") == "schedule"
    assert value(T.normalize_heading, "* 1. Schedule") == "schedule"
    assert value(T.clean_inline, "**a** `b` ~~c~~ _d_") == "a b c d"
    assert value(T.clean_cell, r"PROJ_MODULE_ID_01 \_x\_ **b**") == "PROJ_MODULE_ID_01 _x_ b"
    assert value(lambda c: T.clean_cell(c, True), "**b** `c`") == "**b** c"


def test_bold(value):
    got = value(T.bold_segments, "**Test Strategy & Framework:** Define the test approach...")
    assert [tuple(x) for x in got] == [("Test Strategy & Framework:", True), (" Define the test approach...", False)]
    assert [tuple(x) for x in value(T.bold_segments, "a **b** c **d")] == [("a ", False), ("b", True), (" c ", False), ("**d", False)]
    assert value(T.bold_split, "a **b** c") == ["a ", "**b**", " c"]
    assert [tuple(x) for x in value(T.bold_positions, "one **two** x **six**")] == [("two", 4, 13), ("six", 10, 13)]
    assert value(lambda c: T.phrase_count(c, "not"), "notice Not knot not, not1") == 3


def test_separators_and_counts(value):
    assert value(T.separator_name, "**SIGNATURE PAGE FOLLOWS**") == "(signature page follows)"
    assert value(T.separator_name, "**Signature Page Follows**") is None and value(T.separator_name, "**ABC 1234**") is None
    assert value(T.body_line_count, "# h\n\n* b\n1. n\n2) n\n| t |\nbody\n -x") == 2
    assert value(T.table_count, "| a |\n|---|\n| b |") == 1
    assert value(T.double_space_lines, "a  b\n```\nc  d\n```\n| e  f\n  g h\ni  j") == [1, 7]
    assert value(lambda c: T.preview(c, 3, True), "abcd") == "abc..."


def test_headings(spark):
    lines = ["# A ##", "1. Executive Summary", "* 1. Preflight", "  1. Takeoff", "   1. deep", "1. **bold** item", "plain"]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc long, text string")
    got = [(r.level, r.heading) for r in line_table(docs, "doc").orderBy("pos").collect()]
    assert got == [(1, "A"), (1, "Executive Summary"), (2, "Preflight"), (2, "Takeoff"), (None, None), (None, None), (None, None)]


def sections(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc long, text string")
    return [(r.heading, r.level, r.content) for r in md_sections(docs, "doc").orderBy("sec_idx").collect()]


def test_sections(spark):
    assert sections(spark, "# A\n# B\ntext") == [("B", 1, "text")]  # a heading followed at once by another goes
    assert sections(spark, "# A\n\n# B\ntext") == [("A", 1, ""), ("B", 1, "text")]
    assert sections(spark, "intro\n# A") == [("(preamble)", 0, "intro"), ("A", 1, "")]
    assert sections(spark, "") == [] and sections(spark, "\n \n") == []
    assert sections(spark, "# A\nx\n**SIGNATURE PAGE FOLLOWS**\ny") == [("A", 1, "x"), ("(signature page follows)", 0, "**SIGNATURE PAGE FOLLOWS**\ny")]
    assert sections(spark, "# A\r\n1. one\r\nx") == [("one", 1, "x")]  # numbered lines are headings below three ATX headings
    assert sections(spark, "# A\n1. one\n# B\nx\n# C\ny")[0] == ("A", 1, "1. one")


def test_table_rows(spark):
    md = "| a | b |\n|---|:-:|\n| 1 | | \n\nx\n2 | 3\n# h | i\n||\n4|5|"
    docs = spark.createDataFrame([(1, md)], "doc long, text string")
    got = [(r.block_idx, r.row_idx, r.cells) for r in tables.table_rows(docs, "doc").orderBy("block_idx", "row_idx").collect()]
    assert got == [(0, 0, ["a", "b"]), (0, 1, ["1", ""]), (1, 0, ["2", "3"]), (2, 0, ["4", "5"])]


def test_json():
    assert J.parsed('```json\n{"a": 1}\n```') == '{"a":1}'
    assert J.parsed('Sure: [1, "x\ny"]') == '[1,"x\\ny"]' and J.parsed('Sure: [1] done') is None
    assert J.parsed('note [1]: {"a":1}') == '{"a":1}' and J.parsed('```json {"a":1}```') == '{"a":1}' and J.parsed('{"a":1} trailing') is None
    assert J.parsed("nothing") is None and J.parsed(None) is None
    assert J.repaired('{"a": "b\tc\\"\n"}\n') == '{"a": "b\\tc\\"\\n"}\n'


def test_separators_and_prefixes_at_their_limits(value):
    assert value(T.separator_name, "**SIGNATURE *PAGE* FOLLOWS**") == "(signature *page* follows)"
    assert value(T.separator_name, "**日本語日本語日本語**") is None and value(T.separator_name, "****") is None
    assert value(T.normalize_heading, "+ Schedule") == "+ schedule" and value(T.normalize_heading, "1) Schedule") == "1) schedule"
    assert value(T.normalize_heading, "- 2. **Schedule**") == "schedule"
