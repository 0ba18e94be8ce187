"""Quality rules and line dedup: SQL on the small tables, and defined results on odd rows."""

import duckdb
import pytest

from palimpsest.llm import line_dedup as L
from palimpsest.llm import quality_rules as Q
from palimpsest.llm.queries import QUERIES, oracles

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    want = con.sql(oracles()[name]).project(", ".join(columns)).fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in frame.collect()))) == sorted(map(repr, want))


def test_rules_on_odd_rows(spark):
    rows = [
        (1, None, "x"),
        (2, "", "x"),
        (3, "\x0b\x0c \r\n\t", "x"),
        (4, "a b c a b c d", "x"),
        (4, "a a a a", "x"),
        (5, "one word # $$ \n\nx y\nx y \nx y", "x"),
        (None, " ".join(f"w{i}" for i in range(20000)), None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = {(r.doc_id, r.text): r for r in Q.quality_rules(docs).collect()}
    assert len(got) == 7 and not any(r.kept for r in got.values() if r.n_words < 50)
    pick = lambda i, t: (got[i, t].n_words, got[i, t].word_chars, got[i, t].n_symbols, got[i, t].n_dup_lines, got[i, t].n_repeat_words)
    assert pick(1, None) == pick(2, "") == pick(3, rows[2][1]) == (0, 0, 0, 0, 0)
    assert pick(4, rows[3][1]) == (7, 7, 0, 0, 6)
    assert pick(4, rows[4][1]) == (4, 4, 0, 0, 4)
    assert pick(5, rows[5][1]) == (9, 17, 3, 1, 6)
    assert Q.quality_rules(docs).filter("kept").count() == 0
    assert Q.quality_rules(docs.limit(0)).count() == 0


def test_wide_lines(spark):
    body = "a long line of text that belongs to one document only, number "
    rows = [(i, f"{body}{i}\n  Licence line \n\nend {i}", f"s{i % 6}", 1) for i in range(12)]
    rows += [(20 + i, f"{body}{i}x\nfour sites", f"s{i % 4}", 1) for i in range(12)]
    rows += [(40 + i, "Licence line", f"s{i}", 1) for i in range(3)] + [(50, None, "s1", 1), (None, f"{body}\nLicence line", None, 1)]
    rows += [rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int")
    out = L.remove_wide_lines(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None and r.doc_id < 12:
            assert (r.text, r.n_lines, r.n_wide_lines, r.n_removed) == (f"{body}{r.doc_id}\n\nend {r.doc_id}", 3, 1, 1)
        elif r.doc_id is None:
            assert r.text == body and r.n_removed == 1
        elif r.doc_id == 50:
            assert r.text is None and r.n_lines == 0
        else:
            assert r.n_removed == 0 and r.n_wide_lines == (r.doc_id >= 40)
    assert L.remove_wide_lines(docs.limit(0)).count() == 0


def test_many_sites_and_estimates(spark):
    rows = [(i, f"line {i % 7}\nown line number {i}", f"s{i % (3 + i % 7)}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sites: dict[str, set] = {}
    for _, t, s in rows:
        for x in t.split("\n"):
            sites.setdefault(x, set()).add(s)
    for least in (2, 5, 6, 9):
        wide = {x for x, s in sites.items() if len(s) >= least}
        lines = L.line_table(docs, "text", "source", "doc_id")
        found = lines.join(L.wide_lines(lines, least), L.KEY).count()
        assert found == sum(x in wide for _, t, _ in rows for x in t.split("\n"))


def test_rules_keep_clashing_columns(spark):
    good = " ".join(f"The word{i} of x{i}" for i in range(40))
    docs = spark.createDataFrame([(1, good, "a", "b", "c"), (2, good.replace("The", "Thy").replace(" of", " off"), "a", "b", "c")], "doc_id long, text string, _text string, _words string, kept string")
    out = {r.doc_id: r for r in Q.quality_rules(docs).collect()}
    assert (out[1]["_text"], out[1]["_words"], out[1].n_stop_words, out[1].kept) == ("a", "b", 80, True)
    assert (out[2].n_stop_words, out[2].kept) == (0, False)
