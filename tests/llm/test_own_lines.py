"""Line dedup: brute force, and short pages under long boilerplate."""

from pyspark.sql import functions as F

from palimpsest.llm import line_dedup as L
from palimpsest.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_short_pages_under_long_boilerplate(spark):
    long = "This work is licensed under a licence whose name is longer than the page itself."
    rows = [(i, f"own {i}\n{long}", f"s{i}") for i in range(6)] + [(9, f"{long}\n\n {long} ", "s9"), (10, None, "s1"), (11, "", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in L.remove_wide_lines(docs).collect()}
    assert all((out[i].text, out[i].n_lines, out[i].n_removed) == (f"own {i}", 2, 1) for i in range(6))
    assert (out[9].text, out[9].n_wide_lines, out[9].n_removed) == (rows[6][1], 2, 0)
    assert out[10].text is None and out[11].text == "" and out[10].n_removed == out[11].n_removed == 0


def test_against_brute_force(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    sites: dict[str, set] = {}
    for _, t, s in docs:
        for x in t.split("\n"):
            sites.setdefault(strip(x), set()).add(s)
    want = []
    for i, t, _ in docs:
        lines = t.split("\n")
        wide = [strip(x) != "" and len(sites[strip(x)]) >= L.MIN_SITES for x in lines]
        n = sum(strip(x) != "" for x in lines)
        cut = 0 < sum(wide) < n
        want.append((i, n, sum(wide), sum(wide) if cut else 0, "\n".join(x for x, w in zip(lines, wide) if not w) if cut else t))
    got = [tuple(r) for r in QUERIES["op3_line_dedup"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_option_of_a_share(spark):
    long = "This work is licensed under a licence whose name is longer than the page itself."
    docs = spark.createDataFrame([(i, f"own {i}\n{long}", f"s{i}") for i in range(6)], "doc_id long, text string, source string")
    out = L.remove_wide_lines(docs, max_share=0.5).collect()
    assert [(r.n_wide_lines, r.n_removed) for r in out] == [(1, 0)] * 6


def test_names_that_clash_and_hot_lines(spark, monkeypatch):
    from palimpsest.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    rows = [(i, "\n".join([f"own {i}", *["everywhere"] * (i % 3), f"line {i % 4}", "on five" if i < 5 else "on one"]), f"s{i % 7}", i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _wide long")
    docs = docs.withColumn("__k1", F.col("_wide"))
    out = L.remove_wide_lines(docs).collect()
    assert all(r._wide == r.__getitem__("__k1") == r.doc_id for r in out)
    sites: dict[str, set] = {}
    for _, t, s, _ in rows:
        for x in t.split("\n"):
            sites.setdefault(x, set()).add(s)
    want = {i: "\n".join(x for x in t.split("\n") if len(sites[x]) < L.MIN_SITES) for i, t, _, _ in rows}
    assert {r.doc_id: r.text for r in out} == want


def test_a_very_long_text(spark):
    long = "\n".join(f"row {i}" for i in range(50_000))
    rows = [(0, f"{long}\nfooter", "s0")] + [(i, f"own {i}\nfooter", f"s{i}") for i in range(1, 6)]
    out = {r.doc_id: r for r in L.remove_wide_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (out[0].text, out[0].n_lines, out[0].n_removed) == (long, 50_001, 1)
