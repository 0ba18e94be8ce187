"""Decontamination against edit distance by brute force."""

import random

from palimpsest.llm import decontaminate as D
from palimpsest.llm.decontaminate import MAX_EDIT_SHARE, Items, contaminated, normalized, origins


def least_edits(item, doc):
    row = [0] * (len(doc) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(doc, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def damaged(text, n, rng):
    s = list(text)
    for _ in range(n):
        p, kind = rng.randrange(len(s)), rng.random()
        if kind < 0.4:
            s[p] = rng.choice("abcxyz")
        elif kind < 0.7:
            s.insert(p, rng.choice("abcxyz"))
        elif len(s) > 2:
            del s[p]
    return "".join(s)


def test_every_occurrence_within_the_budget(spark):
    rng = random.Random(8)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items = Items(bench)
    for _ in range(60):
        item_id, text = rng.choice(bench)
        item = normalized(text)
        host = normalized(rng.choice(texts))[:300]
        cut = rng.randrange(len(host))
        doc = normalized(host[:cut] + " " + damaged(item, rng.randrange(int(0.15 * len(item))), rng) + " " + host[cut:])
        edits = least_edits(item, doc)
        found = [m for m in items.matches(doc) if m[0] == item_id]
        assert bool(found) == (edits <= int(MAX_EDIT_SHARE * len(item)))
        assert not found or min(m[3] for m in found) == edits


def test_offsets_and_edges(spark):
    bench = spark.createDataFrame(
        [(1, "The  quick brown fox jumps over the lazy dog and runs away"), (2, None), (3, ""), (4, "  "), (5, "tiny"), (6, "exactly!")],
        "item_id long, text string",
    )
    long = "filler words " * 8000
    rows = [
        (1, "x THE quick\nbrown fox jumps over the lazy dog and runs away y", 1),
        (2, None, 1),
        (3, "", 1),
        (4, long + "the quick brown fax jumps over the lazy dog and runs away", 1),
        (5, "a tiny bit, tiny", 1),
        (5, "a tiny bit, tiny", 1),
        (None, "exactly!", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = sorted((str(r.doc_id), r.item_id, r.start, r.end, r.edits) for r in contaminated(docs, bench).collect())
    n = len(long)
    assert got == sorted(
        [("1", 1, 2, 59, 0), ("4", 1, n, n + 57, 1), ("None", 6, 0, 8, 0)] + [("5", 5, 2, 6, 0), ("5", 5, 12, 16, 0)] * 2
    )


def test_blocks_give_the_same_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    once = sorted(map(tuple, contaminated(docs, bench).collect()))
    assert once == sorted(map(tuple, contaminated(docs, bench, block_chars=2500).collect()))
    assert contaminated(docs, bench.limit(0)).count() == 0
    assert contaminated(docs.limit(0), bench).count() == 0


def test_origins():
    raw = "  Abİc \n\n d  e "
    assert len(origins(raw)) == len(normalized(raw)) + 1


def test_many_blocks(spark, monkeypatch):
    """A block for each item, and results written every two blocks, change nothing."""
    monkeypatch.setattr(D, "BLOCKS_A_PLAN", 2)
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    items = items.limit(7)
    few, many = (sorted(map(tuple, D.contaminated(docs, items, block_chars=n).collect())) for n in (2_000_000, 1))
    assert few == many
    few, many = (sorted(r.doc_id for r in D.decontaminated(docs, items, block_chars=n).collect()) for n in (2_000_000, 1))
    assert few == many
