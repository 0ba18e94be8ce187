"""Near-duplicate classes against a brute-force version, and the properties of dart signatures."""

import random

import numpy as np

from palimpsest.llm import common
from palimpsest.llm import near_dedup as N
from palimpsest.llm.graph import components


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_classes(rows, threshold=0.8):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if (not x and not y) or (x and y and len(x & y) >= threshold * len(x | y) - 1e-12):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in sets}


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class_id string, f1 int")
    out = N.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    want = brute_classes(rows)
    for r in out:
        assert r.class_id == (want[r.doc_id] if r.doc_id is not None else None), r


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def test_edge_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(20000))
    check(
        spark,
        [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "One  two"), (6, "one two three four five six"),
         (7, "one two three four five"), (8, "a b c d e f g h"), (8, "a b c d e f g h"), (None, "one two"), (9, long), (10, long + " x")],
    )


def test_chains_and_hot_group(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, edited(base, rng.choice([0, 1, 1, 2, 3, 4]), rng)) for i in range(150)]
    # a chain: each text is near the next one only
    chain = [f"c{i}" for i in range(200)]
    for step in range(12):
        rows.append((1000 + step, " ".join(chain)))
        chain[step * 10 : step * 10 + 4] = [f"d{step}_{i}" for i in range(4)]
    # half of the words are a passage that many documents share
    rows += [(2000 + i, " ".join(base[:60] + [f"p{i}_{j}" for j in range(60)])) for i in range(60)]
    check(spark, rows)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_weighted_signatures_estimate_similarity():
    base = np.array([1, 2, 3], np.uint64)
    p, q = np.array([3, 1, 2.5]), np.array([1, 1, 2.0])
    same = [
        (N.dart_signature(N.mix(base + np.uint64(i * 10)), p, 64) == N.dart_signature(N.mix(base + np.uint64(i * 10)), q, 64)).mean()
        for i in range(300)
    ]
    assert abs(np.mean(same) - 4 / 6.5) < 0.02


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 100), (7, 7), (None, 3)]
    out = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in out} == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_prefix_filter_takes_over(spark):
    """Many documents that share nine tenths of a passage's buckets but are no duplicates, with
    pairs of duplicates hidden among them."""
    rng = random.Random(9)
    passage = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(120):
        tail = [f"t{i}_{j}" for j in range(60)]
        rows.append((i, " ".join(passage + tail)))
        if i % 10 == 0:
            rows.append((1000 + i, edited(passage + tail, 1, rng)))
    check(spark, rows)
    for weighting in ("set", "count"):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        buckets = N.prefix_members(common.written(N.shingle_sets(docs.selectExpr("doc_id AS id", "text"), weighting), "sets"), 0.8)
        met = {tuple(sorted((a, b))) for ns in buckets.groupBy("bucket").agg({"node": "collect_list"}).collect() for a in ns[1] for b in ns[1] if a != b}
        assert {(i, 1000 + i) for i in range(0, 120, 10)} <= met


def test_weighted_classes(spark):
    """With weights, repetitions count: half of a repeated text is no near copy of the whole."""
    from collections import Counter

    line = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{line} " * 10), (2, f"{line} " * 5), (3, f"{line} " * 9), (4, f"{line} " * 10 + "end"), (5, " ".join(f"v{i}" for i in range(50)))]

    def similarity(a, b):
        bags = [Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in (a, b)]
        return sum((bags[0] & bags[1]).values()) / sum((bags[0] | bags[1]).values())

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in N.near_duplicates(docs, weighting="count").collect()}
    assert similarity(rows[0][1], rows[1][1]) < 0.8 <= similarity(rows[0][1], rows[2][1])
    assert got == {1: 1, 2: 2, 3: 1, 4: 1, 5: 5}
    plain = {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()}
    assert plain == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_hot_buckets_are_split(spark, monkeypatch):
    """With every bucket of two nodes or more treated as hot, and few of them broadcast, the classes
    are the same."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    rng = random.Random(6)
    base, passage = [f"w{i}" for i in range(100)], [f"p{i}" for i in range(90)]
    rows = [(i, edited(base, 1 + i % 3, rng)) for i in range(60)] + [(100 + i, " ".join(base)) for i in range(40)]
    rows += [(200 + i, " ".join(passage + [f"t{i}_{j}" for j in range(40)])) for i in range(60)] + [(300, edited(base[:50], 30, rng))]
    check(spark, rows)


def test_ids_that_stand_for_several_texts(spark):
    words = [f"w{i}" for i in range(40)]
    a, b, c = " ".join(words), " ".join(reversed(words)), " ".join(words[20:] + words[:20])
    rows = [(1, b), (1, a), (2, a), (3, b), (4, c), (4, c), (4, None), (None, a)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, k % 2) for k, (i, t) in enumerate(order)], "doc_id long, text string, n int")
        out = N.near_duplicates(docs).collect()
        got = {(r.doc_id, r.class_id, r.class_size) for r in out}
        assert len(out) == len(rows) and got == {(1, 1, 4), (2, 1, 4), (3, 1, 4), (4, 4, 3), (None, None, None)}
        kept = sorted((str(r.doc_id), r.text) for r in N.one_of_each(docs).collect())
        assert kept == [("1", min(a, b)), ("4", None), ("None", a)]


def test_recall_against_all_pairs(spark):
    """Every pair of 0.8 or more between the rows whose id is divisible by 50 and all rows."""
    sf = "/root/testdata/sf0.1"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: shingle_set(t) for i, t in rows}
    holders: dict = {}
    queries = [i for i in sets if i % 50 == 0]
    wanted = {s for i in queries for s in sets[i]}
    for i, s in sets.items():
        for x in s & wanted:
            holders.setdefault(x, []).append(i)
    classes = {r.doc_id: r.class_id for r in N.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    pairs = found = 0
    for i in queries:
        shared: dict = {}
        for x in sets[i]:
            for j in holders[x]:
                shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if j != i and n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-12:
                pairs += 1
                found += classes[i] == classes[j]
    print("recall", found, pairs)
    assert pairs > 50 and found >= 0.99 * pairs
