"""Base patterns against plain regular expressions, and the field against exhaustive sums."""

import hashlib
import itertools
import random
import re

import numpy as np

from palimpsest.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and P.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_patterns():
    rng = random.Random(2)
    for _ in range(20000):
        kinds = ["0123456789", ". -+()@", "ab.%é\n٣", "a@b.c "]
        s = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(40)))
        assert P.base_spans(s) == brute(s), s
    long = "1" * 60000 + " " + "a" * 60000 + "@ " + "+1" + "(" * 60000 + " x.y@z.w"
    assert [k for _, k, _ in P.base_spans(long)] == [0]


def exact(w, g):
    n, k = len(g.spans), len(P.LABELS)
    total = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        s = sum(w.unary[f, l] for fs, l in zip(g.unary, y) for f in fs)
        s += sum(w.chain[y[a], y[b]] for a, b in g.chain) + sum(w.skip[y[a], y[b]] for a, b in g.skip)
        for i, l in enumerate(y):
            total[i, l] += np.exp(s)
    return total / total.sum(1, keepdims=True)


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(0)
    k = len(P.LABELS)
    w = P.Field(rng.normal(0, 0.5, (len(P._NAMES), k)), rng.normal(0, 0.5, (k, k)), rng.normal(0, 0.5, (k, k)))
    g = P.graph("call 1234567 then 9@x.org word 1234567")
    assert g.skip == [(0, 2)] and len(g.spans) == 3
    assert np.allclose(w.marginals(g, rounds=60), exact(w, g), atol=1e-6)


def test_skip_edges_make_labels_agree():
    k = len(P.LABELS)
    w = P.Field(np.zeros((len(P._NAMES), k)), np.zeros((k, k)), 3 * np.eye(k))
    w.unary[P._INDEX["bias"], 0] = 1.0
    w.unary[P._INDEX["before_card"], 3] = 6.0
    text = "card 4111111111111112 " + "word " * 500 + "4111111111111112 " + "word " * 50 + "5500000000000000"
    labels = w.marginals(P.graph(text)).argmax(1)
    assert labels.tolist() == [3, 3, 0]


def test_rows(spark):
    texts = [None, "", "no data", "a@b.co x 10.0.0.1 é +1 (555) 555-0000 4111 1111 1111 1111", "a@b.co " * 3000, "1" * 100000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a@b.co", "x"), (3, texts[3], "x")], "doc_id long, text string, spans string")
    docs = docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text", "lang AS spans"))
    text_of = {r.doc_id: r.text or "" for r in docs.collect()}
    out = P.find_pii(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        base = brute(text_of[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in base) for i in range(4))
        assert r.base_sha256 == hashlib.sha256(P.listed(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(P.listed(base).split(",")) - {""} <= set(spans) and len(spans) == len(base) + r.n_added
    assert P.find_pii(docs.limit(0)).count() == 0
