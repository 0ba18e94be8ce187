"""The two classifiers: gradients, held-out accuracy, and defined results."""

import numpy as np

from palimpsest.llm import quality_model as Q
from palimpsest.llm import toxicity as X
from palimpsest.llm.labelled import auc, remainder, training_rows
from palimpsest.llm.queries import op1_quality_classifier, op5_toxicity

SF = "/root/testdata/sf0.01"


def test_network_gradients():
    net = Q.Network(seed=3)
    for k in net.params:
        net.params[k] = net.params[k].astype(np.float64)
    docs, label = [Q._bytes("some text " * 90), Q._bytes("WORDS!! " * 30)], np.array([1.0, 0.0])

    def loss():
        total = 0.0
        for b, y in zip(docs, label, strict=True):
            v = (net.vector(b) - net.params["mean"]) / net.params["scale"]
            p = 1 / (1 + np.exp(-(v @ net.params["dense"] + net.params["bias"][0])))
            total -= y * np.log(p) + (1 - y) * np.log(1 - p)
        return total / len(docs)

    grads = net._step(docs, label)
    rng = np.random.default_rng(1)
    for k, g in grads.items():
        flat = net.params[k].reshape(-1)
        for i in rng.choice(np.flatnonzero(np.abs(g.reshape(-1)) > 1e-6), 4):
            old, step = flat[i], 1e-6
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - g.reshape(-1)[i]) < 1e-4 + 0.02 * abs(g.reshape(-1)[i])


def test_whole_text_counts():
    net = Q.Network()
    text = "plain words of a text " * 20000
    short, long = net.score(text), net.score(text + "*** $$$ ### " * 2000)
    assert short != long
    assert net.score("") == net.score(" \n") == 0


def test_noisy_or_locates_sentences():
    rows = [(f"A plain sentence {i}. Another one here.", 0) for i in range(60)]
    rows += [(f"A plain sentence {i}. You vile gnome of doom. Another one.", 1) for i in range(30)]
    model = X.train(rows)
    text = "Nothing here. What a vile gnome! All is well."
    score, offending = model.scored(text)
    assert score > 0.5 and [text[a:b] for a, b, _ in offending] == [" What a vile gnome"]
    assert model.scored("Nothing here. All is well.")[0] < 0.5
    assert str(model.scored("")[0]) == "0.0" and X.train([]).scored("vile")[0] < 1e-9


def _held_out(spark, frame, label):
    rows = frame.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").select("score", "predicted", label).collect()
    return np.array([r.score for r in rows]), np.array([r[label] for r in rows])


def test_held_out_accuracy(spark):
    score, label = _held_out(spark, op5_toxicity(spark, SF), "toxic")
    assert auc(score, label) > 0.9  # 319 labelled documents to learn from
    assert (score[label == 1] >= 0.5).mean() >= 0.8 and (score[label == 0] >= 0.5).mean() <= 0.05
    score, label = _held_out(spark, op1_quality_classifier(spark, SF), "quality")
    assert auc(score, label) > 0.9
    assert (score[label == 1] >= 0.7).mean() > 0.95 and (score[label == 0] >= 0.7).mean() < 0.25


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "x y z", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert training_rows(docs, labels, "toxic", remainder("doc_id", 5) >= 0, 10, 100) == []
    assert sorted(r.score for r in X.score_toxicity(docs, X.train([])).collect())[0] == 0
    assert {r.score for r in Q.score_quality(docs, Q.train([])).collect()} == {0.5, 0.0}
    assert Q.score_quality(docs.limit(0), None).count() == 0


def plain_quality(net, text):
    """The forward pass written out: chunk by chunk, window by window."""
    if not text.strip():
        return 0.0
    p, b = net.params, text.encode("utf-8", "surrogatepass")
    vectors = []
    for begin in range(0, max(1, -(-len(b) // Q.HALF) - 1) * Q.HALF, Q.HALF):
        windows = [b[i : i + Q.WIDTH].ljust(Q.WIDTH) for i in range(begin, begin + Q.CHUNK, Q.STRIDE)]
        rows = np.array([p["embed"][list(w)].reshape(-1) for w in windows]).reshape(len(windows), -1)
        vectors.append(np.maximum(rows @ p["filter"] + p["shift"], 0).max(0))
    v = (np.concatenate((np.mean(vectors, 0), np.max(vectors, 0))) - p["mean"]) / p["scale"]
    return float(1 / (1 + np.exp(-(v @ p["dense"] + p["bias"][0]))))


def test_quality_against_a_plain_forward_pass(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    net = Q.train(training_rows(docs, labels, "quality", remainder("doc_id", 4) != 2, Q.SAMPLE_DOCS, Q.SAMPLE_CHARS))
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1: "", -2: None, -3: "short", -4: "é" * 300, -5: "x" * 255, -6: "y " * 400_000}
    odd = spark.createDataFrame([(i, t) for i, t in texts.items() if i < 0], "doc_id long, text string")
    got = {r.doc_id: r.score for r in Q.score_quality(docs.select("doc_id", "text").unionByName(odd), net).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        assert abs(got[i] - plain_quality(net, t or "")) < 1e-4, i
    registered = {r.doc_id: r.score for r in op1_quality_classifier(spark, "/root/testdata/sf0.001").collect()}
    assert registered == {i: s for i, s in got.items() if i >= 0}


def plain_toxicity(model, text):
    import re

    clean = 1.0
    for sentence in re.split(r"[.!?\n]", text):
        words = set(re.findall(r"[^\W\d_]+", sentence.lower()))
        if words:
            z = model.bias
            for w in words:
                z += model.weight.get(w, 0.0) + sum(model.weight.get(w[:n] + "-", 0.0) for n in X.PREFIXES if len(w) > n)
            clean *= 1 - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return 1 - clean


def test_toxicity_against_a_plain_noisy_or(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = X.train(training_rows(docs, labels, "toxic", remainder("doc_id", 5) != 0, X.SAMPLE_DOCS, X.SAMPLE_CHARS))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op5_toxicity(spark, SF).collect():
        assert abs(r.score - plain_toxicity(model, texts[r.doc_id])) < 1e-6
        assert r.predicted == (r.score >= 0.5)
    long = spark.createDataFrame([(1, "word. " * 300_000), (1, "word. " * 300_000)], "doc_id long, text string")
    assert len({r.score for r in X.score_toxicity(long, model).collect()}) == 1


def test_samples_do_not_depend_on_the_layout(spark):
    from palimpsest.llm.common import hash_sample

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(docs.filter("doc_id < 50"))
    one, many = docs.coalesce(1), docs.repartition(64, "text")
    for rows, chars in ((50, 10**9), (10**6, 100_000), (100, 20_000), (10**6, 10**9)):
        assert hash_sample(one, "text", rows, chars) == hash_sample(many, "text", rows, chars)
        usable = remainder("doc_id", 4) != 2
        a, b = (training_rows(x, y, "quality", usable, rows, chars) for x, y in ((one, labels), (many, labels.repartition(64, "doc_id"))))
        assert a == b and len(a) <= rows and sum(len(t) for t, _ in a) <= chars and a
    assert len(hash_sample(one, "text", 10**6, 10**9)) == docs.filter("text <> ''").select("text").distinct().count()


def test_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a plain text", "x", 5)] * 3 + [(1, "another", "y", 6)], "doc_id long, text string, score string, offending int")
    net, model = Q.Network(), X.train([("a plain text", 1), ("b", 0), ("c", 0)] * 9)
    quality, toxic = Q.score_quality(docs, net), X.score_toxicity(docs, model)
    assert quality.columns == ["doc_id", "offending", "score"] and toxic.columns == ["doc_id", "score", "offending"]
    assert len({r.score for r in quality.collect()}) == 2 and len(toxic.collect()) == 4
