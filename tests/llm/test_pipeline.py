"""The corpus pipeline against a brute-force version."""

import hashlib

import duckdb
import public_tokenizers
import sentencepiece

import corpus_pipeline
from palimpsest.llm.queries import oracles
from tests.llm.test_near_dedup import brute_classes

SF = "/root/testdata/sf0.01"


def test_against_brute_force(spark):
    con = duckdb.connect()
    con.sql(f"CREATE TABLE documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = con.sql(oracles()["op8_quality_rules"]).filter("kept").project("doc_id").fetchall()
    con.sql(f"DELETE FROM documents WHERE doc_id NOT IN ({', '.join(str(i) for (i,) in kept)})")
    docs = con.sql(oracles()["op3_line_dedup"]).project("doc_id, text").fetchall()
    classes = brute_classes(docs)
    docs = [(i, t) for i, t in docs if classes[i] == i]
    norm = lambda x: " ".join(x.lower().split())
    items = [norm(t) for (t,) in con.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    docs = [(i, t) for i, t in docs if not any(x in norm(t) for x in items)]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t in docs:
        ids = sp.encode(t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), ids))
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in out) == sorted(want)
    assert 100 < len(out) < 1000


def test_odd_rows(spark):
    good = " ".join(f"the word{i} of x{i}" for i in range(40))
    rows = [(1, good, "en", "a", 1), (1, good, "en", "a", 1), (2, None, None, None, None), (None, good + " x", "en", "a", 1), (3, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
            assert name == "sentencepiece" or now.columns == docs.columns
        assert sorted(str(r.doc_id) for r in now.collect()) == (["1", "None"] if frame is docs else [])
