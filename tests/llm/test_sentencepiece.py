"""The chunk table against the library's own encode() and decode()."""

import hashlib
import random

from palimpsest.llm import sentencepiece_table as S
from palimpsest.llm.queries import op9_sentencepiece

SF = "/root/testdata/sf0.001"


def test_random_strings():
    t = S.ChunkTable(S.tokenizer_path("piece_bpe_32k.model"), table_rows=500, long_chunk=8)
    rng = random.Random(3)
    for _ in range(8000):
        s = "".join(rng.choice("ab  ▁é\n\t😀the.ing　\x00ß日") for _ in range(rng.randrange(14)))
        ids = t.model.encode(s)
        assert t.encode(s).tolist() == ids and t.decoded(s) == t.model.decode(ids), repr(s)
    for s in ("", " ", "   ", "x" * 50000, "a b " * 20000, "▁", " ▁ "):
        ids = t.model.encode(s)
        assert t.encode(s).tolist() == ids and t.decoded(s) == t.model.decode(ids)


def test_documents(spark):
    sp = S.ChunkTable(S.tokenizer_path("piece_bpe_32k.model")).model
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = op9_sentencepiece(spark, SF).collect()
    assert len(out) == len(text)
    for r in out:
        ids = sp.encode(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "a b", None), (None, "a b", None)], "doc_id long, text string, n_tokens string")
    out = S.encode(docs, ids=True).collect()
    assert sorted(r.n_tokens for r in out) == [0, 0, 2, 2] and all(len(r.ids) == r.n_tokens for r in out)
    assert S.encode(docs.limit(0)).count() == 0


def test_blocks_and_pieces(monkeypatch):
    """Whole blocks in Arrow, and texts cut into pieces of a few characters, give the library's ids."""
    monkeypatch.setattr(S, "PIECE", 9)
    monkeypatch.setattr(S, "BLOCK", 60)
    t = S.ChunkTable(S.tokenizer_path("piece_bpe_32k.model"), table_rows=40, long_chunk=6)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab  ▁é\nthe. ing😀ß日") for _ in range(rng.randrange(60))) for _ in range(4000)] + ["", " ", "a" * 40, "a b" * 30]
    for ids in (False, True):
        for text, (n, numbers, words, kept) in zip(texts, t.digests(texts, ids), strict=True):
            want = t.model.encode(text)
            assert n == len(want) and numbers == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), repr(text)
            assert words == hashlib.sha256(t.model.decode(want).encode()).hexdigest()
            assert kept is None if not ids else kept.tolist() == want


def test_a_very_long_text(spark):
    long = "some words of a text  with spaces " * 100_000
    docs = spark.createDataFrame([(1, long), (2, long.replace("  ", " ").strip())], "doc_id long, text string")
    sp = S.ChunkTable(S.tokenizer_path("piece_bpe_32k.model")).model
    for r, text in zip(S.encode(docs, ids=True, decoded=True).orderBy("doc_id").collect(), (long, long.replace("  ", " ").strip())):
        assert r.ids == sp.encode(text) and r.n_tokens == len(r.ids) and r.decoded == sp.decode(r.ids)
