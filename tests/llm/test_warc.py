"""Archives: exact round trip, revisits, and records that fail validation."""

import hashlib
import struct

import pytest
import zstandard

from palimpsest.llm import warc as W


def test_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 120_000 + "</p>"
    same = "y" * 100
    rows = [
        (5, "http://a/ b\n", same, 1), (3, None, same, 1), (3, None, same, 1), (9, "u", same, 1), (None, "u", same, 1), (None, "u", "q" * 200, 1),
        (7, "u", "y" * 99, 1), (8, "u", "y" * 99, 1), (10, "u", None, 1), (11, "u", "", 1), (12, "u", big, 1), (13, "u", "é😀\r\n\r\nWARC/1.1", 1),
    ]
    rows += [(100 + i, f"http://h/{i}", f"<html><body>page {i} {'words ' * (i % 50)}</body></html>", 1) for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive int")
    archives = W.write_archives(W.planned(pages), archive_bytes=200_000).cache()
    out = W.read_archives(archives).collect()
    assert not [r.error for r in out if r.error]
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
    want = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        copies = [p for p, _, h, _ in rows if h == html and p is not None]
        first = min(copies, default=None) if len(data) >= 100 else None
        revisit = first is not None and page != first
        want.append((str(page), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want)
    assert {r.payload.decode() for r in out if r.payload is not None} == {h or "" for _, _, h, _ in rows}
    content = archives.collect()
    assert any(struct.unpack_from("<I", a.content)[0] == W.DICTIONARY_MAGIC for a in content)
    W.export_archives(archives, str(tmp_path / "out")).collect()
    files = spark.read.format("binaryFile").load(str(tmp_path / "out")).withColumnRenamed("path", "archive")
    assert W.read_archives(files, payloads=False).count() == len(rows)


def test_invalid_records():
    good = W.make_record(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    assert W.parse_record(good)["payload"] == b"payload"
    for bad in (
        good.replace(b"WARC/1.1", b"WARC/9.9"),
        good.replace(b"payload\r\n", b"payloat\r\n"),
        good.replace(b"WARC-Date", b"WARC-Dat"),
        good[:-1],
        good + b"x",
        good.replace(b"Content-Length: 7", b"Content-Length: 8"),
        good.replace(b"WARC-Type: response", b"WARC-Type: metadata"),
    ):
        with pytest.raises(ValueError):
            W.parse_record(bad)
    archive = W.make_archive([good, good])
    assert [r.get("error") for r in W.parse_archive(archive)] == [None, None]
    assert "error" in list(W.parse_archive(archive[:-3]))[-1]
    frame = bytearray(zstandard.ZstdCompressor(write_checksum=True).compress(good))
    frame[-1] ^= 1
    assert "error" in next(iter(W.parse_archive(bytes(frame))))
    assert list(W.parse_archive(b"")) == []


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.read_archives(W.write_archives(W.planned(pages))).count() == 0


def test_one_payload_of_many_pages(spark, monkeypatch):
    from palimpsest.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 1)
    rows = [(i, f"http://x/{i}", "a" * 200 if i % 3 == 0 else "b" * 150 if i % 3 == 1 else f"{i}" * 100) for i in range(1, 60)]
    plan = W.planned(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.id, r.refers_to) for r in plan) == [(i, {0: 3, 1: 1}.get(i % 3) if i > 3 and i % 3 < 2 else None) for i, _, _ in rows]
