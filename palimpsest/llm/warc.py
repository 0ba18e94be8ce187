r"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame per record.

Writing. Each task cuts its records into archives of about `archive_bytes`. An archive begins with
a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed, trained on a
bounded even spread of the archive's own records; then comes one frame with checksum and content
size for each record. Archives are rows (archive, content) that Spark writes like any table, so
lost executors and failed tasks are covered by its commit; `export_archives` puts them into plain
.warc.zst files of a mounted folder.

Of the records whose payloads of at least MIN_REVISIT bytes are equal, the one with the least id
is a response and the others are revisits that refer to it.

Reading. The dictionary is loaded from the leading frame. The block headers of each frame are
walked to find its end; the frame is decoded alone, and its record is checked: version line,
required headers, block length against Content-Length, HTTP length against the payload, payload
digest, and the closing blank lines. A record that fails gives a row with `error`.

Defined results: a null payload counts as empty; a null or blank URL is replaced by the record's
own URN, and control characters and blanks in URLs are percent-encoded; a record without an id is
never referred to; repeated rows with the least id are all responses; other columns are not read;
an empty table gives no archive."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import meet, small_batches, written

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"

MIN_REVISIT = 100
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLES, SAMPLE_BYTES = 128, 8 << 10
#: Bytes of a record that are read at most: more than a Spark value with its headers can have.
MAX_RECORD = (1 << 31) + (1 << 20)
URN = "urn:palimpsest:page:"


def _uri(url: str | None, page_id: int | None) -> str:
    url = (url or "").strip()
    if not url:
        return f"{URN}{'' if page_id is None else page_id}"
    return re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or with refers_to a revisit record, whose block has no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url, page_id)}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def make_archive(records: list[bytes]) -> bytes:
    """The records as one archive; without a dictionary if there is too little to train one on."""
    step = max(1, len(records) // SAMPLES)
    samples = [r[:SAMPLE_BYTES] for r in records[::step][:SAMPLES]]
    parts: list[bytes] = []
    dictionary = None
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
        stored = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
        parts.append(struct.pack("<II", DICTIONARY_MAGIC, len(stored)) + stored)
        dictionary.precompute_compress(level=3)
    except zstandard.ZstdError:
        dictionary = None
    packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
    return b"".join(parts + [packer.compress(r) for r in records])


def frames(content: bytes) -> Iterator[tuple[int, int]]:
    """Start and end of each skippable or compressed frame."""
    at = 0
    while at < len(content):
        if at + 8 > len(content):
            raise ValueError(f"truncated frame at {at}")
        magic, size = struct.unpack_from("<II", content, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + size
        elif magic == FRAME_MAGIC:
            head = content[at : at + 18]
            end = at + zstandard.frame_header_size(head)
            last = False
            while not last:
                if end + 3 > len(content):
                    raise ValueError(f"truncated frame at {at}")
                block = int.from_bytes(content[end : end + 3], "little")
                last = bool(block & 1)
                end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            end += 4 * zstandard.get_frame_parameters(head).has_checksum
        else:
            raise ValueError(f"no frame at {at}")
        if end > len(content):
            raise ValueError(f"truncated frame at {at}")
        yield at, end
        at = end


def parse_record(record: bytes) -> dict:
    """The fields of a record; ValueError if it isn't valid."""
    head, blank, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or lines[0] not in (VERSION, b"WARC/1.0"):
        raise ValueError("no WARC version line or no end of headers")
    found: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line[:60]!r}")
        found[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-target-uri", "content-length"):
        if name not in found:
            raise ValueError(f"header {name} is missing")
    length = int(found["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, Content-Length is {length}")
    http, blank, payload = rest[:length].partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    if not blank or not http.startswith(b"HTTP/") or not stated:
        raise ValueError("bad HTTP headers")
    digest = found.get("warc-payload-digest", "").removeprefix("sha256:")
    size = int(stated[1])
    if found["warc-type"] == "response":
        if size != len(payload):
            raise ValueError(f"payload of {len(payload)} bytes, HTTP length is {size}")
        if digest != hashlib.sha256(payload).hexdigest():
            raise ValueError("payload digest differs")
    elif found["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in found or found.get("warc-profile") != PROFILE or len(digest) != 64:
            raise ValueError("bad revisit record")
    else:
        raise ValueError(f"record type {found['warc-type'][:20]}")

    def page(name: str) -> int | None:
        value = found.get(name, "").strip("<>").removeprefix(URN)
        return int(value) if value else None

    return {
        "page_id": page("warc-record-id"),
        "url": found["warc-target-uri"],
        "record_type": found["warc-type"],
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": page("warc-refers-to"),
        "payload": payload if found["warc-type"] == "response" else None,
    }


def parse_archive(content: bytes) -> Iterator[dict]:
    """The fields of each record, or {"error": ...} for one that isn't valid."""
    reader = zstandard.ZstdDecompressor()
    try:
        for start, end in frames(content):
            frame = content[start:end]
            magic = struct.unpack_from("<I", frame)[0]
            if magic == DICTIONARY_MAGIC and start == 0:
                stored = frame[8:]
                if stored[:4] == struct.pack("<I", FRAME_MAGIC):
                    stored = zstandard.ZstdDecompressor().decompress(stored, max_output_size=MAX_RECORD)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stored))
            if magic != FRAME_MAGIC:
                continue
            try:
                size = zstandard.get_frame_parameters(frame).content_size
                if size > MAX_RECORD:
                    raise ValueError("record without size or too large")
                record = reader.decompress(frame, max_output_size=size)
                if len(record) != size:
                    raise ValueError("frame shorter than stated")
                yield parse_record(record)
            except (ValueError, zstandard.ZstdError) as e:
                yield {"error": f"frame at {start}: {e}"}
    except (ValueError, zstandard.ZstdError) as e:
        yield {"error": str(e)}


def planned(pages: DataFrame, page_id: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """id, url, payload and refers_to (null for a response) of each page. Equal payloads meet by
    digest; digests seen more than once are joined back, those of the most pages by broadcast, so
    that the copies of the commonest payload stay where they are."""
    rows = pages.select(
        pages[page_id].cast("long").alias("id"),
        pages[url].cast("string").alias("url"),
        F.coalesce(pages[payload].cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    first = (
        rows.filter(F.octet_length("payload") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1 and first is not null")
    )
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    found = meet(rows, written(first, "digests"), ["digest"], "copies", how="left")
    return found.select("id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(plan: DataFrame, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A planned table as archives: (archive string, content binary)."""
    small_batches(plan.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        records: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:05d}-{made:05d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([make_archive(records)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                cut = batch.slice(at, 64)
                for page, url, text, refers in zip(*(cut.column(i).to_pylist() for i in range(4)), strict=True):
                    records.append(make_record(page, url, text.encode("utf-8", "surrogatepass"), refers, date))
                    size += len(records[-1])
                    if size >= archive_bytes:
                        yield flush()
                        made, records, size = made + 1, [], 0
        if records:
            yield flush()

    return plan.select("id", "url", "payload", "refers_to").mapInArrow(run, "archive string, content binary")


RECORD = "archive string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (archive, content), such as those of write_archives, or of
    spark.read.format("binaryFile") with its path named archive. payloads=False leaves them out."""
    fields = [x.rsplit(" ", 1) for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                name = batch.column(0)[at].as_py()
                found: list[dict] = []
                size = 0
                for record in parse_archive(batch.column(1)[at].as_py() or b""):
                    record["archive"] = name
                    if not payloads:
                        record.pop("payload", None)
                    size += len(record.get("payload") or b"")
                    found.append(record)
                    if len(found) >= 4096 or size > ARCHIVE_BYTES:
                        yield rows(found)
                        found, size = [], 0
                if found:
                    yield rows(found)

    def rows(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in found], _TYPES[t]) for n, t in fields], names=[n for n, _ in fields])

    return archives.select("archive", "content").mapInArrow(run, RECORD)


def export_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Write archives as files of a folder that is mounted on every machine; gives name and size.
    A file is written under another name and then renamed, so a repeated task does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1).to_pylist(), strict=True):
                part = Path(folder, f".{name}.{TaskContext.get().taskAttemptId()}")
                part.write_bytes(content)
                part.rename(Path(folder, name))
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], names=["archive", "bytes"])

    return archives.select("archive", "content").mapInArrow(run, "archive string, bytes long")
