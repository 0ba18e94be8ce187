"""SentencePiece encoding and decoding through a table of distinct marked words.

No piece of the vocabulary crosses a white-space marker (checked on loading), so merges never do
either, and a text is a sequence of chunks `marker run + word` that are segmented independently.
A block of texts is cut into chunks once; the distinct ones are looked up in the task's table of
(number of ids, ids, decoded chunk), those that the table lacks are segmented, and the entries are
joined back by position, column by column in Arrow. The table is emptied when it reaches
`table_rows`, which bounds memory and loses nothing; chunks longer than `long_chunk` bypass it.
A table for the whole corpus would have to shuffle every word with its place (see the README for
the figures); the table of a task reuses the same words without moving any.

Texts of more than PIECE characters and those with runs of spaces go by pieces, so a very long text
needs no more memory than a piece and its ids.

Defined results: a null or empty text has no ids; the marker character itself in a text counts
as a space, as in the library; repeated rows are encoded one by one; other columns pass through
unless their names are those of the results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm.common import slices, small_batches

MARK = "▁"
#: Characters of a text, and of a block of texts, that are cut into chunks at once.
PIECE, BLOCK = 1 << 20, 1 << 24
_CHUNK = re.compile(r" *[^ ]+| +")
Entry = tuple[int, str, str]


def pieces(text: str, size: int) -> Iterator[str]:
    """A text that begins with a space, cut before the first of a run of spaces, so that no chunk
    is cut; of about `size` characters each."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        while end > 0 and text[end - 1] == " ":  # the run begins earlier, or goes on
            end -= 1
        if end <= at:
            end = next((m.end() for m in _CHUNK.finditer(text, at)), len(text))
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


class ChunkTable:
    """Encodes texts of one model; identical to the library's encode() and decode()."""

    def __init__(self, path: str, table_rows: int = 300_000, long_chunk: int = 200):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a white-space marker; chunks can't be segmented alone")
        self.mark_id = self.model.piece_to_id(MARK)
        self.table: dict[str, Entry] = {}
        self.table_rows, self.long_chunk = table_rows, long_chunk

    def _segment(self, chunks: list[str]) -> list[Entry]:
        """Entries of chunks, each given without its first marker; "" is a marker alone."""
        ids = self.model.encode(chunks, num_threads=1)
        ids = [x or [self.mark_id] for x in ids]
        words = self.model.decode(ids, num_threads=1)
        return [(len(x), ",".join(map(str, x)), w) for x, w in zip(ids, words, strict=True)]

    def lookup(self, chunks: list[str]) -> list[Entry]:
        """The entries of distinct chunks, each given without its first marker."""
        table = self.table
        found = list(map(table.get, chunks))
        new = [x for x, e in zip(chunks, found, strict=True) if e is None]
        if new:
            made = dict(zip(new, self._segment(new), strict=True))
            if len(table) + len(new) > self.table_rows:
                table.clear()
            table.update((x, e) for x, e in made.items() if len(x) <= self.long_chunk)
            found = [made[x] if e is None else e for x, e in zip(chunks, found, strict=True)]
        return found

    def entries(self, text: str) -> Iterator[list[Entry]]:
        """The entries of a text's chunks in order of position, by pieces."""
        if not text:
            return
        for piece in pieces(" " + text.replace(MARK, " "), PIECE):
            chunks = [x[1:] for x in _CHUNK.findall(piece)]
            distinct = list(dict.fromkeys(chunks))
            of = dict(zip(distinct, self.lookup(distinct), strict=True))
            yield [of[x] for x in chunks]

    def one(self, text: str, ids: bool = False) -> tuple[int, str, str, np.ndarray | None]:
        """Of any text: number of ids, their SHA-256, that of the decoded text, and with ids=True
        the ids."""
        n, numbers, words, kept = 0, hashlib.sha256(), hashlib.sha256(), []
        for k, found in enumerate(self.entries(text)):
            n += sum(e[0] for e in found)
            listed = ",".join([e[1] for e in found])
            numbers.update(("," if k else "").encode() + listed.encode())
            words.update((" " if k else "").encode() + " ".join([e[2] for e in found]).encode())
            if ids:
                kept.append(np.array(listed.split(","), np.int32))
        joined = np.concatenate(kept) if kept else np.zeros(0, np.int32)
        return n, numbers.hexdigest(), words.hexdigest(), joined if ids else None

    def block(self, texts: list[str], ids: bool = False) -> list[tuple[int, str, str, np.ndarray | None]]:
        """one() of texts without runs of spaces, which single spaces cut into chunks."""
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        flat = lists.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        found = self.lookup(distinct)
        at, starts = flat.indices, lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        ends = np.append(starts, len(at)).astype(np.int32)
        place = at.to_numpy()
        counts = np.array([e[0] for e in found], np.int64)[place]
        n = np.add.reduceat(counts, starts)
        joined = lambda column, by: pc.binary_join(pa.ListArray.from_arrays(ends, pa.array(column, pa.string()).take(at)), by)
        numbers = joined([e[1] for e in found], ",").to_pylist()
        same = all(e[2] == x for e, x in zip(found, distinct, strict=True))
        words = texts if same else joined([e[2] for e in found], " ").to_pylist()
        sha = lambda x: hashlib.sha256(x.encode("utf-8")).hexdigest()
        kept: list = [None] * len(texts)
        if ids:
            each = [np.array(e[1].split(","), np.int32) for e in found]
            begins = np.cumsum([0, *(len(x) for x in each)])[:-1]
            whole = np.concatenate(each)
            run = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            kept = np.split(whole[np.repeat(begins[place], counts) + run], np.cumsum(n)[:-1])
        return [(int(c), sha(a), sha(b), k) for c, a, b, k in zip(n, numbers, words, kept, strict=True)]

    def digests(self, texts: list[str], ids: bool = False) -> list[tuple[int, str, str, np.ndarray | None]]:
        out: list = [None] * len(texts)
        held: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                for i, row in zip(held, self.block([texts[i] for i in held], ids), strict=True):
                    out[i] = row
            held, size = [], 0

        for i, text in enumerate(texts):
            simple = text and len(text) <= PIECE and "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text
            if not simple:
                out[i] = self.one(text, ids)
                continue
            held.append(i)
            size += len(text)
            if size > BLOCK:
                flush()
        flush()
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.one(text, True)[3]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, their SHA-256 and that of the decoded text."""
        return self.digests([text])[0][:3]

    def decoded(self, text: str) -> str:
        return " ".join(word for found in self.entries(text) for _, _, word in found)


_LOADED: dict[str, ChunkTable] = {}


def chunk_table(path: str) -> ChunkTable:
    """One table for each model and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ChunkTable(path)
    return _LOADED[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text", ids: bool = False, decoded: bool = False) -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256 and decoded_sha256, and if asked for also
    `ids` (array of int) and `decoded` (string). `model` is a file of the tokenizers' folder,
    looked up on each executor, or an absolute path."""
    small_batches(docs.sparkSession)
    passed = [c for c in docs.columns if c not in (text, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")]
    made = [("n_tokens", pa.int64(), T.LongType()), ("ids_sha256", pa.string(), T.StringType()), ("decoded_sha256", pa.string(), T.StringType())]
    if ids:
        made.append(("ids", pa.list_(pa.int32()), T.ArrayType(T.IntegerType())))
    if decoded:
        made.append(("decoded", pa.string(), T.StringType()))
    schema = T.StructType([docs.schema[c] for c in passed] + [T.StructField(n, t) for n, _, t in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model if model.startswith("/") else tokenizer_path(model))
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(text).to_pylist()]
            found = table.digests(texts, ids)
            out = [[row[k] for row in found] for k in range(4 if ids else 3)]
            if decoded:
                out.append([table.decoded(x) for x in texts])
            columns = [batch.column(c) for c in passed] + [pa.array(v, t) for v, (_, t, _) in zip(out, made, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=passed + [n for n, _, _ in made])

    return docs.select(*passed, docs[text].cast("string").alias(text)).mapInArrow(run, schema)
