"""Benchmark decontamination: a q-gram filter over diagonal bands, then banded alignment.

An item of m characters that occurs with at most e edits keeps m + 1 - q * (e + 1) of its q-grams,
all on diagonals (document position less item position) that differ by no more than e. So

1. the q-grams of each whole document are looked up in a bit table of all items' q-grams, and only
   stretches of the document that hold enough hits for the least demanding item go on;
2. hits there are dealt to overlapping diagonal bands, each of which contains every set of e + 1
   neighbouring diagonals, and the distinct item positions in a band are counted;
3. bands that meet an item's bound are verified by alignment within the band.

No occurrence within the edit budget can be missed: each step only drops what cannot be one.

The benchmark is the query set. It is read in blocks of at most `block_chars` characters; each
block goes to the tasks and meets all documents, so what is shipped is bounded however large the
benchmark is. After BLOCKS_A_PLAN blocks the result so far is written, so neither the plan nor what
it carries grows with the benchmark, of which the driver holds so many blocks at most. Documents
are never shuffled.

Texts are compared in lower case with white space collapsed; offsets are those of the text itself.

Defined results: null or empty documents match nothing; null, empty and blank items are matched by
nothing; an item too short for one q-gram beyond its budget has its budget lowered until the bound
is positive, and items shorter than q characters are searched for exactly; repeated rows give
repeated results; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import slices, small_batches, written

Q = 10
MAX_EDIT_SHARE = 0.08
BLOCK_CHARS, BLOCKS_A_PLAN = 2_000_000, 4
_BITS = 22
_MULT = 0x9E3779B97F4A7C15


def normalized(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def origins(text: str) -> list[int]:
    """For each character of normalized(text), the place in text that it comes from, and the end."""
    out: list[int] = []
    blank = True
    end = 0
    for i, c in enumerate(text):
        if c.isspace():
            blank = True
            continue
        if blank and out:
            out.append(end)
        blank = False
        out += [i] * len(c.lower())
        end = i + 1
    return [*out, end]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q-gram, from hashes of runs of 1, 2, 4, ... characters."""
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run, width, done, out = c + np.uint64(1), 1, 0, np.zeros(n, np.uint64)
    while True:
        if q & width:
            out = out * np.uint64(pow(_MULT, width, 1 << 64)) + run[done : done + n]
            done += width
        if done == q:
            break
        run = run[:-width] * np.uint64(pow(_MULT, width, 1 << 64)) + run[width:]
        width *= 2
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def align_in_band(item: np.ndarray, doc: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(edits, start, end) of the cheapest alignment of the whole item whose diagonals are in
    [low, high). Row i of the table holds, for diagonal d, the cost of the first i characters of
    the item ended at document position i + d; beginnings are free."""
    d = np.arange(low, high)
    far = 1 << 20
    cost = np.where((d >= 0) & (d <= len(doc)), 0, far)
    start = d.copy()
    step = np.arange(len(d))
    padded = np.full(len(doc) + 2 * (high - low) + len(item) + 2, 1 << 40, np.int64)
    shift = high - low + 1
    padded[shift : shift + len(doc)] = doc
    for i in range(1, len(item) + 1):
        j = d + i
        at = np.clip(j - 1 + shift, 0, len(padded) - 1)
        new, new_start = cost + (padded[at] != item[i - 1]), start
        up, up_start = np.append(cost[1:], far) + 1, np.append(start[1:], 0)
        better = up < new
        new, new_start = np.where(better, up, new), np.where(better, up_start, new_start)
        new = np.where((j < 0) | (j > len(doc)), far, new)
        least = np.minimum.accumulate(new - step)
        source = np.maximum.accumulate(np.where(new - step == least, step, 0))
        cost, start = least + step, new_start[source]
        cost = np.where((j < 0) | (j > len(doc)), far, cost)
    best = int(np.argmin(cost))
    return int(cost[best]), int(start[best]), int(d[best] + len(item))


class Items:
    """A block of benchmark items with the q-gram index that the filter needs."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, share: float = MAX_EDIT_SHARE):
        self.q = q
        self.ids: list = []
        self.words: list[str] = []
        self.codes: list[np.ndarray] = []
        self.short: list[tuple[int, str]] = []
        budgets, bounds = [], []
        for item_id, text in items:
            text = normalized(text)
            if not text:
                continue
            if len(text) < q:
                self.short.append((item_id, text))
                continue
            budget = min(int(share * len(text)), (len(text) - q) // q)
            self.ids.append(item_id)
            self.words.append(text)
            self.codes.append(codes(text).astype(np.int64))
            budgets.append(budget)
            bounds.append(len(text) + 1 - q * (budget + 1))
        self.budget, self.bound = np.array(budgets, np.int64), np.array(bounds, np.int64)
        self.length = np.array([len(c) for c in self.codes], np.int64)
        grams = [gram_hashes(c.astype(np.uint64), q) for c in self.codes]
        all_grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(all_grams, kind="stable")
        self.gram = all_grams[order]
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.pos = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.zeros(0, np.int64)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.gram >> np.uint64(64 - _BITS)] = True
        # For items of similar length: least hits asked for, and the longest stretch that they fill.
        octave = np.log2(np.maximum(self.length, 1)).astype(int) * 2 + (self.length * self.length >= 2 * 4.0 ** np.log2(np.maximum(self.length, 1)).astype(int))
        self.demands = [
            (int(self.bound[octave == o].min()), int((self.length + self.budget)[octave == o].max())) for o in np.unique(octave)
        ]
        self.band = int(max(16, self.budget.max(initial=0) + 1))

    def candidates(self, c: np.ndarray) -> list[tuple[int, int]]:
        """(item, band) pairs that meet the item's bound; band b covers diagonals from
        b * band on, band + budget of them."""
        h = gram_hashes(c, self.q)
        hit = self.bits[h >> np.uint64(64 - _BITS)]
        at = np.flatnonzero(hit)
        # A hit can matter only if some stretch of `reach` characters around it holds `least` hits.
        mark = np.zeros(len(at) + 1, np.int64)
        for least, reach in self.demands:
            dense = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] < reach) if len(at) >= least else ()
            if len(dense):
                np.add.at(mark, dense, 1)
                np.add.at(mark, dense + least, -1)
        if not mark.any():
            return []
        at = at[np.cumsum(mark[:-1]) > 0]
        left = np.searchsorted(self.gram, h[at], "left")
        count = np.searchsorted(self.gram, h[at], "right") - left
        where = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item, pos = self.item[where], self.pos[where]
        diagonal = np.repeat(at, count) - pos
        band = diagonal // self.band
        again = diagonal - band * self.band < self.budget[item]
        item = np.concatenate((item, item[again]))
        pos = np.concatenate((pos, pos[again]))
        band = np.concatenate((band, band[again] - 1))
        if not len(item):
            return []
        low, wide = int(band.min()), int(band.max() - band.min() + 1)
        key = np.unique(((item * wide) + (band - low)) * (int(self.length.max()) + 1) + pos) // (int(self.length.max()) + 1)
        keys, distinct = np.unique(key, return_counts=True)
        keys = keys[distinct >= self.bound[keys // wide]]
        return [(int(k // wide), int(k % wide) + low) for k in keys]

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) of every occurrence, in normalized offsets; of overlapping
        occurrences of one item the cheapest, leftmost."""
        out = []
        for item_id, word in self.short:
            at = text.find(word)
            while at >= 0:
                out.append((item_id, at, at + len(word), 0))
                at = text.find(word, at + len(word))
        if not self.ids or len(text) < self.q:
            return out
        c = codes(text)
        signed = c.astype(np.int64)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for item, band in self.candidates(c):
            low = band * self.band
            high, first = low + self.band + int(self.budget[item]), max(0, low)
            exact = text.find(self.words[item], first, high - 1 + len(self.words[item]))
            if exact >= 0:  # what the alignment would find, as nothing costs less than no edit
                found.setdefault(item, []).append((0, exact, exact + len(self.words[item])))
                continue
            stretch = signed[first : max(first, high + len(self.words[item]))]
            edits, start, end = align_in_band(self.codes[item], stretch, low - first, high - first)
            start, end = start + first, end + first
            if edits <= self.budget[item]:
                found.setdefault(item, []).append((edits, start, end))
        for item, spans in found.items():
            held: list[tuple[int, int, int]] = []
            for edits, start, end in sorted(spans):
                if all(end <= s or e <= start for _, s, e in held):
                    held.append((edits, start, end))
                    out.append((self.ids[item], start, end, edits))
        return out


def blocks(benchmark: DataFrame, text: str, item_id: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of at most block_chars characters, or one longer item."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter("t is not null")
    for row in rows.toLocalIterator():
        if block and size + len(row.t) > block_chars:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += len(row.t)
    if block:
        yield block


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_text: str = "text",
    item_id: str = "item_id",
    q: int = Q,
    share: float = MAX_EDIT_SHARE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """docs without the rows in whose text an item occurs. Rows are dropped where they are read;
    nothing is shuffled or joined."""
    small_batches(docs.sparkSession)

    def dropper(block: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(block, q, share)
            for batch in slices(batches):
                values = batch.column(text).to_pylist()
                yield batch.filter(pa.array([not (x and items.matches(normalized(x))) for x in values], pa.bool_()))

        return run

    for k, block in enumerate(blocks(benchmark, item_text, item_id, block_chars), 1):
        docs = docs.mapInArrow(dropper(block), docs.schema)
        if k % BLOCKS_A_PLAN == 0:
            docs = written(docs, "clean")
    return docs


SCHEMA = "doc_id long, item_id long, start long, end long, edits int"


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    q: int = Q,
    share: float = MAX_EDIT_SHARE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """A row (doc_id, item_id, start, end, edits) for each occurrence of an item in a document."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[row_id].cast("long").alias("id"), docs[text].cast("string").alias("text"))

    def finder(block: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(block, q, share)
            for batch in slices(batches):
                out: list[tuple] = []
                for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    hits = items.matches(normalized(raw)) if raw else []
                    if hits:
                        back = origins(raw)
                        out += [(doc, i, back[s], back[e - 1] + 1 if e > s else back[s], k) for i, s, e, k in hits]
                columns = list(zip(*out, strict=True)) if out else [()] * 5
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(columns, types, strict=True)],
                    names=["doc_id", "item_id", "start", "end", "edits"],
                )

        return run

    found = None
    for k, block in enumerate(blocks(benchmark, item_text, item_id, block_chars), 1):
        part = rows.mapInArrow(finder(block), SCHEMA)
        found = part if found is None else found.unionByName(part)
        if k % BLOCKS_A_PLAN == 0:
            found = written(found, "found")
    return docs.sparkSession.createDataFrame([], SCHEMA) if found is None else found
