"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into chunks of CHUNK bytes that overlap by half and cover the
whole text. Bytes are embedded; FILTERS learned filters of WIDTH bytes slide over each chunk by
STRIDE; each filter is rectified and max-pooled over the chunk. The chunks' vectors are combined
by their mean and their maximum, and a logistic layer gives one probability.

Texts are padded with spaces to whole half chunks, in training and in scoring alike; a blank text
never goes through the network.

Training: at most SAMPLE_DOCS labelled documents of at most SAMPLE_CHARS characters, whole texts,
mini-batches, gradients through both poolings by hand. Scoring runs chunk blocks of bounded size
through one matrix product each, so memory doesn't grow with a document.

Defined results: null, empty and blank texts hold nothing of quality and score 0;
repeated rows are scored one by one; without usable labels of both kinds every other score is 0.5; other columns
pass through unless their names are those of the results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm.common import slices, small_batches
from palimpsest.llm.labelled import Adam, sigmoid

SAMPLE_DOCS, SAMPLE_CHARS = 4000, 14_000_000
EMBED, WIDTH, STRIDE, FILTERS = 8, 16, 8, 32
HALF = 256
CHUNK = 2 * HALF
#: Bytes that go through the network at once.
BLOCK = 1 << 16
#: Passes over the sample, and the least number of mini-batches that training takes.
EPOCHS, MIN_STEPS, BATCH = 6, 750, 32
PER_HALF = HALF // STRIDE


def _bytes(text: str, shift: int = 0) -> np.ndarray:
    """The bytes behind `shift` spaces, space-padded to whole halves, at least two, and a tail."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    halves = max(2, -(-(len(b) + shift) // HALF))
    out = np.full(halves * HALF + WIDTH - STRIDE, 32, np.uint8)
    out[shift : shift + len(b)] = b
    return out


class Network:
    def __init__(self, params: dict[str, np.ndarray] | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        if params is None:
            params = {
                "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
                "filter": rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
                "shift": np.zeros(FILTERS, np.float32),
                "dense": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
                "bias": np.zeros(1, np.float32),
                "mean": np.zeros(2 * FILTERS, np.float32),
                "scale": np.ones(2 * FILTERS, np.float32),
            }
        self.params = params

    def halves(self, b: np.ndarray) -> np.ndarray:
        """For each half chunk the maximum of each rectified filter."""
        p = self.params
        out = []
        split = STRIDE * EMBED
        for at in range(0, len(b) - (WIDTH - STRIDE), BLOCK):
            part = b[at : at + BLOCK + WIDTH - STRIDE]
            x = p["embed"][part].reshape(-1, split)  # STRIDE bytes a row; a window is two rows
            z = x[:-1] @ p["filter"][:split]
            z += x[1:] @ p["filter"][split:]
            out.append(z.reshape(-1, PER_HALF, FILTERS).max(1))
        return np.maximum(np.concatenate(out) + p["shift"], 0)

    def vector(self, b: np.ndarray) -> np.ndarray:
        h = self.halves(b)
        chunks = np.maximum(h[:-1], h[1:])
        return np.concatenate((chunks.mean(0), chunks.max(0)))

    def score(self, text: str) -> float:
        if not text.strip():
            return 0.0
        p = self.params
        v = (self.vector(_bytes(text)) - p["mean"]) / p["scale"]
        return float(sigmoid(float(v @ p["dense"] + p["bias"][0])))

    def _step(self, docs: list[np.ndarray], label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the log loss over a batch, whose documents go through the network end to
        end. Max-pooling sends each gradient back to one window."""
        p = self.params
        split = STRIDE * EMBED
        grads = {k: np.zeros_like(p[k]) for k in ("embed", "filter", "shift", "dense", "bias")}
        raw = np.concatenate(docs)
        rows = raw.reshape(-1, STRIDE)
        x = p["embed"][raw].reshape(-1, split)
        n_halves = np.array([len(b) // HALF for b in docs])
        last_half = np.cumsum(n_halves) - 1
        # A document has a row more than windows; the window that begins there belongs to nobody.
        row = np.arange(n_halves.sum() * PER_HALF) + np.repeat(np.arange(len(docs)), n_halves * PER_HALF)
        z = (x[:-1] @ p["filter"][:split] + x[1:] @ p["filter"][split:] + p["shift"])[row]
        z = z.reshape(-1, PER_HALF, FILTERS)
        at = z.argmax(1)
        h = np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0], 0)
        first = np.delete(np.arange(len(h)), last_half)  # the first half of each chunk
        later = h[first + 1] > h[first]
        chunks = np.where(later, h[first + 1], h[first])
        n_chunks = n_halves - 1
        starts = np.cumsum(n_chunks) - n_chunks
        mean = np.add.reduceat(chunks, starts) / n_chunks[:, None]
        v = (np.concatenate((mean, np.maximum.reduceat(chunks, starts)), 1) - p["mean"]) / p["scale"]
        miss = sigmoid(v @ p["dense"] + p["bias"][0]) - label
        grads["dense"] += miss @ v
        grads["bias"] += miss.sum()
        back = miss[:, None] * p["dense"] / p["scale"]
        to_chunk = np.repeat(back[:, :FILTERS] / n_chunks[:, None], n_chunks, 0)
        for d, (start, n) in enumerate(zip(starts, n_chunks, strict=True)):
            to_chunk[start + chunks[start : start + n].argmax(0), np.arange(FILTERS)] += back[d, FILTERS:]
        to_half = np.zeros_like(h)
        to_half[first + 1] += to_chunk * later
        to_half[first] += to_chunk * ~later
        to_half *= h > 0
        half, which = np.nonzero(to_half)
        if len(half):
            g = to_half[half, which]
            window = row[half * PER_HALF + at[half, which]]
            grads["shift"] += np.bincount(which, g, FILTERS).astype(np.float32)
            # Windows come to each filter from many places: sum them by filter.
            order = np.argsort(which, kind="stable")
            used, begins = np.unique(which[order], return_index=True)
            for f, rows_of in zip(used, np.split(order, begins[1:]), strict=True):
                grads["filter"][:split, f] += g[rows_of] @ x[window[rows_of]]
                grads["filter"][split:, f] += g[rows_of] @ x[window[rows_of] + 1]
            to_bytes = (p["filter"].T[which] * g[:, None]).reshape(len(g), WIDTH, EMBED)
            held = np.concatenate((rows[window], rows[window + 1]), 1).ravel()
            for k in range(EMBED):
                grads["embed"][:, k] += np.bincount(held, to_bytes[:, :, k].ravel(), 256).astype(np.float32)
        return {k: g / len(docs) for k, g in grads.items()}

    def fit(self, rows: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = 3e-3, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        label = np.array([y for _, y in rows], np.float32)
        raw = [self.vector(_bytes(text)) for text, _ in rows]
        self.params["mean"] = np.mean(raw, 0).astype(np.float32)
        self.params["scale"] = (np.std(raw, 0) + 0.05).astype(np.float32)
        share = float(np.clip(label.mean(), 0.01, 0.99))
        self.params["bias"][0] = np.log(share / (1 - share))
        adam = Adam({k: self.params[k] for k in ("embed", "filter", "shift", "dense", "bias")}, rate)
        epochs = max(epochs, -(-MIN_STEPS * BATCH // len(rows)))
        for epoch in range(epochs):
            adam.rate = rate * 0.05 ** (epoch / epochs)
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                batch = order[at : at + BATCH]
                # Another offset each time: filters must not depend on where a chunk begins.
                docs = [_bytes(rows[i][0], int(rng.integers(STRIDE))) for i in batch]
                adam.update(self._step(docs, label[batch]))
        return self


def train(rows: list[tuple[str, int]]) -> Network | None:
    """A fitted network; None unless both labels occur among the texts that aren't blank."""
    rows = [(text, y) for text, y in rows if text.strip()]
    return Network().fit(rows) if len({y for _, y in rows}) > 1 else None


def score_quality(docs: DataFrame, model: Network | None, text: str = "text") -> DataFrame:
    """docs without the text, with `score`."""
    small_batches(docs.sparkSession)
    passed = [c for c in docs.columns if c not in (text, "score")]
    schema = T.StructType([docs.schema[c] for c in passed] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [(0.5 if (x or "").strip() else 0.0) if model is None else model.score(x or "") for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in passed] + [pa.array(scores, pa.float64())], names=[*passed, "score"])

    return docs.select(*passed, docs[text].cast("string").alias(text)).mapInArrow(run, schema)
