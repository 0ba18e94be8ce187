"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence's probability is logistic in the distinct words that it holds and in the beginnings of
those words (PREFIXES characters, which inflected forms share); the document's is their noisy-or,
1 - prod(1 - p). Only document labels are known, so the weights are trained through the noisy-or,
whose gradient goes to the sentences that explain a label. Afterwards the sentences with a
probability of OFFENDS or more are located.

Vocabulary: words and beginnings whose share of toxic documents exceeds the sample's by more than
MIN_DEVIATION standard errors, over at least MIN_DOCUMENTS documents of the sample. Training takes
at most SAMPLE_DOCS labelled documents of at most SAMPLE_CHARS characters; scoring reads whole
texts.

Defined results: null, empty and wordless texts have no sentence and score 0; repeated rows are
scored one by one; without any usable label every score is 0; other columns pass through unless
their names are those of the results."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm.common import slices, small_batches
from palimpsest.llm.labelled import Adam, sigmoid

SAMPLE_DOCS, SAMPLE_CHARS = 8000, 20_000_000
MIN_DOCUMENTS, MIN_DEVIATION = 3, 3.0
PREFIXES = (4, 5, 6)
#: Share of the features left out of a training step.
DROPPED = 0.3
#: Words whose weights a task remembers; the table is emptied beyond that.
TABLE_ROWS = 200_000
OFFENDS = 0.5
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of each sentence with a word."""
    out = []
    for m in _SENTENCE.finditer(text):
        words = _WORD.findall(m[0].lower())
        if words:
            out.append((m.start(), m.end(), words))
    return out


def parts(word: str) -> list[str]:
    """A word's features: itself and, marked by a hyphen, its beginnings."""
    return [word] + [f"{word[:n]}-" for n in PREFIXES if len(word) > n]


@dataclass
class Model:
    bias: float
    weight: dict[str, float]
    table: dict[str, float] = field(default_factory=dict)

    def of(self, words: set[str]) -> float:
        """The sum of the words' weights; what a word adds is worked out once."""
        table, total = self.table, 0.0
        for w in words:
            x = table.get(w)
            if x is None:
                if len(table) >= TABLE_ROWS:
                    table.clear()
                x = table[w] = sum(self.weight.get(f, 0.0) for f in parts(w))
            if x:
                total += x
        return total

    def scored(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and the offending sentences with theirs."""
        clean, offending = 0.0, []
        plain = float(np.log1p(-sigmoid(self.bias)))
        for start, end, words in sentences(text):
            z = round(self.of(set(words)), 9)  # the order of a set must not show
            if not z:
                clean += plain
                continue
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + z))))
            clean += math.log1p(-min(p, 1 - 1e-12))
            if p >= OFFENDS:
                offending.append((start, end, p))
        return float(-np.expm1(clean)) + 0.0, offending  # no sentence: 0 and not -0


def train(rows: list[tuple[str, int]], steps: int = 800, rate: float = 0.1, decay: float = 5e-6) -> Model:
    label = np.array([y for _, y in rows], float)
    if not len(label) or not label.any():
        return Model(-30.0, {})
    # The texts are read twice, so that only counts and the chosen features are held.
    seen, toxic = Counter(), Counter()
    for text, y in rows:
        found = {f for _, _, words in sentences(text) for w in set(words) for f in parts(w)}
        seen.update(found)
        if y:
            toxic.update(found)
    share = label.mean()
    vocabulary = sorted(
        f
        for f, n in toxic.items()
        if seen[f] >= MIN_DOCUMENTS and n - share * seen[f] > MIN_DEVIATION * np.sqrt(seen[f] * share * (1 - share) + 1e-9)
    )
    del seen, toxic
    index = {w: i for i, w in enumerate(vocabulary)}
    doc_of, where, what, times = [], [], [], []
    at = 0
    for d, (text, _) in enumerate(rows):
        for _, _, words in sentences(text):
            held = Counter(index[f] for w in set(words) for f in parts(w) if f in index)
            where += [at] * len(held)
            what += held.keys()
            times += held.values()
            doc_of.append(d)
            at += 1
    doc_of, where, what = np.array(doc_of, int), np.array(where, int), np.array(what, int)
    times = np.array(times, float)
    params = {"w": np.zeros(len(vocabulary)), "b": np.array([-6.0])}
    adam = Adam(params, rate)
    n = len(rows)
    # Words of a kind often stand together and would share one weight; each step leaves out some of
    # the features, so that every one learns to do alone.
    rng = np.random.default_rng(5)
    whole = times
    for _ in range(steps):
        times = whole * (rng.random(len(vocabulary)) >= DROPPED)[what] if len(vocabulary) else whole
        z = params["b"][0] + np.bincount(where, params["w"][what] * times, at)
        p = sigmoid(z)
        clean = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), n)
        doc = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: p for a clean document, -p (1 - P) / P for a toxic one
        g = (p * np.where(label == 1, -(1 - doc) / doc, 1.0)[doc_of]) / n
        grads = {"w": np.bincount(what, g[where] * times, len(vocabulary)) + decay * params["w"], "b": np.array([g.sum()])}
        adam.update(grads)
    return Model(float(params["b"][0]), {w: float(params["w"][i]) for w, i in index.items()})


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text, with score and `offending`, an array of (start, end, probability)."""
    small_batches(docs.sparkSession)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("probability", T.DoubleType())])
    passed = [c for c in docs.columns if c not in (text, "score", "offending")]
    schema = T.StructType([docs.schema[c] for c in passed] + [T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [model.scored(x or "") for x in batch.column(text).to_pylist()]
            spans = [[{"start": a, "end": b, "probability": p} for a, b, p in s] for _, s in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in passed] + [pa.array([s for s, _ in rows], pa.float64()), pa.array(spans, arrow)],
                names=[*passed, "score", "offending"],
            )

    return docs.select(*passed, docs[text].cast("string").alias(text)).mapInArrow(run, schema)
