"""Bounded labelled samples, the split rule and small training tools for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import within_budget


def remainder(row_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(row_id).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    usable: Column,
    rows: int,
    chars: int,
    text: str = "text",
    row_id: str = "doc_id",
) -> list[tuple[str, int]]:
    """At most `rows` labelled texts with `usable` true, and at most `chars` characters together.

    Labels are sampled by a hash of the id before any text is touched, so the join's small side has
    at most `rows` ids whatever the size of the tables. Texts are taken in the order of that hash,
    so the choice doesn't depend on how the tables are laid out. Null labels and ids are left out;
    of an id labelled twice the greater label counts, of one with several texts the greatest."""
    spark = docs.sparkSession
    known = labels.filter(usable & F.col(label).isNotNull() & F.col(row_id).isNotNull())
    known = known.select(F.col(row_id).cast("long").alias("i"), F.col(label).cast("int").alias("y"))
    total = known.count()
    if not total:
        return []
    key = F.shiftrightunsigned(F.xxhash64("i", F.lit("sample")), 2)
    known = known.withColumn("h", key).filter(F.col("h") <= int(min(1.0, 2 * rows / total) * (1 << 62)))
    chosen = known.groupBy("i").agg(F.max("y").alias("y"), F.min("h").alias("h")).orderBy("h", "i").limit(rows).collect()
    if not chosen:
        return []
    texts = docs.select(F.col(row_id).cast("long").alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    ids = lambda rs: F.broadcast(spark.createDataFrame([(r.i,) for r in rs], "i long"))
    sizes = dict(texts.join(ids(chosen), "i").groupBy("i").agg(F.max(F.length("t"))).collect())
    held = [r for r in chosen if r.i in sizes]
    held = held[: within_budget([(r.i, sizes[r.i]) for r in held], chars)]
    if not held:
        return []
    found = dict(texts.join(ids(held), "i").groupBy("i").agg(F.max("t")).collect())
    return [(found[r.i], r.y) for r in held]


class Adam:
    """Steps of adaptive moments for a dictionary of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grads.items():
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            a = self.first[k] / (1 - 0.9**self.step)
            b = self.second[k] / (1 - 0.99**self.step)
            self.params[k] -= (self.rate * a / (np.sqrt(b) + 1e-8)).astype(self.params[k].dtype)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def auc(score: np.ndarray, label: np.ndarray) -> float:
    """Probability that a random positive scores above a random negative; ties count half."""
    score, label = np.asarray(score, float), np.asarray(label)
    _, inverse, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    positive = int((label == 1).sum())
    negative = len(label) - positive
    if not positive or not negative:
        return float("nan")
    return float((rank[label == 1].sum() - positive * (positive + 1) / 2) / (positive * negative))
