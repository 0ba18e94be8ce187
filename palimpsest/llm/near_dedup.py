"""Near-duplicate classes: DartMinHash signatures, a banded join and exact verification.

Signatures. Each element of a document's weighted set of five-word shingles owns a region of unit
cells (weight unit x rank unit). Hashing a cell gives its number of darts (Poisson with mean one)
and the place of each: weight, rank and one of `k` coordinates. A document keeps the darts that
fall below an element's weight, and for each coordinate the dart of least rank; two documents agree
on a coordinate with probability equal to their weighted Jaccard similarity. The rank limit is set
so that about k * (ln k + 4) darts are thrown whatever the size of the set, and is doubled for the
few documents that leave a coordinate empty. With weighting="set", the contract's plain Jaccard
similarity, every weight is 1; with "count" it is the number of occurrences.

Join. Documents with the same weighted set form one node, named by their least id. Nodes that
agree on a band meet in a bucket. In a bucket, nodes are compared with a centre and not with each
other; the links found are contracted, and buckets that still hold several components go on with
other centres, until no bucket holds two nodes of different components that haven't met.
So the components are those of all candidate pairs, and a group of thousands of copies costs about
one comparison each. Pairs whose sizes alone exclude the threshold are not compared; every other
comparison is exact, over the sorted shingle hashes of the two texts, which are made once. A
bucket may hold a great share of all nodes: what is known of the largest buckets is broadcast, a
fixed number of them, so that no task gets all nodes of one; and the shingles of a centre go to at
most SPREAD tasks, however many nodes it is compared with.

Buckets that are still open after BAND_ROUNDS hold documents that share a long passage and little
else. Their nodes move to a second, exact set of buckets: the prefix filter. Each node's elements
are ordered from rare to common, and of n elements only the first n - ceil(threshold * n) + 1 are
kept as keys, with their places; two sets that reach the threshold share one of these, and a common
passage is never among them. A shared key at places i and j leaves at most
min(n - i, m - j) + 1 elements to share, so keys that come too late for the threshold make no pair:
copies with many edits have their own rare elements first and meet nobody. The rounds go on over
these buckets, with more centres each time, as long as a bucket is open.

With 25 bands of 6 rows, a pair of similarity 0.8 meets with probability 0.9995.

Defined results: words are cut at white space and lower-cased; a text of one to four words is one
shingle; all texts without words, null ones included, form one class; rows that share an id count
as one document, whose least text speaks for it; rows without an id get no class (null) and are
kept; ties between ids cannot occur, as the least id names a class; other columns are not read."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, made_so_far, meet, slices, small_batches, sweep, written
from palimpsest.llm.graph import components

SHINGLE = 5
BANDS, ROWS = 25, 6
#: Rounds over the bands' buckets, one centre each, before the prefix filter takes over; its rounds
#: begin with so many centres, and multiply them.
BAND_ROUNDS, PREFIX_CENTRES, MORE_CENTRES = 2, 64, 4
#: Tasks at most that a centre's shingles go to.
SPREAD = 64
#: Centres at most of the buckets that are broadcast.
HOT_CENTRES = 4096
THRESHOLD = 0.8

U = np.uint64
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Cumulative Poisson probabilities with mean one; a 64-bit draw never exceeds the last.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(22)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers: xor-shifts between odd multiplications."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


_BYTES = mix(np.arange(1, 257, dtype=U) * U(_GOLD))
_STEP = 0xD1342543DE82EF95
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _STEP and of its inverse modulo 2**64, n of each at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_STEP, -1, 1 << 64)
        for i, base in enumerate((_STEP, inverse)):
            table = np.full(size, base, U)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, by position."""
    words = " ".join((text or "").lower().split())
    if not words:
        return np.zeros(0, U)
    b = np.frombuffer(words.encode("utf-8", "surrogatepass"), np.uint8)
    up, down = _power_tables(len(b) + 1)
    total = np.zeros(len(b) + 1, U)
    np.cumsum(_BYTES[b] * up[: len(b)], out=total[1:])
    spaces = np.flatnonzero(b == 32)
    first, last = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(b)]))
    return mix((total[last] - total[first]) * down[first])


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, sorted, and their numbers of occurrences."""
    words = word_hashes(text)
    if not len(words):
        return words, np.zeros(0)
    size = min(size, len(words))
    h = np.full(len(words) - size + 1, size, U)
    for i in range(size):
        h = mix(h * U(_GOLD) + words[i : len(words) - size + 1 + i])
    found, count = np.unique(h, return_counts=True)
    return found, count.astype(float)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(float) * 2.0**-53


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """For each of k coordinates the name of the dart of least rank over the weighted elements."""
    total = float(weights.sum())
    limit = k * (math.log(k) + 4) / total
    while True:
        ranks = math.ceil(limit)
        columns = np.ceil(weights).astype(np.int64)
        element = np.repeat(np.arange(len(elements)), columns * ranks)
        within = np.arange(len(element)) - np.repeat(np.cumsum(columns * ranks) - columns * ranks, columns * ranks)
        a, r = within // ranks, within % ranks
        cell = mix(elements[element] ^ mix(a.astype(U) * U(0xA24BAED4963EE407) + r.astype(U) * U(0x9FB21C651E98DF25) + U(1)))
        darts = np.searchsorted(_POISSON, _unit(cell), side="right")
        of = np.repeat(np.arange(len(cell)), darts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(darts) - darts, darts)
        name = mix(cell[of] + (nth + 1).astype(U) * U(_GOLD))
        place = mix(name + U(1))
        rank = r[of] + _unit(place)
        held = (rank < limit) & (a[of] + _unit(mix(name + U(2))) < weights[element[of]])
        name, rank = name[held], rank[held]
        at = (mix(name + U(3)) >> U(33)).astype(np.int64) % k
        order = np.argsort(-rank, kind="stable")
        out, full = np.zeros(k, U), np.zeros(k, bool)
        out[at[order]] = name[order]  # the last write of a coordinate is its dart of least rank
        full[at] = True
        if full.all():
            return out
        limit *= 2


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A bucket's key for each band; the band's number is part of it."""
    h = np.arange(1, bands + 1, dtype=U) * U(_GOLD)
    for column in signature.reshape(bands, rows).T:
        h = mix(h * U(0xA24BAED4963EE407) + column)
    return h


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U).view(np.int64)


def signatures(
    docs: DataFrame, text: str = "text", row_id: str = "doc_id", bands: int = BANDS, rows: int = ROWS, weighting: str = "set"
) -> DataFrame:
    """A row for each document: id, f1, f2 (fingerprint of its weighted set), n (distinct shingles)
    and the keys of its bands (none without words)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            f1, f2, n, keys = [], [], [], []
            for value in batch.column(1).to_pylist():
                found, weight = shingles(value)
                weight = weight if weighting == "count" else np.ones(len(found))
                salted = mix(found ^ mix(weight.astype(U)))
                f1.append(int(salted.sum(dtype=U)))
                f2.append(int(mix(salted + U(_GOLD)).sum(dtype=U)))
                n.append(len(found))
                keys.append(_signed(band_keys(dart_signature(found, weight, bands * rows), bands, rows)) if len(found) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(_signed(np.array(f1, U))),
                    pa.array(_signed(np.array(f2, U))),
                    pa.array(n, pa.int32()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["id", "f1", "f2", "n", "bands"],
            )

    rows_in = docs.select(docs[row_id].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    return rows_in.mapInArrow(run, "id long, f1 long, f2 long, n int, bands array<long>")


def shingle_sets(texts: DataFrame, weighting: str = "set") -> DataFrame:
    """(node, size, elements) of (id, text): the sorted shingle hashes. With weights the second and
    later occurrences of a shingle are elements of their own, so that the plain Jaccard similarity
    of two sets of elements is the weighted one of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            sets = []
            for value in batch.column(1).to_pylist():
                found, count = shingles(value)
                if weighting == "count":
                    times = count.astype(np.int64)
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    found = np.sort(mix(np.repeat(found, times) + nth.astype(U) * U(_GOLD)))
                sets.append(_signed(found))
            sizes = pa.array([len(x) for x in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(sets, pa.list_(pa.int64()))], names=["node", "size", "elements"])

    return texts.select("id", "text").mapInArrow(run, "node long, size int, elements array<long>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of a written table of pairs (u, v) of nodes, those whose sets have an exact similarity of
    `threshold` or more, with it. The set of v goes to at most SPREAD tasks, not to every pair."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SPREAD)))
    of = lambda x: sets.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("elements").alias(f"set_{x}"))
    centres = dealt.select("v", "salt").distinct().join(of("v"), "v")
    both = dealt.join(of("u"), "u").join(centres, ["v", "salt"])
    both = both.withColumn("shared", F.size(F.array_intersect("set_u", "set_v")))
    similarity = F.col("shared") / (F.col("size_u") + F.col("size_v") - F.col("shared"))
    return both.select("u", "v", similarity.alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)


def prefix_members(sets: DataFrame, threshold: float) -> DataFrame:
    """The prefix filter's buckets: (bucket, node, nth) for each node's rarest elements."""
    elements = sets.select("node", "size", F.explode("elements").alias("bucket"))
    shared = written(elements.groupBy("bucket").agg(F.count("*").alias("often")), "shared")
    order = Window.partitionBy("node").orderBy("often", "bucket")
    ranked = meet(elements, shared, ["bucket"], "often").withColumn("nth", F.row_number().over(order))
    size = F.col("size")
    held = (F.col("nth") <= size - F.ceil(size * threshold - 1e-9) + 1) & (F.col("often") > 1)
    kept = written(ranked.filter(held).select("bucket", "node", "nth", "size"), "prefixes")
    # Not even the smallest partner of the bucket could share enough with a key at this place.
    least = written(kept.groupBy("bucket").agg(F.min("size").alias("least"), F.count("*").alias("often")), "least")
    partner = F.greatest(F.col("least"), F.ceil(size * threshold - 1e-9))
    able = size - F.col("nth") + 1 >= (size + partner) * (threshold / (1 + threshold)) - 1e-9
    out = written(meet(kept, least, ["bucket"], "often").filter(able).select("bucket", "node", "nth"), "prefixes")
    for done in (shared, kept, least):
        discard(done)
    return out


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    weighting: str = "set",
) -> DataFrame:
    """A row for each row of docs: the id, class_id, the least id of its near-duplicate class, and
    class_size, the rows of that class."""
    before = made_so_far()
    signed = written(signatures(docs, text, row_id, bands, rows, weighting), "signatures")
    key = ["f1", "f2", "n"]
    alike = signed.filter("id is not null").groupBy(*key)
    nodes = written(alike.agg(F.min("id").alias("node"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "nodes")
    texts = docs.select(docs[row_id].cast("long").alias("id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    members = nodes.filter("n > 0").select(F.explode("bands").alias("bucket"), "node", F.lit(None).cast("int").alias("nth"))
    labels: DataFrame | None = None
    now: DataFrame | None = None
    sets: DataFrame | None = None
    centres, rounds = 1, 0
    joint = threshold / (1 + threshold)

    def able(c: Column) -> Column:
        """Could a node and a centre of another component reach the threshold, by their sizes and by
        the places of the key that they share?"""
        size, other = F.col("size"), c["size"]
        sizes = F.least(size, other) >= F.greatest(size, other) * threshold - 1e-9
        places = F.least(size - F.col("nth"), other - c["nth"]) + 1 >= (size + other) * joint - 1e-9
        return (F.col("component") != c["component"]) & sizes & F.coalesce(places, F.lit(True))

    parts = ("node", "component", "size", "nth")
    while True:
        if labels is None:
            seen = members.withColumn("component", F.col("node"))
        else:
            seen = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = seen.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("often"))
        several = written(several.filter("a <> b").select("bucket", "often"), "several")
        last, now = now, written(meet(seen, several, ["bucket"], "often").select("bucket", "node", "nth", "component", "often"), "open")
        discard(last)
        discard(several)
        if now.isEmpty():
            break
        if rounds in (0, BAND_ROUNDS):
            still = now.select(F.col("node").alias("id")).distinct()
            if sets is None:
                found = shingle_sets(texts.join(still.hint("merge"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), weighting)
            else:
                found = sets.join(still.withColumnRenamed("id", "node"), "node", "left_semi")
            last, sets = sets, written(found, "sets")
            discard(last)
        if rounds == BAND_ROUNDS:
            members = prefix_members(sets, threshold)
            centres, rounds = PREFIX_CENTRES, rounds + 1
            continue
        sized = now.join(sets.select("node", "size"), "node")
        share = F.pmod(F.xxhash64("node"), F.lit(centres)).alias("share")
        chosen = sized.groupBy("bucket", share).agg(F.min_by(F.struct(*parts), "node").alias("c"), F.max("often").alias("often"))
        packed = written(chosen.groupBy("bucket").agg(F.collect_list("c").alias("centres"), F.max("often").alias("often")), "centres")
        met = meet(sized.drop("often"), packed, ["bucket"], "often", max(1, HOT_CENTRES // centres))
        near = met.select("node", F.explode(F.filter("centres", able)).alias("c"))
        pairs = near.select(F.greatest("node", "c.node").alias("u"), F.least("node", "c.node").alias("v")).distinct()
        pairs = written(pairs, "pairs")
        known = verified(pairs, sets, threshold).select("u", "v")
        if labels is not None:
            known = known.unionByName(labels.select(F.col("node").alias("u"), F.col("component").alias("v")))
        last, labels = labels, components(known)
        discard(last)
        gone = packed.select("bucket", F.explode("centres.node").alias("node"))
        last, members = members, written(now.select("bucket", "node", "nth").join(gone, ["bucket", "node"], "left_anti"), "members")
        discard(last)
        discard(pairs)
        discard(packed)
        centres, rounds = centres * (MORE_CENTRES if rounds > BAND_ROUNDS else 1), rounds + 1
    classes = nodes.select(*key, "node", "copies")
    if labels is not None:
        classes = classes.join(labels, "node", "left").select(*key, F.coalesce("component", "node").alias("class_id"), "copies")
    else:
        classes = classes.withColumnRenamed("node", "class_id")
    classes = written(classes, "classes")
    counted = written(classes.groupBy("class_id").agg(F.sum("copies").alias("class_size"), F.count("*").alias("often")), "counted")
    whole = written(meet(classes, counted, ["class_id"], "often").select(*key, "copies", "class_id", "class_size"), "classes")
    out = written(meet(signed.filter("id is not null").select("id", *key), whole, key, "copies").select("id", "class_id", "class_size"), "near-duplicates")
    nameless = signed.filter("id is null").select("id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("class_size"))
    out_path, signed_path = out.table_path, signed.table_path
    sweep(docs.sparkSession, [*before, out_path, signed_path])
    return out.unionByName(nameless).withColumnRenamed("id", row_id)


def one_of_each(docs: DataFrame, text: str = "text", row_id: str = "doc_id", **options) -> DataFrame:
    """One document of each near-duplicate class, that with the least id; of rows that share an id
    the one with the least text, and of those the least by a hash of the whole row. Rows without an
    id stay."""
    least = near_duplicates(docs, text, row_id, **options).filter(F.col(row_id) == F.col("class_id")).select(row_id).distinct()
    order = F.struct(F.coalesce(F.col(text), F.lit("")), F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != text]))))
    kept = docs.join(least, row_id, "left_semi").groupBy(F.col(row_id).alias("_kept_id")).agg(F.min_by(F.struct(*docs.columns), order).alias("_kept"))
    return kept.select("_kept.*").unionByName(docs.filter(F.col(row_id).isNull()))
