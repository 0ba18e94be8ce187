"""Helpers that the training-data operators share: row hashing and Arrow batches; and those of shared storage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.shared import discard, made_so_far, shared_dir, sweep, written  # noqa: F401

#: Words are separated by these six ASCII white-space characters only.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys with the most rows that meet() broadcasts, and the rows from which a key is worth it.
HOT_KEYS, HOT_ROWS = 4096, 1000


def meet(rows: DataFrame, keyed: DataFrame, on: list[str], often: str, hot_keys: int | None = None, how: str = "inner") -> DataFrame:
    """Inner or left join of rows to a written table `keyed`, whose keys `on` are distinct and whose column
    `often` says how many rows have the key.

    The HOT_KEYS keys with the most rows are broadcast, a bounded number whatever the input, so the
    rows of a hot key stay where they are. Any other key has at most one in HOT_KEYS of the rows and
    goes by shuffle. Where no key has HOT_ROWS rows, all go by shuffle."""
    most = keyed.agg(F.max(often)).first()[0]
    if most is None or most < HOT_ROWS:
        return rows.join(keyed, on, how)
    top = keyed.filter(F.col(often) >= HOT_ROWS).orderBy(F.desc(often), *on)
    hot = written(top.limit(HOT_KEYS if hot_keys is None else hot_keys), "hot")
    keys = F.broadcast(hot.select(*on))
    by_shuffle = rows.join(keys, on, "left_anti").join(keyed.join(keys, on, "left_anti"), on, how)
    return rows.join(F.broadcast(hot), on).unionByName(by_shuffle)


def free_prefix(df: DataFrame) -> str:
    """Underscores that no column of df begins with, for the names of columns on the way."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def text_of(name: str = "text") -> Column:
    """A text column whose nulls count as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most `rows` rows, which bounds the Python objects alive."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Keep Arrow batches small enough for rows of very long texts; never raises a lower setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def within_budget(sized: list[tuple[int, int]], chars: int) -> int:
    """How many of (key, characters) can be taken in order before `chars` is exceeded."""
    size = 0
    for n, (_, length) in enumerate(sized):
        size += length
        if size > chars:
            return n
    return len(sized)


def hash_sample(docs: DataFrame, text: str, rows: int, chars: int) -> list[str]:
    """At most `rows` distinct texts of at most `chars` characters together, for training: those of
    least hash over the whole table, in that order, so the choice depends on the texts alone and
    not on how they are laid out. Copies count once, however many there are."""
    total = docs.count()
    if not total:
        return []
    share = min(1.0, 2 * rows / total)
    key = F.shiftrightunsigned(F.xxhash64("t"), 2)
    picked = docs.select(F.col(text).cast("string").alias("t")).filter("t is not null and t <> ''").withColumn("h", key)
    picked = picked.filter(F.col("h") <= int(share * (1 << 62)))
    sized = picked.groupBy("h").agg(F.max(F.length("t")).alias("n")).orderBy("h").limit(rows).collect()
    sized = sized[: within_budget(sized, chars)]
    if not sized:
        return []
    texts = picked.filter(F.col("h") <= sized[-1].h).groupBy("h").agg(F.max("t").alias("t")).collect()
    return [r.t for r in sorted(texts, key=lambda r: r.h)]
