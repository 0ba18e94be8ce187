"""Line dedup: lines that spread over many sites are boilerplate and are removed.

1. Spread: lines are keyed by two 64-bit hashes; a HyperLogLog sketch of the sites is aggregated
   for each key. Sketches merge, so each task ships one small sketch for a line however often it
   occurs there.
2. Lines estimated within three standard errors of `min_sites` get an exact distinct count; those
   above are wide, those below are not.
3. The occurrences of wide lines are gathered for each document as line numbers, and only those
   numbers are joined to the texts. The set of wide lines grows with the corpus, so it isn't
   broadcast; only the commonest lines are, a fixed number, so no task gets all rows of one line.

All steps are DataFrame functions. Key columns are hashed from the row's id and text.

Wide lines are cut wherever a line of the document's own remains. A document that holds nothing
else is a copy of a document and not a page under boilerplate: it stays whole, for near-duplicate
removal, and has n_removed = 0. `max_share` is an option that is off: with it, documents stay whole
of whose characters wide lines make up more than that share.

Defined results: lines are compared without the white space at their ends; lines without a word
are never counted and never removed; a null text has no lines and stays null; a null site is a
site of its own; repeated rows get the same result each; other columns pass through, whatever
their names, unless those are of the results (n_lines, n_wide_lines, n_removed), which then
replace them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import free_prefix, meet, written

MIN_SITES = 5
LG_K = 8
KEY = ["_h1", "_h2"]
ROW = ["_k1", "_k2"]


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\n\x0b\x0c\r"))


def near_band(min_sites: int, lg_k: int = LG_K) -> tuple[int, int]:
    """Estimates from the first to the second value, both included, need an exact count."""
    error = 3 * 1.04 / math.sqrt(1 << lg_k)
    return math.floor(min_sites * (1 - error)), math.ceil(min_sites * (1 + error))


def line_table(docs: DataFrame, text: str, site: str, row_id: str) -> DataFrame:
    """A row for each line with a word: row key, line number from 0, line key, site."""
    lines = docs.select(
        F.xxhash64(row_id, text).alias("_k1"),
        F.xxhash64(F.lit("row"), row_id, text).alias("_k2"),
        F.coalesce(F.col(site).cast("string"), F.lit("")).alias("_site"),
        F.posexplode(F.split(text, "\n")).alias("_pos", "_line"),
    )
    line = _trimmed(F.col("_line"))
    return lines.select(
        *ROW, "_pos", F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit("line"), line).alias("_h2"), "_site"
    ).filter(line != "")


def wide_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Keys of the lines on at least `min_sites` distinct sites, and `_often`, their occurrences."""
    low, high = near_band(min_sites, lg_k)
    spread = lines.groupBy(*KEY).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(lg_k))).alias("_sites"), F.count("*").alias("_often")
    )
    likely = written(spread.filter(F.col("_sites") >= low), "line-spread")
    near = likely.filter(F.col("_sites") <= high).select(*KEY, "_often")
    exact = meet(lines.select(*KEY, "_site"), near, KEY, "_often").groupBy(*KEY, "_often", "_site").agg(F.lit(1).alias("_one"))
    counted = exact.groupBy(*KEY, "_often").count().filter(F.col("count") >= min_sites)
    return likely.filter(F.col("_sites") > high).select(*KEY, "_often").unionByName(counted.select(*KEY, "_often"))


def remove_wide_lines(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    max_share: float | None = None,
    text: str = "text",
    site: str = "source",
    row_id: str = "doc_id",
) -> DataFrame:
    """docs with the wide lines cut from the text, and n_lines, n_wide_lines and n_removed."""
    lines = line_table(docs, text, site, row_id)
    wide = written(wide_lines(lines, min_sites), "wide-lines")
    p = free_prefix(docs)
    k1, k2, at, split, size = (f"{p}{x}" for x in ("k1", "k2", "wide", "split", "cut"))
    hits = meet(lines.select(*ROW, "_pos", *KEY), wide, KEY, "_often").groupBy(*ROW).agg(F.collect_set("_pos").alias(at))
    hits = hits.withColumnsRenamed({"_k1": k1, "_k2": k2})
    made = ("n_lines", "n_wide_lines", "n_removed")
    keyed = docs.drop(*made).withColumns({k1: F.xxhash64(row_id, text), k2: F.xxhash64(F.lit("row"), row_id, text)})
    df = keyed.join(hits, [k1, k2], "left").drop(k1, k2).withColumn(at, F.coalesce(at, F.array().cast("array<int>")))
    df = df.withColumn(split, F.split(text, "\n"))
    df = df.withColumn(size, F.aggregate(F.transform(at, lambda i: F.length(F.get(split, i))), F.lit(0), lambda a, n: a + n))
    n_lines = F.size(F.filter(split, lambda x: _trimmed(x) != ""))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), at)
    cut = (F.size(at) > 0) & (F.size(at) < n_lines)
    if max_share is not None:
        cut = cut & (F.col(size) <= F.length(text) * F.lit(max_share))
    return df.withColumns(
        {
            text: F.when(cut, F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n")).otherwise(F.col(text)),
            "n_lines": F.when(F.col(text).isNotNull(), n_lines.cast("long")).otherwise(F.lit(0).cast("long")),
            "n_wide_lines": F.size(at).cast("long"),
            "n_removed": F.when(cut, F.size(at)).otherwise(0).cast("long"),
        }
    ).drop(at, split, size)
