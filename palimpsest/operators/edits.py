"""Applying section edits as a rewrite of position keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def section_ranges(blocks: DataFrame, doc: str) -> DataFrame:
    """(doc, heading, start, end) of each heading block up to the next one; of equal headings the
    first counts. Text before the first heading is "(preamble)"."""
    w = Window.partitionBy(doc).orderBy("pos")
    last = blocks.groupBy(doc).agg((F.max("pos") + 1).alias("_end"), F.min("pos").alias("_begin"))
    heads = blocks.filter(F.col("kind") == "heading").select(doc, F.col("text").alias("heading"), F.col("pos").alias("start"))
    w = Window.partitionBy(doc).orderBy("start")
    ranges = heads.withColumn("_next", F.lead("start").over(w)).join(last, doc).withColumn("end", F.coalesce("_next", "_end"))
    first = ranges.groupBy(doc).agg(F.min("start").alias("_first"))
    pre = last.join(first, doc, "left").withColumn("_first", F.coalesce("_first", "_end")).filter(F.col("_first") > F.col("_begin"))
    named = ranges.withColumn("nth", F.row_number().over(Window.partitionBy(doc, "heading").orderBy("start"))).filter("nth = 1")
    return named.select(doc, "heading", "start", "end").unionByName(
        pre.select(doc, F.lit("(preamble)").alias("heading"), F.col("_begin").alias("start"), F.col("_first").alias("end"))
    )


def apply_edits(blocks: DataFrame, edits: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """(blocks after the edits, edits skipped for want of their heading).

    edits: (doc, ord, kind, target, texts). A block's new place is the key (anchor, edit, block):
    kept blocks have (pos, -1, 0), those of a replacement (start, ord, i), those of an insert
    (end - 1, ord, i), so inserts at one anchor keep their order and "(end)" comes last."""
    ranges = section_ranges(blocks, doc)
    end = blocks.groupBy(doc).agg((F.max("pos") + 1).alias("end")).select(doc, F.lit("(end)").alias("heading"), F.col("end").alias("start"), "end")
    placed = edits.join(ranges.unionByName(end).withColumnRenamed("heading", "target"), [doc, "target"], "left")
    skipped = placed.filter(F.col("start").isNull()).drop("start", "end")
    found = placed.filter(F.col("start").isNotNull())
    gone = found.filter(F.col("kind").isin("replace", "delete")).select(doc, F.col("start").alias("_s"), F.col("end").alias("_e"))
    # Ranges of a document don't overlap, so the one that can hold a block is the last that begins before it.
    marks = gone.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("_s", "_e"))).alias("_gone"))
    kept = blocks.join(marks, doc, "left").filter(
        ~F.coalesce(F.exists("_gone", lambda g: (g["_s"] <= F.col("pos")) & (F.col("pos") < g["_e"])), F.lit(False))
    )
    old = kept.select(doc, F.col("pos").alias("anchor"), F.lit(-1).alias("edit"), F.lit(0).alias("nth"), "kind", "text")
    new = found.filter(F.col("kind").isin("replace", "insert")).select(
        doc,
        F.when(F.col("kind") == "replace", F.col("start")).otherwise(F.col("end") - 1).alias("anchor"),
        F.col("ord").alias("edit"),
        F.posexplode("texts").alias("nth", "text"),
    )
    new = new.select(doc, "anchor", "edit", "nth", F.lit("para").alias("kind"), "text")
    w = Window.partitionBy(doc).orderBy("anchor", "edit", "nth")
    out = old.unionByName(new).withColumn("pos", F.row_number().over(w) - 1)
    return out.select(doc, "pos", "kind", "text", F.when(F.col("edit") >= 0, F.col("edit")).alias("edit")), skipped


def rename_headings(blocks: DataFrame, renames: DataFrame, doc: str) -> DataFrame:
    """Heading blocks take their new text from (doc, heading, new_heading)."""
    named = renames.select(doc, F.col("heading").alias("text"), F.col("new_heading").alias("_new"), F.lit("heading").alias("kind"))
    return blocks.join(named, [doc, "text", "kind"], "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")


def rescued_tables(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What happens to a section's tables (keys, nth, n_rows): new ones are dropped if there were
    none, the old ones come back if none is left or every paired one lost over half of its rows."""
    a, b = old.withColumnRenamed("n_rows", "_old"), new.withColumnRenamed("n_rows", "_new")
    both = a.join(b, [*keys, "nth"], "full")
    g = both.groupBy(*keys).agg(
        F.count("_old").alias("n_old"),
        F.count("_new").alias("n_new"),
        F.bool_and(F.when(F.col("_old").isNotNull() & F.col("_new").isNotNull(), F.col("_new") < F.col("_old") * 0.5)).alias("_shrunk"),
    )
    verdict = (
        F.when((F.col("n_old") == 0), "drop_new").when((F.col("n_new") == 0) | F.coalesce("_shrunk", F.lit(False)), "restore_old").otherwise("keep_new")
    )
    return g.withColumn("verdict", verdict).drop("_shrunk")


def next_versions(paths: DataFrame, path: str) -> DataFrame:
    """path with `next_path`: its own version plus one, stem_v001 for a path without one, and from
    there the first that isn't itself among the paths. The versions taken are gathered for each stem;
    behind a version the first gap is the end of the unbroken run that begins with it."""
    pattern = r"^(.+?)(?:_v(\d{3,}))?(\.[^./]*)?$"
    stem, number, suffix = (F.regexp_extract(path, pattern, i) for i in (1, 2, 3))
    df = paths.withColumns({"_stem": stem, "_number": F.coalesce(F.when(number != "", number.cast("int")), F.lit(0)), "_suffix": suffix})
    keys = ["_stem", "_suffix"]
    taken = df.select(*keys, "_number").distinct()
    w = Window.partitionBy(*keys).orderBy("_number")
    # Neighbours of a run share the difference of version and rank.
    runs = taken.withColumn("_run", F.col("_number") - F.row_number().over(w))
    runs = runs.withColumn("_end", F.max("_number").over(Window.partitionBy(*keys, "_run"))).select(*keys, "_number", "_end")
    named = F.concat("_stem", F.lit("_v"), F.format_string("%03d", F.col("_end") + 1), "_suffix")
    out = df.join(runs, [*keys, "_number"]).withColumn("next_path", named)
    return out.select(*paths.columns, "next_path")
