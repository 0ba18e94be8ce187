"""Sections over blocks of Word documents, and small block-level rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T


def chunk_blocks(blocks: DataFrame, doc: str) -> DataFrame:
    """blocks with sec_idx, sec_heading and sec_level: a heading or separator begins a section, what
    comes before the first is section "(preamble)" of level 0, and so are separators, which are
    named by their text in parentheses. One window over the document."""
    w = Window.partitionBy(doc).orderBy("pos")
    starts = F.col("kind").isin("heading", "separator")
    name = F.when(F.col("kind") == "heading", F.col("text")).when(F.col("kind") == "separator", F.concat(F.lit("("), F.lower(T.strip(F.col("text"))), F.lit(")")))
    level = F.when(F.col("kind") == "heading", F.col("level")).when(F.col("kind") == "separator", F.lit(0))
    df = blocks.withColumn("_part", F.sum(starts.cast("int")).over(w))
    first = F.first(starts.cast("int")).over(w)  # a document that begins with a heading has no preamble
    df = df.withColumns(
        {
            "sec_idx": F.col("_part") - first,
            "sec_heading": F.coalesce(F.last(name, ignorenulls=True).over(w), F.lit("(preamble)")),
            "sec_level": F.coalesce(F.last(level, ignorenulls=True).over(w), F.lit(0)),
        }
    )
    return df.drop("_part")


def section_text(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The text of sections for comparison: runs joined by spaces, then blocks by spaces."""
    runs = F.array_join(F.transform("runs", lambda r: r["text"]), " ")
    ordered = F.array_sort(F.collect_list(F.struct("pos", runs.alias("t"))))
    return blocks.groupBy(*keys).agg(T.strip(F.array_join(F.transform(ordered, lambda x: x["t"]), " ")).alias("text"))


def without_empty_headings(blocks: DataFrame) -> DataFrame:
    return blocks.filter(~((F.col("kind") == "heading") & (T.strip(F.col("text")) == "")))


def rescued_drawings(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with drawings of edited sections (keys, pos) that come back at the section's end, as
    no new block of the section has a drawing."""
    kept = new.filter("has_drawing").select(*keys).distinct()
    return old.filter("has_drawing").join(kept, keys, "left_anti")


def markdown_runs(text: Column) -> Column:
    """Runs (text, bold) of Markdown text, for cells and bullets: one plain run if nothing is bold."""
    segments = T.bold_segments(text)
    clean = F.transform(segments, lambda s: F.struct(F.regexp_replace(s["text"], r"_{2}|`{1,3}|~~", "").alias("text"), s["bold"].alias("bold")))
    return F.filter(clean, lambda s: s["text"] != "")


def set_cells(old: Column, new: Column) -> Column:
    """Cells after an update: new values over the columns that both have, runs kept only where bold
    changes within the cell."""
    value = lambda c: F.when(F.size(markdown_runs(c)) > 1, markdown_runs(c)).otherwise(
        F.array(F.struct(F.regexp_replace(c, r"\*\*", "").alias("text"), F.lit(False).alias("bold")))
    )
    plain = lambda c: F.array(F.struct(c.alias("text"), F.lit(False).alias("bold")))
    return F.zip_with(old, F.slice(new, F.lit(1), F.size(old)), lambda a, b: F.when(b.isNull(), plain(a)).otherwise(value(b)))
