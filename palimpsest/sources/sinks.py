"""Results as files: one text per document, and the log of a revision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.revise import Revision, to_md


def write_texts(texts: DataFrame, path: str, name: str, suffix: str = ".md") -> None:
    """Write (name, text) to `path` in a folder a document, called name=<value><suffix>: Markdown with
    the suffix .md, HTML with .html. Tasks write their own documents; nothing comes to the driver. A
    null text gives an empty file. An existing path is an error, so no input is ever overwritten."""
    labelled = texts.select(F.concat(F.col(name).cast("string"), F.lit(suffix)).alias(name), F.coalesce("text", F.lit("")).alias("value"))
    labelled.write.partitionBy(name).text(path)


def output_texts(base: DataFrame, revision: Revision, pair_id: str) -> DataFrame:
    """(pair_id, text, copied): the base's own text, character by character, where nothing was
    edited, else the revised blocks as Markdown. Null base texts stay null if nothing was edited."""
    edited = revision.actions.select("pair_id").unionByName(revision.renames.select("pair_id")).distinct()
    made = to_md(revision.blocks).withColumnRenamed("text", "_made").join(edited, "pair_id", "left_semi")
    out = base.select(F.col(pair_id).alias("pair_id"), "text").join(made, "pair_id", "left")
    return out.select("pair_id", F.coalesce("_made", "text").alias("text"), F.col("_made").isNull().alias("copied"))


def log(revision: Revision) -> DataFrame:
    """(pair_id, step, level, message, n): what a revision did, in numbered steps; `level` is detail
    or warn. Counted where the rows are, for each pair."""
    step = lambda df, n, level, message: df.select("pair_id", F.lit(n).alias("step"), F.lit(level).alias("level"), message.alias("message"))
    rows = step(revision.diff, 1, "detail", F.concat(F.lit("section "), "action"))
    rows = rows.unionByName(step(revision.actions, 2, "detail", F.concat_ws(" ", "step", "action")))
    rows = rows.unionByName(step(revision.skipped, 3, "warn", F.lit("new section not inserted")))
    rows = rows.unionByName(step(revision.warnings, 4, "warn", F.col("warning")))
    return rows.groupBy("pair_id", "step", "level", "message").agg(F.count("*").alias("n"))
