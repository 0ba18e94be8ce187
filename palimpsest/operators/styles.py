"""Heading and list styles: inheritance, frequency and lookups over a styles table."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The styles that are headings and lists by their names.
HEADING_ID = r"^[Hh]eading\s*(\d+)$"
BULLET_NAME = r"(?i)^(?:list[\-\s]?bullet|bullets?$)"
NUMBER_NAME = r"(?i)^list[\-\s]?number"


def _heading_number(style_id: Column) -> Column:
    return F.when(style_id.rlike(HEADING_ID), F.regexp_extract(style_id, HEADING_ID, 1).cast("int"))


def style_levels(styles: DataFrame, doc: str) -> DataFrame:
    """(doc, style_id, level): HeadingN by its id, an outline level of up to 8 plus one, or what the
    style it is based on has, along a chain of any length; a cycle has no level. Each round doubles
    how far a style looks, so a chain of n styles takes log2(n) joins on (doc, style), and rounds go
    on as long as some style looks further; 2**k steps reach round any cycle of a document's
    styles."""
    own = F.coalesce(_heading_number(F.col("style_id")), F.when(F.col("outline_lvl") <= 8, F.col("outline_lvl") + 1))
    known = styles.select(doc, "style_id").distinct()
    df = styles.select(doc, "style_id", F.when(own.isNull(), F.col("based_on")).alias("up"), own.alias("level"))
    longest = known.groupBy(doc).count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(0, longest - 1).bit_length()):
        parent = df.select(doc, F.col("style_id").alias("up"), F.col("level").alias("_level"), F.col("up").alias("_up"))
        df = df.join(parent, [doc, "up"], "left").select(
            doc, "style_id", F.coalesce("level", "_level").alias("level"), F.when(F.col("level").isNull() & F.col("_level").isNull(), F.col("_up")).alias("up")
        )
    return df.filter("level is not null").select(doc, "style_id", "level")


def list_styles(styles: DataFrame, doc: str) -> DataFrame:
    """(doc, bullet, numbered): the shortest style id of each kind, the first of equals. A style is
    one by its id or, where there is a column `name`, by its display name; bullets come first."""
    names = ["style_id", *(["name"] if "name" in styles.columns else [])]
    is_one = lambda p: reduce(operator.or_, (F.coalesce(F.col(n).rlike(p), F.lit(False)) for n in names))
    bullet = is_one(BULLET_NAME)
    number = is_one(NUMBER_NAME) & ~bullet
    pick = lambda c: F.min_by(F.when(c, F.col("style_id")), F.when(c, F.struct(F.length("style_id"), F.col("pos"))))
    return styles.groupBy(doc).agg(pick(bullet).alias("bullet"), pick(number).alias("numbered"))


def styles_in_use(blocks: DataFrame, doc: str) -> DataFrame:
    """(doc, level, style_id): the commonest style of the first block of sections of each level,
    the first seen of equals."""
    w = Window.partitionBy(doc, "sec_idx").orderBy("pos")
    first = blocks.withColumn("nth", F.row_number().over(w)).filter("nth = 1 and level > 0")
    counted = first.groupBy(doc, "level", "style_id").agg(F.count("*").alias("n"), F.min("pos").alias("seen"))
    best = Window.partitionBy(doc, "level").orderBy(F.desc("n"), "seen")
    return counted.withColumn("nth", F.row_number().over(best)).filter("nth = 1").select(doc, "level", "style_id", "n")


def merged_styles(in_use: DataFrame, declared: DataFrame, doc: str) -> DataFrame:
    """One style for each level: that in use, else the declared one that sorts first."""
    both = in_use.select(doc, "level", "style_id", F.lit(0).alias("rank")).unionByName(
        declared.select(doc, "level", "style_id", F.lit(1).alias("rank"))
    )
    w = Window.partitionBy(doc, "level").orderBy("rank", "style_id")
    return both.withColumn("nth", F.row_number().over(w)).filter("nth = 1").select(doc, "level", "style_id", (F.col("rank") == 0).alias("in_use"))


def block_levels(blocks: DataFrame, levels: DataFrame, doc: str) -> DataFrame:
    """blocks with heading_level by style, and by the style's own name where it isn't declared."""
    named = _heading_number(F.col("style_id"))
    known = levels.select(doc, "style_id", F.col("level").alias("_level"))
    return blocks.join(known, [doc, "style_id"], "left").withColumn("heading_level", F.coalesce("_level", named)).drop("_level")
