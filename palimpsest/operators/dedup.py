"""Duplicate removal and clean-up over ordered blocks (doc_id, pos, kind, text, ..).

Each takes the document key's name and returns the rows to drop or the rows kept, as said. One
window over the document serves each; equal texts compare in a normalized form made before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive_duplicates(blocks: DataFrame, doc: str, key: str = "norm") -> DataFrame:
    """Blocks equal to the one just before; blanks and table rows interrupt a run and never count."""
    w = Window.partitionBy(doc).orderBy("pos")
    plain = F.col("kind").isin("para", "list") & (F.col(key) != "")
    before = F.lag(F.when(plain, F.col(key))).over(w)
    return blocks.withColumn("_before", before).filter(plain & (F.col(key) == F.col("_before"))).drop("_before")


PARAGRAPHS = ("para", "list")


def repeated_in_section(blocks: DataFrame, doc: str, key: str = "norm", chars: int = 40) -> DataFrame:
    """Paragraphs and list items of `chars` characters or more in edited sections whose key occurred
    before in their section."""
    w = Window.partitionBy(doc, "sec_idx", key).orderBy("pos")
    long = blocks.filter(F.col("edited") & (F.length("text") >= chars) & F.col("kind").isin(*PARAGRAPHS))
    return long.withColumn("nth", F.row_number().over(w)).filter("nth > 1")


def _with_block_before(blocks: DataFrame, doc: str) -> DataFrame:
    """blocks with `_before`, the paragraph or list item just before in the same section (pos, kind,
    text); a heading or a table in between leaves none."""
    w = Window.partitionBy(doc).orderBy("pos")
    one = F.when(F.col("kind").isin(*PARAGRAPHS), F.struct("pos", "kind", "text", "sec_idx"))
    before = F.lag(one).over(w)
    return blocks.withColumn("_before", F.when(before["sec_idx"] == F.col("sec_idx"), before))


def _leads(orphan: int) -> Column:
    """The block before is a short line that would be left as a heading of nothing."""
    return F.length("_before.text").between(1, orphan - 1) & (F.col("_before.kind") != "list")


def across_sections(blocks: DataFrame, doc: str, key: str = "norm", chars: int = 40, orphan: int = 100) -> DataFrame:
    """Paragraphs and list items of edited sections whose key stands in a preserved section ("copy"),
    and what stands just before them ("orphan"): a line of fewer than `orphan` characters that is no
    list item, or anything whose text is a preserved section's heading.

    What a document's preserved sections hold comes from one window over the document, so blocks
    are shuffled once."""
    w = Window.partitionBy(doc)
    paragraph = F.col("kind").isin(*PARAGRAPHS)
    long = paragraph & (F.length("text") >= chars)
    held = F.collect_set(F.when(~F.col("edited") & long, F.col(key))).over(w)
    edited = F.collect_set(F.when(F.col("edited") & (F.col("kind") == "heading"), F.col("text"))).over(w)
    titles = F.collect_set(F.when(~F.col("edited") & (F.col("kind") == "heading"), F.col("text"))).over(w)
    df = _with_block_before(blocks, doc).withColumns({"_held": held, "_titles": F.array_except(titles, edited)})
    copy = F.col("edited") & long & F.array_contains("_held", F.col(key))
    df = df.withColumn("_copy", copy)
    # A copy that is itself taken isn't the orphan of the next one.
    before_copy = F.lag("_copy").over(Window.partitionBy(doc).orderBy("pos"))
    title = F.array_contains("_titles", F.col("_before.text"))
    leads = F.col("_before").isNotNull() & ~F.coalesce(before_copy, F.lit(False)) & (_leads(orphan) | title)
    gone = df.withColumn("_leads", leads).filter("_copy")
    both = F.array(
        F.struct(F.col("pos"), F.lit("copy").alias("reason")),
        F.when(F.col("_leads"), F.struct(F.col("_before.pos").alias("pos"), F.lit("orphan").alias("reason"))),
    )
    return gone.select(doc, F.explode(both).alias("x")).filter("x is not null").select(doc, "x.*")


def preserved_headings(blocks: DataFrame, doc: str, key: str = "norm", orphan: int = 100) -> DataFrame:
    """Paragraphs and list items of edited sections whose key equals a preserved section's heading
    ("heading"), and the short line just before each that is no list item ("orphan")."""
    w = Window.partitionBy(doc)
    titles = F.collect_set(F.when((F.col("kind") == "heading") & ~F.col("edited"), F.col(key))).over(w)
    hit = F.col("edited") & F.col("kind").isin(*PARAGRAPHS) & (F.col(key) != "") & F.array_contains("_titles", F.col(key))
    df = _with_block_before(blocks, doc).withColumn("_titles", titles).withColumn("_hit", hit)
    before_hit = F.coalesce(F.lag("_hit").over(Window.partitionBy(doc).orderBy("pos")), F.lit(False))
    leads = F.col("_before").isNotNull() & ~before_hit & _leads(orphan)
    gone = df.withColumn("_leads", leads).filter("_hit")
    both = F.array(
        F.struct(F.col("pos"), F.lit("heading").alias("reason")),
        F.when(F.col("_leads"), F.struct(F.col("_before.pos").alias("pos"), F.lit("orphan").alias("reason"))),
    )
    return gone.select(doc, F.explode(both).alias("x")).filter("x is not null").select(doc, "x.*")


def duplicated_sections(blocks: DataFrame, doc: str) -> DataFrame:
    """Blocks (doc, pos, kind, text, edited) of copies of preserved sections inside edited ones: a
    heading that follows an edited section or another copy there, names a preserved section, and is
    followed by the same heading; it goes with its body, up to that one."""
    w = Window.partitionBy(doc).orderBy("pos")
    heads = blocks.filter(F.col("kind") == "heading").select(doc, "pos", "text", "edited")
    heads = heads.withColumns({"_next": F.lead("text").over(w), "_end": F.lead("pos").over(w), "_before": F.lag("edited").over(w), "_last": F.lag("text").over(w)})
    # Behind a copy the scan is still inside the edited section, and the heading that confirms it
    # may begin another copy; so inside lasts over a run of preserved headings of one name.
    run = F.sum(F.when(F.col("edited") | (F.col("text") != F.col("_last")) | F.col("_last").isNull(), 1).otherwise(0)).over(w)
    heads = heads.withColumn("_run", run)
    inside = F.first("_before").over(Window.partitionBy(doc, "_run").orderBy("pos"))
    heads = heads.withColumn("_inside", F.coalesce(inside, F.lit(False)))
    copies = heads.filter(~F.col("edited") & F.col("_inside") & (F.col("_next") == F.col("text")))
    spans = copies.groupBy(doc).agg(F.collect_list(F.struct(F.col("pos").alias("a"), F.col("_end").alias("b"))).alias("_spans"))
    within = F.exists("_spans", lambda s: (s["a"] <= F.col("pos")) & (F.col("pos") < s["b"]))
    return blocks.join(spans, doc).filter(within).drop("_spans")


def repeated_near_top(blocks: DataFrame, doc: str, key: str = "norm", first: int = 2) -> DataFrame:
    """Of the first body paragraphs of a section, those equal to its heading."""
    w = Window.partitionBy(doc, "sec_idx").orderBy("pos")
    body = blocks.filter((F.col("kind") == "para") & (F.col(key) != "")).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= first)
    heading = blocks.filter(F.col("kind") == "heading").select(doc, "sec_idx", F.col(key).alias("_h"))
    return body.join(heading, [doc, "sec_idx"]).filter(F.col(key) == F.col("_h")).drop("_h", "nth")


def extra_headings(blocks: DataFrame, doc: str) -> DataFrame:
    """The second and later headings of a section, which become paragraphs."""
    w = Window.partitionBy(doc, "sec_idx").orderBy("pos")
    return blocks.filter(F.col("kind") == "heading").withColumn("nth", F.row_number().over(w)).filter("nth > 1")


def kept_heading(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The heading of each section after an edit: the original one, put first if the edit has none."""
    joined = old.select(*keys, F.col("heading").alias("_old")).join(new.select(*keys, F.col("heading").alias("_new")), keys, "left")
    how = F.when(F.col("_new").isNull(), "prepended").when(F.col("_new") == F.col("_old"), "same").otherwise("restored")
    return joined.select(*keys, F.col("_old").alias("heading"), how.alias("how"))


def list_groups(blocks: DataFrame, doc: str) -> DataFrame:
    """Unbroken runs of list blocks: (doc, group, first, last, n)."""
    w = Window.partitionBy(doc).orderBy("pos")
    item = F.col("kind") == "list"
    df = blocks.withColumn("group", F.sum((~item).cast("int")).over(w)).filter(item)
    g = df.groupBy(doc, "group").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"))
    return g.withColumn("group", F.row_number().over(Window.partitionBy(doc).orderBy("first")) - 1)


def reordered(items: DataFrame, group: list[str], slot: str, order: str) -> DataFrame:
    """items with `new_slot`: those with an order take the slots of those with an order, sorted;
    others stay. Both ranks come from windows over the same keys."""
    has = F.col(order).isNotNull()
    keys = [*group, "_has"]
    df = items.withColumn("_has", has)
    by_slot = F.row_number().over(Window.partitionBy(*keys).orderBy(slot))
    by_order = F.row_number().over(Window.partitionBy(*keys).orderBy(order, slot))
    df = df.withColumns({"_rs": by_slot, "_ro": by_order})
    slots = df.filter("_has").select(*group, F.col("_rs").alias("_ro"), F.col(slot).alias("_to"), "_has")
    return df.join(slots, [*group, "_ro", "_has"], "left").withColumn("new_slot", F.coalesce("_to", slot)).drop("_has", "_rs", "_ro", "_to")


def nth_occurrence(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """items numbered among those of equal keys, so that the n-th here meets the n-th there."""
    return items.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def repeated_lines(lines: DataFrame, doc: str, least: int = 3, chars: int = 20) -> DataFrame:
    """Stripped lines of `chars` characters or more that occur `least` times or more."""
    counted = lines.filter(F.length("line") >= chars).groupBy(doc, "line").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least)
