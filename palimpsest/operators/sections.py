"""Documents to sections, blocks and lines.

A document is a row, so sectioning is done inside it: break lines are marked, the text is split
at the marks and the pieces are exploded. Nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T

MARK = "\u0001"


def numbered_mode(text: Column) -> Column:
    """Numbered lines count as headings in documents with fewer than three ATX headings."""
    return F.size(F.filter(T.lines(text), T.is_atx)) < 3


def heading_level(line: Column, numbered: Column) -> Column:
    """Level of a heading line, else null."""
    able = numbered & F.substring(line, 1, 1).rlike(r"^[\d*\s]")
    first = line.rlike(T.NUMBERED_1)
    bold = T.strip(F.regexp_extract(line, T.NUMBERED_1, 1)).startswith("**")
    return (
        F.when(T.is_atx(line), F.length(F.regexp_extract(line, T.ATX, 1)))
        .when(able & first & ~bold, F.lit(1))
        .when(able & ~first & line.rlike(T.NUMBERED_2), F.lit(2))
    )


def heading_text(line: Column) -> Column:
    return T.strip(
        F.when(T.is_atx(line), F.regexp_extract(line, T.ATX, 2))
        .when(line.rlike(T.NUMBERED_1), F.regexp_extract(line, T.NUMBERED_1, 1))
        .otherwise(F.regexp_extract(line, T.NUMBERED_2, 1))
    )


def line_table(docs: DataFrame, doc_id: str, text: str = "text", numbered: bool = True) -> DataFrame:
    """(doc_id, pos, line, level, heading, marker) of every line; numbered=False never takes
    numbered lines for headings."""
    source = docs.select(doc_id, T.unix_lines(F.col(text)).alias("_t"))
    source = source.withColumn("_numbered", numbered_mode(F.col("_t")) if numbered else F.lit(False))
    rows = source.select(doc_id, "_numbered", F.posexplode(T.lines(F.col("_t"))).alias("pos", "line"))
    rows = rows.withColumn("level", heading_level(F.col("line"), F.col("_numbered")))
    return rows.select(
        doc_id,
        "pos",
        "line",
        "level",
        F.when(F.col("level").isNotNull(), heading_text(F.col("line"))).alias("heading"),
        F.when(F.col("level").isNull(), T.separator_name(F.col("line"))).alias("marker"),
    )


def md_sections(docs: DataFrame, doc_id: str, text: str = "text") -> DataFrame:
    """(doc_id, sec_idx, heading, level, content) of every section.

    Text before the first heading is section "(preamble)" of level 0 and dropped if blank; a
    heading that another break follows at once is dropped; a separator line begins a section of
    level 0 named by it and stays in its content."""
    source = docs.select(doc_id, T.unix_lines(F.col(text)).alias("_t")).withColumn("_numbered", numbered_mode(F.col("_t")))
    mark = lambda x: F.when(
        heading_level(x, F.col("_numbered")).isNotNull() | T.separator_name(x).isNotNull(), F.concat(F.lit(MARK), x)
    ).otherwise(x)
    source = source.withColumn("_pieces", F.split(F.array_join(F.transform(T.lines(F.col("_t")), mark), "\n"), MARK))
    count = F.size("_pieces")

    def piece(x: Column, k: Column) -> Column:
        line = F.substring_index(x, "\n", 1)
        level = F.when(k > 0, heading_level(line, F.col("_numbered")))
        body = F.when(level.isNotNull(), F.regexp_replace(x, r"^[^\n]*\n?", "")).otherwise(x)
        name = F.when(k == 0, "(preamble)").when(level.isNotNull(), heading_text(line)).otherwise(T.separator_name(line))
        kept = F.when(k == 0, T.strip(body) != "").otherwise((body != "") | (k == count - 1))
        return F.struct(name.alias("heading"), F.coalesce(level, F.lit(0)).alias("level"), T.strip(body).alias("content"), kept.alias("kept"))

    found = F.filter(F.transform("_pieces", piece), lambda s: s["kept"])
    return source.select(doc_id, F.posexplode(found).alias("sec_idx", "_s")).select(
        doc_id, "sec_idx", *[F.col(f"_s.{c}").alias(c) for c in ("heading", "level", "content")]
    )


def md_blocks(docs: DataFrame, doc_id: str, text: str = "text", numbered: bool = True) -> DataFrame:
    """Lines as blocks: (doc_id, pos, kind, level, text, cells, bold). Kinds: heading, separator,
    list, table_row, blank, para."""
    rows = line_table(docs, doc_id, text, numbered)
    line = F.col("line")
    stripped = T.strip(line)
    is_bullet = T.is_bullet(line)
    kind = (
        F.when(F.col("level").isNotNull(), "heading")
        .when(F.col("marker").isNotNull(), "separator")
        .when(stripped == "", "blank")
        .when(is_bullet, "list")
        .when(stripped.contains("|"), "table_row")
        .otherwise("para")
    )
    value = (
        F.when(F.col("level").isNotNull(), F.col("heading"))
        .when(F.col("marker").isNotNull(), F.col("marker"))
        .when(is_bullet, T.clean_inline(F.regexp_extract(line, T.BULLET, 1)))
        .otherwise(T.clean_inline(line))
    )
    # Reading the partition id keeps the optimizer from moving later filters below this projection,
    # where each use of a column would repeat its whole expression.
    pos = F.when(F.spark_partition_id() >= 0, F.col("pos")).alias("pos")
    return rows.select(
        doc_id, pos, kind.alias("kind"), F.coalesce("level", F.lit(0)).alias("level"), value.alias("text"), (line.contains("**") & stripped.rlike(r"\*\*.+?\*\*")).alias("bold")
    )


def resplit(large: DataFrame, headings: DataFrame, pair_id: str, chars: int = 2000, factor: float = 2.5, prefix: int = 10) -> DataFrame:
    """Large matched sections (pair_id, sec_idx, content, base_chars) cut at lines that equal an
    unmatched base heading (pair_id, heading): in lower case, normalized, or, for lines of ten
    characters or more, as its beginning. Gives (pair_id, sec_idx, part, heading, content).

    Lines meet headings through three equi-joins; the prefix case joins on the line's first
    characters."""
    rows = large.filter((F.length("content") >= chars) & (F.length("content") >= F.col("base_chars") * factor))
    lines = rows.select(pair_id, "sec_idx", F.posexplode(T.lines(F.col("content"))).alias("pos", "line"))
    lines = lines.withColumns({"_low": F.lower(T.strip(F.col("line"))), "_plain": T.normalize_heading(F.col("line"))})
    known = headings.select(pair_id, "heading").distinct().withColumns({"_hlow": F.lower("heading"), "_hplain": T.normalize_heading(F.col("heading"))})
    hit = []
    for rank, (a, b) in enumerate((("_low", "_hlow"), ("_plain", "_hplain"))):
        right = known.filter(F.col(b) != "").select(pair_id, F.col(b).alias(a), F.col("heading").alias("_h"))
        hit.append(lines.filter(F.col(a) != "").join(right, [pair_id, a]).select(pair_id, "sec_idx", "pos", F.lit(rank).alias("rank"), "_h"))
    short = lambda c: F.substring(c, 1, prefix)
    right = known.select(pair_id, short(F.col("_hlow")).alias("_cut"), "_hlow", F.col("heading").alias("_h"))
    left = lines.filter(F.length("_low") >= prefix).withColumn("_cut", short(F.col("_low")))
    hit.append(left.join(right, [pair_id, "_cut"]).filter(F.col("_hlow").startswith(F.col("_low"))).select(pair_id, "sec_idx", "pos", F.lit(2).alias("rank"), "_h"))
    best = hit[0].unionByName(hit[1]).unionByName(hit[2]).groupBy(pair_id, "sec_idx", "pos").agg(F.min_by("_h", F.struct("rank", "_h")).alias("heading"))
    marked = lines.join(best, [pair_id, "sec_idx", "pos"], "left")
    w = Window.partitionBy(pair_id, "sec_idx").orderBy("pos")
    marked = marked.withColumn("part", F.count("heading").over(w))
    body = F.array_sort(F.collect_list(F.when(F.col("heading").isNull(), F.struct("pos", "line"))))
    return marked.groupBy(pair_id, "sec_idx", "part").agg(F.max("heading").alias("heading"), T.strip(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("content"))
