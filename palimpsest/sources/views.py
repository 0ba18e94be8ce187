"""Markdown views of the test tables, each as a DataFrame and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: HTML to Markdown as ordered replacements: pattern, replacement with \1 for the group.
PAGE_STEPS = (
    (r"(?is)<head\b.*?</head>", ""),
    (r"(?is)<script\b.*?</script>", ""),
    (r"(?is)<style\b.*?</style>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<h1[^>]*>(.*?)</h1>", "\n# \\1\n"),
    (r"(?i)<li[^>]*>", "\n* "),
    (r"(?is)<b>(.*?)<br>", "\n\n**\\1**\n\n"),
    (r"(?i)</?p[^>]*>", "\n\n"),
    (r"(?i)</(ul|div|nav|footer)>", "\n"),
    (r"<[^>]+>", ""),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
    (r"\n{3,}", "\n\n"),
)


def html_to_md(markup: Column) -> Column:
    for pattern, by in PAGE_STEPS:
        markup = F.regexp_replace(markup, pattern, by.replace("\\1", "$1"))
    return markup


def _page_sql() -> str:
    sql = "html"
    for pattern, by in PAGE_STEPS:
        sql = f"regexp_replace({sql}, '{pattern}', '{by}', 'g')"
    return f"pages_md AS (SELECT page_id, {sql} AS text FROM pages)"


PAGES_MD = _page_sql()


def pages_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: each page's HTML as Markdown."""
    return read(spark, sf_dir, "pages").select("page_id", html_to_md(F.col("html")).alias("text"))


#: Turn sections of a conversation and their revision, by k = (conv_id + turn) % 5.
TURNS = r"""turns AS (SELECT conv_id, turn, text, (conv_id + turn) % 5 AS k, string_split(text, ' ') AS w,
  'turn ' || turn || ' ' || array_to_string(regexp_extract_all(text, '\S+')[1:5], ' ') AS heading FROM conversations)"""
CONV_MD = (
    TURNS
    + """,
conv_md AS (SELECT conv_id, string_agg('## ' || heading || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn) AS text
  FROM turns GROUP BY conv_id)"""
)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 1, 5), " ")
    return read(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        "text",
        ((F.col("conv_id") + F.col("turn")) % 5).alias("k"),
        F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(" "), first).alias("heading"),
    )


def _joined(parts: DataFrame) -> DataFrame:
    """conv_id and text from (conv_id, turn, part), a conversation's parts in order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "part")))
    return parts.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("text"))


def _section(heading: Column, text: Column) -> Column:
    return F.concat(F.lit("## "), heading, F.lit("\n\n"), text, F.lit("\n\n"))


def conv_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: a Markdown document for each conversation, one section for each turn."""
    return _joined(turns(spark, sf_dir).select("conv_id", "turn", _section(F.col("heading"), F.col("text")).alias("part")))


def conv_md_revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: the same with edits chosen by k: none, words dropped, most words dropped, heading
    changed, section inserted."""
    words = F.split("text", " ")
    text = (
        F.when((F.col("k") == 1) & (F.size(words) >= 6), F.array_join(F.filter(words, lambda w, i: i % 12 != 5), " "))
        .when(F.col("k") == 2, F.array_join(F.filter(words, lambda w, i: i % 3 == 0), " "))
        .otherwise(F.col("text"))
    )
    heading = F.when(F.col("k") == 3, F.concat("heading", F.lit(" revised"))).otherwise(F.col("heading"))
    number = (F.col("conv_id") * 100 + F.col("turn")).cast("string")
    before = F.when(F.col("k") == 4, _section(F.concat(F.lit("inserted "), number), F.lit("fresh text"))).otherwise("")
    return _joined(turns(spark, sf_dir).select("conv_id", "turn", F.concat(before, _section(heading, text)).alias("part")))


ROW_PAIRS = """rows_base AS (SELECT doc_id AS table_id, i - 1 AS nth, ['' || (i - 1), replace(ls[i], '|', ' '), lang || ' ' || source] AS cells
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents)))"""


def row_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the V5 tables."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("table_id"))


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: a table for each document, a row for each of its lines, whole: (table_id, nth, cells)."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("table_id"), "lang", "source", F.posexplode(F.split("text", "\n")).alias("nth", "line"))
    return rows.select("table_id", "nth", F.array(F.col("nth").cast("string"), F.translate("line", "|", " "), F.concat_ws(" ", "lang", "source")).alias("cells"))


def revised_rows(base: DataFrame) -> DataFrame:
    """V5 revised, by nth % 7: deleted, last cell changed, or a row inserted after it."""
    k = F.col("nth") % 7
    changed = F.when(k == 1, F.array(F.get("cells", F.lit(0)), F.get("cells", F.lit(1)), F.concat(F.get("cells", F.lit(2)), F.lit("1")))).otherwise(
        F.col("cells")
    )
    kept = base.filter(k != 0).select("table_id", "nth", F.lit(0).alias("extra"), changed.alias("cells"))
    new = F.array(F.concat(F.col("nth").cast("string"), F.lit("x")), F.lit("1234567890"), F.lit("zzz qqq"))
    return kept.unionByName(base.filter(k == 2).select("table_id", "nth", F.lit(1).alias("extra"), new.alias("cells")))
