"""Quality checks of rendered documents, and round-trip comparison of two Markdown sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from palimpsest.functions import text as T
from palimpsest.operators.sections import md_sections

BOLD = r"(?is)<(?:b|strong)>(.*?)</(?:b|strong)>([^<]*)"


def html_elements(pages: DataFrame, doc: str, html: str = "html") -> DataFrame:
    """(doc, pos, tag, level, text, markup) of headings, paragraphs, list items, cells and tables
    in order; level is a heading's rank."""
    pattern = r"(?is)<(h[1-6]|p|li|td|table)\b[^>]*>(.*?)(?=<(?:/?(?:h[1-6]|p|li|td|tr|ul|ol|table|div))\b|$)"
    tags = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    inner = F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    rows = pages.select(doc, F.posexplode(F.arrays_zip(tags.alias("tag"), inner.alias("markup"))).alias("pos", "e"))
    tag = F.lower("e.tag")
    return rows.select(
        doc,
        "pos",
        tag.alias("tag"),
        F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int")).alias("level"),
        T.strip_tags(F.col("e.markup")).alias("text"),
        F.col("e.markup").alias("markup"),
    )


def section_span(elements: DataFrame, doc: str, words: str) -> DataFrame:
    """Elements after the first heading that contains the words, up to the next heading of the same
    or a higher rank."""
    w = Window.partitionBy(doc)
    hit = F.col("level").isNotNull() & F.lower("text").contains(words.lower())
    df = elements.withColumn("_at", F.min(F.when(hit, F.struct("pos", "level"))).over(w)).filter(F.col("_at").isNotNull())
    stop = F.min(F.when((F.col("pos") > F.col("_at.pos")) & (F.col("level") <= F.col("_at.level")), F.col("pos"))).over(w)
    df = df.withColumn("_stop", stop)
    return df.filter((F.col("pos") > F.col("_at.pos")) & (F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))).drop("_at", "_stop")


def table_after(elements: DataFrame, doc: str, words: str) -> DataFrame:
    """(doc, pos) of the first table after a heading, else after a paragraph, with the words."""
    has = F.lower("text").contains(words.lower())
    marks = elements.groupBy(doc).agg(
        F.min(F.when(has & F.col("level").isNotNull(), F.col("pos"))).alias("_h"), F.min(F.when(has & (F.col("tag") == "p"), F.col("pos"))).alias("_p")
    )
    tables = elements.filter(F.col("tag") == "table").join(marks, doc)
    return tables.groupBy(doc).agg(
        F.coalesce(F.min(F.when(F.col("pos") > F.col("_h"), F.col("pos"))), F.min(F.when(F.col("pos") > F.col("_p"), F.col("pos")))).alias("pos")
    ).filter("pos is not null")


def bold_items(markup: Column) -> Column:
    """Array of (bold, after): bold texts and up to 80 characters that follow each."""
    bold = F.regexp_extract_all(markup, F.lit(BOLD), F.lit(1))
    after = F.regexp_extract_all(markup, F.lit(BOLD), F.lit(2))
    return F.transform(
        F.arrays_zip(bold.alias("b"), after.alias("a")),
        lambda x: F.struct(T.strip_tags(x["b"]).alias("bold"), F.substring(T.strip(x["a"]), 1, 80).alias("after")),
    )


def _status(doc_rows: DataFrame, doc: str, found: DataFrame, absent: str) -> DataFrame:
    return doc_rows.select(doc).join(found, doc, "left").withColumn("status", F.coalesce("status", F.lit(absent)))


def bold_scope(pages: DataFrame, doc: str, issue: str, share: float, tail_excuses: bool, html: str = "html") -> DataFrame:
    """Whether bold covers whole cells or items of ten characters or more: (doc, issue_id, status)."""
    e = html_elements(pages, doc, html).filter(F.col("tag").isin("td", "li", "p") & (F.length("text") >= 10))
    e = e.withColumn("items", bold_items(F.col("markup"))).filter(F.size("items") > 0)
    total = F.length(F.array_join(F.transform("items", lambda x: x["bold"]), " "))
    tail = F.exists("items", lambda x: x["after"] != "")
    bad = (total >= F.length("text") * share) & (~tail if tail_excuses else F.lit(True))
    found = e.groupBy(doc).agg(F.when(F.bool_or(bad), "FAIL").otherwise("PASS").alias("status"))
    return _status(pages, doc, found, "NOT_APPLICABLE").select(doc, F.lit(issue).alias("issue_id"), "status")


def heading_rank(pages: DataFrame, doc: str, issue: str, words: str, html: str = "html") -> DataFrame:
    """The rank of the first heading with the words: h1 is inconclusive, lower ranks and list items pass."""
    e = html_elements(pages, doc, html).filter(F.lower("text").contains(words.lower()))
    level = F.min_by("level", F.when(F.col("level").isNotNull(), F.col("pos")))
    found = e.groupBy(doc).agg(
        F.when(level == 1, "INCONCLUSIVE").when(level > 1, "PASS").when(F.bool_or(F.col("tag") == "li"), "PASS").otherwise("NOT_APPLICABLE").alias("status")
    )
    return _status(pages, doc, found, "NOT_APPLICABLE").select(doc, F.lit(issue).alias("issue_id"), "status")


def colon_boundary(pages: DataFrame, doc: str, issue: str, html: str = "html", source: str | None = None) -> DataFrame:
    """Colons inside and outside of bold labels of five characters or more; an outside one whose
    label has it inside in the source Markdown is a mismatch."""
    items = F.filter(bold_items(F.col(html)), lambda x: F.length(x["bold"]) >= 5)
    df = pages.withColumn("_i", items)
    inside = F.size(F.filter("_i", lambda x: x["bold"].endswith(":")))
    outside = F.filter("_i", lambda x: ~x["bold"].endswith(":") & x["after"].startswith(":"))
    wrong = F.size(F.filter(outside, lambda x: F.lower(F.col(source)).contains(F.lower(F.concat(F.lit("**"), x["bold"], F.lit(":**")))))) if source else F.lit(0)
    status = F.when(inside + F.size(outside) == 0, "NOT_APPLICABLE").when(wrong > 0, "FAIL").otherwise("PASS")
    return df.select(doc, F.lit(issue).alias("issue_id"), inside.alias("inside"), F.size(outside).alias("outside"), wrong.alias("mismatches"), status.alias("status"))


def smart_quotes(pages: DataFrame, doc: str, issue: str, html: str = "html", source: str | None = None) -> DataFrame:
    """Curly quotes that the source lacks."""
    here = sum(T.curly_quotes(F.col(html)))
    if source is None:
        return pages.select(doc, F.lit(issue).alias("issue_id"), F.lit("INCONCLUSIVE").alias("status"))
    there = sum(T.curly_quotes(F.col(source)))
    return pages.select(doc, F.lit(issue).alias("issue_id"), F.when((here == 0) | (there > 0), "PASS").otherwise("FAIL").alias("status"))


def phrase_not_bold(pages: DataFrame, doc: str, issue: str, phrase: str, html: str = "html") -> DataFrame:
    """Whether a phrase stands in bold text."""
    has = F.lower(T.strip_tags(F.col(html))).contains(phrase.lower())
    bold = F.exists(bold_items(F.col(html)), lambda x: F.lower(x["bold"]).contains(phrase.lower()))
    return pages.select(doc, F.lit(issue).alias("issue_id"), F.when(~has, "NOT_APPLICABLE").when(bold, "FAIL").otherwise("PASS").alias("status"))


def double_spaces(pages: DataFrame, doc: str, issue: str, html: str = "html", source: str = "source") -> DataFrame:
    """Double spaces of the source that the rendered side lost."""
    n = F.size(T.double_space_lines(F.col(source)))
    kept = F.col(html).rlike(r"(^|[^\s])  ([^\s]|$)") | F.col(html).contains("&nbsp;")
    return pages.select(doc, F.lit(issue).alias("issue_id"), F.when(F.col(source).isNull(), "INCONCLUSIVE").when(n == 0, "PASS").when(kept, "PASS").otherwise("FAIL").alias("status"))


def report(findings: list[DataFrame], doc: str) -> DataFrame:
    """Findings of several checks counted by issue and status."""
    all_of = None
    for f in findings:
        part = f.select(doc, "issue_id", "status")
        all_of = part if all_of is None else all_of.unionByName(part)
    return all_of.groupBy("issue_id", "status").agg(F.count("*").alias("n"))


def gated(findings: DataFrame, sets: DataFrame, doc: str, applicable: dict[str, list[str]]) -> DataFrame:
    """Findings (doc, issue_id, status) with NOT_APPLICABLE where the document's set, from (doc,
    doc_set), isn't one that the issue is checked for; "all" stands for any set. A document without
    a set, and an issue that isn't named, are not applicable."""
    allowed = F.lit(False)
    for issue, names in applicable.items():
        known = F.lit(True) if "all" in names else F.col("doc_set").isin(*names)
        allowed = allowed | ((F.col("issue_id") == issue) & F.coalesce(known, F.lit(False)))
    df = findings.join(sets.select(doc, "doc_set"), doc, "left")
    return df.withColumn("status", F.when(allowed, F.col("status")).otherwise("NOT_APPLICABLE")).drop("doc_set")


def verdicts(findings: DataFrame, doc: str) -> DataFrame:
    """A row a document: its issues, comma-joined in their order, by what their status says: a
    likely defect (FAIL), an artifact of the round trip (PASS), inconclusive, or not applicable.
    Any other status counts as not applicable; "none" stands for no issue."""
    named = F.col("status").isin("FAIL", "PASS", "INCONCLUSIVE")
    of = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("issue_id")))), ", ")
    list_of = lambda c: F.when(F.count_if(c) > 0, of(c)).otherwise("none")
    return findings.groupBy(doc).agg(
        list_of(F.col("status") == "FAIL").alias("defects"),
        list_of(F.col("status") == "PASS").alias("artifacts"),
        list_of(F.col("status") == "INCONCLUSIVE").alias("inconclusive"),
        list_of(~F.coalesce(named, F.lit(False))).alias("not_applicable"),
    )


def level_histogram(source: DataFrame, output: DataFrame, doc: str) -> DataFrame:
    """(doc, level, n_source, n_output, missing) of the levels that the source has; from sections."""
    a = source.filter("level > 0").groupBy(doc, "level").agg(F.count("*").alias("n_source"))
    b = output.filter("level > 0").groupBy(doc, "level").agg(F.count("*").alias("n_output"))
    df = a.join(b, [doc, "level"], "left").withColumn("n_output", F.coalesce("n_output", F.lit(0)))
    return df.withColumn("missing", F.greatest(F.col("n_source") - F.col("n_output"), F.lit(0)))


def over_structured(source: DataFrame, output: DataFrame, doc: str) -> DataFrame:
    """Documents whose output has over twice the headings, and more than five more."""
    a = source.filter("level > 0").groupBy(doc).agg(F.count("*").alias("n_source"))
    b = output.filter("level > 0").groupBy(doc).agg(F.count("*").alias("n_output"))
    df = b.join(a, doc, "left").withColumn("n_source", F.coalesce("n_source", F.lit(0)))
    return df.filter((F.col("n_output") > F.col("n_source") * 2) & (F.col("n_output") - F.col("n_source") > 5))


def round_trip_warnings(source: DataFrame, output: DataFrame, doc: str, similarity: bool = True) -> DataFrame:
    """(doc, sec_idx, warning) by comparing sections of equal normalized heading, the output's last
    one, and (doc, null, warning) for lines that lost repetitions."""
    from palimpsest.functions.similarity import ratio

    @F.pandas_udf(DoubleType())
    def score(a, b):
        import pandas as pd

        return pd.Series([ratio(x, y, autojunk=True) for x, y in zip(a, b, strict=True)], dtype="float64")

    a = md_sections(source, doc).withColumn("key", T.normalize_text(F.col("heading")))
    b = md_sections(output, doc).withColumn("key", T.normalize_text(F.col("heading")))
    last = b.withColumn("nth", F.row_number().over(Window.partitionBy(doc, "key").orderBy(F.desc("sec_idx")))).filter("nth = 1")
    j = a.join(last.select(doc, "key", F.col("content").alias("out")), [doc, "key"]).withColumns(
        {"na": T.normalize_text(F.col("content")), "nb": T.normalize_text(F.col("out"))}
    )
    la, lb = F.length("na"), F.length("nb")
    ta, tb = T.table_count(F.col("content")), T.table_count(F.col("out"))
    ba, bb = T.prefix_count(F.col("content"), "* "), T.prefix_count(F.col("out"), "* ")
    plain = F.array_compact(
        F.array(
            F.when((tb > ta) & (ta == 0), "misplaced_table").when(tb > ta + 1, "duplicated_table"),
            F.when((la > 100) & (lb > la * 1.5), "duplicated_content").when((la > 100) & (lb < la * 0.5), "content_loss"),
            F.when((ba > 3) & (bb == 0), "bullets_gone").when((ba > 5) & (bb < ba * 0.5), "bullet_loss"),
        )
    )
    warned = j.select(doc, "sec_idx", F.explode(plain).alias("warning"))
    if similarity:
        close = j.filter((la > 100) & (lb > 0) & (F.col("na") != F.col("nb"))).withColumn("r", score("na", "nb")).filter("r < 0.70")
        warned = warned.unionByName(close.select(doc, "sec_idx", F.lit("significant_change").alias("warning")))
    return warned.unionByName(lost_repeats(source, output, doc).select(doc, F.lit(None).cast("int").alias("sec_idx"), F.lit("repeats_lost").alias("warning")))


def lost_repeats(source: DataFrame, output: DataFrame, doc: str, least: int = 3, chars: int = 20) -> DataFrame:
    """(doc, line, n_source, n_output) of lines that the source repeats and the output has fewer of."""
    count = lambda df, name: (
        df.select(doc, F.explode(F.transform(T.lines(F.col("text")), T.strip)).alias("line")).filter(F.length("line") >= chars).groupBy(doc, "line").agg(F.count("*").alias(name))
    )
    a = count(source, "n_source").filter(F.col("n_source") >= least)
    df = a.join(count(output, "n_output"), [doc, "line"], "left").withColumn("n_output", F.coalesce("n_output", F.lit(0)))
    return df.filter(F.col("n_output") < F.col("n_source"))
