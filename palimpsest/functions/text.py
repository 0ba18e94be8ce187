"""Scalar text functions as Column expressions.

Patterns avoid lookaround where the test SQL has to mirror them. White space follows Unicode,
`(?U)\\s`, where the semantics ask for it; Java's plain `\\s` stops at ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.functions.arrays import running_sum

#: The Markdown patterns that decide results.
ATX = r"^(#{1,6})\s+(.+?)(?:\s+#+)?\s*$"
NUMBERED_1 = r"^\d+\.\s+(.+)$"
NUMBERED_2 = r"^(?:\*\s+|\s{1,2})\d+\.\s+(.+)$"
BULLET = r"^[ \t]*[-*+]\s+(.+?)[ \t]*$"
BULLET_MARK = r"^[ \t]*[-*]\s+"
NUMBER_MARK = r"^[ \t]*\d+\.\s+"
BODY_NUMBER = r"^\d+[.)]\s"
TABLE_RULE = r"^\s*\|[\s\-:|]+\|"
BOLD_EDGE = r"^\*{1,2}|\*{1,2}$"
LIST_PREFIX = r"^(?:\*\s+|-\s+|\d+\.\s+)+"
#: The Unicode white-space characters.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Compatibility decomposition; Spark has no function for it."""
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x))


def strip(text: Column) -> Column:
    """Without Unicode white space at either end. Trimming looks at the ends only, where a pattern
    would search the whole text."""
    return F.trim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def normalize_text(text: Column) -> Column:
    """For content comparison: no Markdown punctuation, single spaces, lower case. Curly quotes and
    dashes stay: decomposition doesn't fold them."""
    return F.lower(collapse(F.regexp_replace(nfkd(text), r"[*_#`\[\]()!|]", "")))


def normalize_emphasis(text: Column) -> Column:
    """For alignment: only emphasis marks go."""
    return F.lower(collapse(F.regexp_replace(nfkd(text), r"\*{1,2}|_{1,2}", "")))


def normalize_match(text: Column) -> Column:
    """For line matching: runs of two or more separators count as one space."""
    return strip(F.regexp_replace(F.lower(text), r"[\\_\-.\s]{2,}", " "))


def normalize_heading(text: Column) -> Column:
    """A heading line without bold at its ends and list prefixes before it."""
    once = strip(F.regexp_replace(strip(text), BOLD_EDGE, ""))
    bare = strip(F.regexp_replace(once, LIST_PREFIX, ""))
    return F.lower(strip(F.regexp_replace(bare, BOLD_EDGE, "")))


def clean_inline(text: Column) -> Column:
    marked = text.contains("*") | text.contains("_") | text.contains("`") | text.contains("~~")
    return strip(F.when(marked, F.regexp_replace(text, r"\*{1,2}|_{1,2}|`{1,3}|~~", "")).otherwise(text))


def is_bullet(line: Column) -> Column:
    """A bulleted line; most lines fail on their first character, without a pattern."""
    return F.substring(line, 1, 1).isin(" ", "\t", "-", "*", "+") & line.rlike(BULLET)


def is_atx(line: Column) -> Column:
    return line.startswith("#") & line.rlike(ATX)


def clean_cell(text: Column, keep_bold: bool = False) -> Column:
    """A table cell: escapes undone, emphasis gone, underscores kept; keep_bold keeps asterisks."""
    plain = F.regexp_replace(text, r"\\([_*\\`~|])", "$1")
    return strip(F.regexp_replace(plain, r"`{1,3}|~~" if keep_bold else r"\*{1,2}|`{1,3}|~~", ""))


def strip_tags(markup: Column) -> Column:
    return collapse(F.regexp_replace(markup, r"<[^>]+>", " "))


def plain_paragraphs(text: Column) -> Column:
    """Non-blank lines, stripped and joined by newlines."""
    return F.array_join(F.filter(F.transform(lines(text), strip), lambda x: x != ""), "\n")


def has_bullet(text: Column) -> Column:
    return text.rlike("(?m)" + BULLET_MARK)


def has_number(text: Column) -> Column:
    return text.rlike("(?m)" + NUMBER_MARK)


def bullets(text: Column) -> Column:
    """The texts of the bulleted lines, in order."""
    return F.transform(F.filter(lines(text), is_bullet), lambda x: F.regexp_extract(x, BULLET, 1))


def bold_segments(text: Column) -> Column:
    """Array of (text, bold). Pieces between double asterisks alternate; after an opening without
    an end the rest is plain and keeps its asterisks. Empty pieces are dropped."""
    parts = F.split(text, r"\*\*")
    size = F.size(parts)
    made = F.transform(
        parts,
        lambda x, i: F.when((i == size - 1) & (i % 2 == 1), F.struct(F.concat(F.lit("**"), x).alias("text"), F.lit(False).alias("bold")))
        .otherwise(F.struct(x.alias("text"), (i % 2 == 1).alias("bold"))),
    )
    return F.filter(made, lambda s: s["text"] != "")


def bold_split(text: Column) -> Column:
    """Pieces between and including bold spans that hold no asterisk; empty pieces dropped."""
    marked = F.regexp_replace(text, r"(\*\*[^*]+?\*\*)", "\u0001$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda x: x != "")


def bold_spans(line: Column) -> Column:
    """Texts of the bold spans of one line."""
    return F.regexp_extract_all(line, F.lit(r"\*\*(.+?)\*\*"), F.lit(1))


def bold_positions(line: Column) -> Column:
    """Array of (span, chars before, chars in all) over the line without emphasis marks; their
    quotient is where a span is expected."""
    parts = F.split(line, r"\*\*.+?\*\*", -1)
    spans = bold_spans(line)
    bare = lambda x: F.regexp_replace(x, r"\*{1,2}|_{1,2}|`{1,3}|~~", "")
    total = F.length(bare(line))
    before = lambda i: F.length(bare(F.concat(F.array_join(F.slice(parts, 1, i + 1), ""), F.array_join(F.slice(spans, 1, i), ""))))
    return F.transform(spans, lambda s, i: F.struct(s.alias("span"), before(i).alias("before"), total.alias("total")))


def phrase_count(text: Column, phrase: str) -> Column:
    """Whole-word occurrences of a phrase of letters in any case; neighbours may not be letters."""
    return F.regexp_count(text, F.lit(rf"(?i)(?<![a-zA-Z]){phrase}(?![a-zA-Z])"))


def body_line_count(text: Column) -> Column:
    """Lines that are not blank, headings, bullets, numbered items or table rows."""
    body = lambda x: ~((x == "") | x.startswith("#") | x.rlike(r"^[-*+] ") | x.rlike(BODY_NUMBER) | x.startswith("|"))
    return F.size(F.filter(F.transform(lines(text), strip), body))


def table_count(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda x: x.rlike(TABLE_RULE)))


def prefix_count(text: Column, prefix: str) -> Column:
    return F.size(F.filter(F.transform(lines(text), strip), lambda x: x.startswith(prefix)))


def all_capitals(text: Column) -> Column:
    """Four letters or more, and every one upper-case; letters without case are not."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    return (F.length(letters) >= 4) & ~letters.rlike(r"[^\p{Lu}]")


def separator_name(line: Column) -> Column:
    """Of a line in double asterisks, all capitals and of 8 to 80 characters inside them, the name
    in parentheses; else null. What stands between the outer asterisks may hold others."""
    bare = strip(line)
    name = strip(F.substr(bare, F.lit(3), F.length(bare) - 4))
    wrapped = line.contains("**") & bare.startswith("**") & bare.endswith("**") & (F.length(bare) >= 4)
    return F.when(wrapped & F.length(name).between(8, 80) & all_capitals(name), F.concat(F.lit("("), F.lower(name), F.lit(")")))


def preview(text: Column, chars: int, dots: bool = False) -> Column:
    cut = F.substring(text, 1, chars)
    return F.concat(cut, F.when(F.length(text) > chars, "...").otherwise("")) if dots else cut


def curly_quotes(text: Column) -> tuple[Column, Column]:
    """Numbers of curly single and of curly double quotation marks."""
    return F.regexp_count(text, F.lit("[\u2018\u2019]")), F.regexp_count(text, F.lit("[\u201c\u201d]"))


def double_space_lines(text: Column) -> Column:
    """Numbers (from 1) of the lines with two spaces inside their text; fenced code, table rows,
    images, rules and blank lines don't count."""
    found = lines(text)
    fence = lambda x: strip(x).startswith("```")
    fences = running_sum(F.transform(found, lambda x: fence(x).cast("int")))
    hit = F.zip_with(
        found, fences, lambda x, n: (n % 2 == 0) & ~fence(x) & ~strip(x).rlike(r"^(\||!\[|---)") & strip(x).contains("  ")
    )
    numbers = F.filter(F.transform(hit, lambda x, i: F.when(x, i + 1)), lambda i: i.isNotNull())
    return F.when(text.contains("  "), numbers).otherwise(F.array().cast("array<int>"))
