"""The registered queries of the document-revision operators and their SQL for DuckDB."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.json_text import json_answer, payload, unfenced
from palimpsest.functions.similarity import length_bound, multiset_bound, ratio_column
from palimpsest.operators import align, blocks, checks, dedup, edits, patch, planner, styles, tables
from palimpsest.operators.sections import line_table, md_blocks, md_sections, resplit
from palimpsest.plans.revise import choose_plan, revise
from palimpsest.sources import docx
from palimpsest.sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# SQL pieces that several oracles share. RE2 has no lookaround and DuckDB writes groups as \1.
LINES = "d_lines AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"
PAGE_LINES = (
    V.PAGES_MD
    + ", p_lines AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, ls[i] AS line FROM (SELECT page_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT page_id, string_split(text, chr(10)) AS ls FROM pages_md)))"
)
STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
COLLAPSE = lambda x: STRIP(rf"regexp_replace({x}, '\s+', ' ', 'g')")
INLINE = lambda x: STRIP(rf"regexp_replace({x}, '\*{{1,2}}|_{{1,2}}|`{{1,3}}|~~', '', 'g')")
NORM = lambda x: rf"lower({COLLAPSE(rf'''regexp_replace(strip_accents({x}), '[*_#`\[\]()!|]', '', 'g')''')})"
EMPH = lambda x: rf"lower({COLLAPSE(rf'''regexp_replace(strip_accents({x}), '\*{{1,2}}|_{{1,2}}', '', 'g')''')})"


def _unmarked(c):
    return F.regexp_replace(c, r"\p{Mn}", "")


# --- text functions -------------------------------------------------------------------------


@query(f"SELECT doc_id, {NORM('text')} AS norm FROM documents")
def norm_text(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", _unmarked(T.normalize_text(F.col("text"))).alias("norm"))


@query(f"SELECT doc_id, {EMPH('text')} AS norm FROM documents")
def norm_emphasis(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", _unmarked(T.normalize_emphasis(F.col("text"))).alias("norm"))


@query(rf"SELECT doc_id, {STRIP(r'''regexp_replace(lower(text), '[\\_\-.\s]{2,}', ' ', 'g')''')} AS norm FROM documents")
def norm_match(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", T.normalize_match(F.col("text")).alias("norm"))


_EDGE, _PREFIX = r"'^\*{1,2}|\*{1,2}$'", r"'^(?:\*\s+|-\s+|\d+\.\s+)+'"


_ONCE = STRIP(f"regexp_replace({STRIP('line')}, {_EDGE}, '', 'g')")
_BARE = STRIP(f"regexp_replace({_ONCE}, {_PREFIX}, '', 'g')")


@query(f"""WITH {PAGE_LINES} SELECT page_id, pos, lower({STRIP(f"regexp_replace({_BARE}, {_EDGE}, '', 'g')")}) AS norm FROM p_lines""")
def heading_norm(spark, sf):
    return line_table(V.pages_md(spark, sf), "page_id").select("page_id", "pos", T.normalize_heading(F.col("line")).alias("norm"))


@query(f"WITH {PAGE_LINES} SELECT page_id, pos, {INLINE('line')} AS clean FROM p_lines")
def clean_inline(spark, sf):
    return line_table(V.pages_md(spark, sf), "page_id").select("page_id", "pos", T.clean_inline(F.col("line")).alias("clean"))


_CELL = r"'a\_b \*x\* ' || text || ' `q` ~~z~~ \| **w**'"


@query(
    rf"""WITH c AS (SELECT doc_id, regexp_replace({_CELL}, '\\([_*\\`~|])', '\1', 'g') AS c FROM documents)
SELECT doc_id, {STRIP(r"regexp_replace(c, '\*{1,2}|`{1,3}|~~', '', 'g')")} AS plain, {STRIP(r"regexp_replace(c, '`{1,3}|~~', '', 'g')")} AS bold FROM c"""
)
def clean_cells(spark, sf):
    c = F.concat(F.lit(r"a\_b \*x\* "), F.col("text"), F.lit(r" `q` ~~z~~ \| **w**"))
    return V.read(spark, sf, "documents").select("doc_id", T.clean_cell(c).alias("plain"), T.clean_cell(c, True).alias("bold"))


@query(rf"SELECT page_id, {COLLAPSE(r'''regexp_replace(html, '<[^>]+>', ' ', 'g')''')} AS plain FROM pages")
def page_plain_text(spark, sf):
    return V.read(spark, sf, "pages").select("page_id", T.strip_tags(F.col("html")).alias("plain"))


@query(
    f"WITH {V.PAGES_MD} SELECT page_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP('x')}), lambda x: x <> ''), chr(10)) AS plain FROM pages_md"
)
def page_paragraphs(spark, sf):
    return V.pages_md(spark, sf).select("page_id", T.plain_paragraphs(F.col("text")).alias("plain"))


@query(
    rf"""WITH {V.PAGES_MD}, b AS (SELECT page_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[ \t]*[-*+]\s+(.+?)[ \t]*$')) AS ls FROM pages_md)
SELECT page_id, regexp_matches(text, '(?m)^[ \\t]*[-*]\\s+') AS has_bullet, regexp_matches(text, '(?m)^[ \t]*\d+\.\s+') AS has_number, CAST(len(ls) AS INTEGER) AS n,
array_to_string(list_transform(ls, lambda x: regexp_extract(x, '^[ \t]*[-*+]\s+(.+?)[ \t]*$', 1)), '|') AS bullets FROM b"""
)
def page_bullets(spark, sf):
    b = T.bullets(F.col("text"))
    return V.pages_md(spark, sf).select(
        "page_id", T.has_bullet(F.col("text")).alias("has_bullet"), T.has_number(F.col("text")).alias("has_number"), F.size(b).alias("n"), F.array_join(b, "|").alias("bullets")
    )


@query(
    rf"""WITH {PAGE_LINES}, s AS (SELECT page_id, pos, string_split(line, '**') AS p FROM p_lines WHERE contains(line, '**')),
u AS (SELECT page_id, pos, p, unnest(range(1, len(p) + 1)) AS i FROM s)
SELECT page_id, pos, CAST(row_number() OVER (PARTITION BY page_id, pos ORDER BY i) - 1 AS INTEGER) AS part,
CASE WHEN i = len(p) AND i % 2 = 0 THEN '**' || p[i] ELSE p[i] END AS text, i % 2 = 0 AND i < len(p) AS bold
FROM u WHERE p[i] <> '' OR (i = len(p) AND i % 2 = 0)"""
)
def bold_segments(spark, sf):
    lines = line_table(V.pages_md(spark, sf), "page_id").filter(F.col("line").contains("**"))
    return lines.select("page_id", "pos", F.posexplode(T.bold_segments(F.col("line"))).alias("part", "s")).select("page_id", "pos", "part", "s.*")


@query(
    rf"""WITH {PAGE_LINES} SELECT page_id, pos, array_to_string(regexp_extract_all(line, '\*\*(.+?)\*\*', 1), '|') AS spans,
array_to_string(list_filter(string_split(regexp_replace(line, '(\*\*[^*]+?\*\*)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), '|') AS pieces
FROM p_lines WHERE regexp_matches(line, '\*\*(.+?)\*\*')"""
)
def bold_spans(spark, sf):
    lines = line_table(V.pages_md(spark, sf), "page_id").filter(F.col("line").rlike(r"\*\*(.+?)\*\*"))
    return lines.select("page_id", "pos", F.array_join(T.bold_spans(F.col("line")), "|").alias("spans"), F.array_join(T.bold_split(F.col("line")), "|").alias("pieces"))


@query(
    rf"""WITH {PAGE_LINES}, m AS (SELECT page_id, pos, 'head ' || line || ' tail' AS line FROM p_lines WHERE regexp_matches(line, '^\*\*[^*]+\*\*$'))
SELECT page_id, pos, regexp_extract(line, '\*\*(.+?)\*\*', 1) AS span, 5 AS before, CAST(length({INLINE('line')}) AS INTEGER) AS total FROM m"""
)
def bold_positions(spark, sf):
    lines = line_table(V.pages_md(spark, sf), "page_id").filter(F.col("line").rlike(r"^\*\*[^*]+\*\*$"))
    line = F.concat(F.lit("head "), F.col("line"), F.lit(" tail"))
    return lines.select("page_id", "pos", F.explode(T.bold_positions(line)).alias("s")).select("page_id", "pos", "s.*")


@query("SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[^a-zA-Z]+'), lambda x: lower(x) = 'the')) AS INTEGER) AS n FROM documents")
def phrase_search(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", T.phrase_count(F.col("text"), "the").alias("n"))


_BODY = rf"""CAST(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP('x')}), lambda x: NOT (x = '' OR starts_with(x, '#') OR regexp_matches(x, '^[-*+] ') OR regexp_matches(x, '^\d+[.)]\s') OR starts_with(x, '|')))) AS INTEGER)"""


@query(
    rf"""WITH {V.PAGES_MD} SELECT page_id, {_BODY} AS body_lines,
CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*\|[\s\-:|]+\|'))) AS INTEGER) AS tables,
CAST(len(list_filter(string_split(text, chr(10)), lambda x: starts_with({STRIP('x')}, '* '))) AS INTEGER) AS stars FROM pages_md"""
)
def structure_counts(spark, sf):
    t = F.col("text")
    return V.pages_md(spark, sf).select("page_id", T.body_line_count(t).alias("body_lines"), T.table_count(t).alias("tables"), T.prefix_count(t, "* ").alias("stars"))


_SEP = STRIP("substr(m, 3, length(m) - 4)")


@query(
    rf"""WITH {LINES}, m AS (SELECT doc_id, pos, {STRIP("'**' || upper(replace(line, 'ß', 's')) || '**'")} AS m FROM d_lines), s AS (SELECT doc_id, pos, {_SEP} AS n FROM m),
c AS (SELECT *, regexp_replace(n, '[^\p{{L}}]', '', 'g') AS c FROM s)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, '(' || lower(n) || ')' AS name FROM c WHERE length(n) BETWEEN 8 AND 80 AND length(c) >= 4 AND NOT regexp_matches(c, '[^\p{{Lu}}]')"""
)
def separator_names(spark, sf):
    """Every line, put into capitals and bold; lines that hold asterisks count with them."""
    rows = V.read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    named = T.separator_name(F.concat(F.lit("**"), F.upper(F.translate("line", "ß", "s")), F.lit("**")))
    return rows.select("doc_id", "pos", named.alias("name")).filter("name is not null")


@query("SELECT doc_id, left(text, 200) AS p200, left(text, 60) || CASE WHEN length(text) > 60 THEN '...' ELSE '' END AS p60 FROM documents")
def previews(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", T.preview(F.col("text"), 200).alias("p200"), T.preview(F.col("text"), 60, True).alias("p60"))


_CURLY = "replace(replace(text, 'th', chr(8216) || 'th' || chr(8217)), 'de', chr(8220) || 'de')"


@query(f"SELECT doc_id, CAST(len(regexp_extract_all({_CURLY}, '[‘’]')) AS INTEGER) AS singles, CAST(len(regexp_extract_all({_CURLY}, '[“”]')) AS INTEGER) AS doubles FROM documents")
def smart_quote_counts(spark, sf):
    t = F.regexp_replace(F.regexp_replace("text", "th", "‘th’"), "de", "“de")
    a, b = T.curly_quotes(t)
    return V.read(spark, sf, "documents").select("doc_id", a.alias("singles"), b.alias("doubles"))


@query(
    rf"""WITH f AS (SELECT doc_id, string_split('```' || chr(10) || 'a  b' || chr(10) || '```' || chr(10) || replace(text, '. ', '.  '), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, {STRIP('ls[i]')} AS s FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM f)),
c AS (SELECT doc_id, i, s, sum(CAST(starts_with(s, '```') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS fences FROM l)
SELECT doc_id, CAST(i AS INTEGER) AS line_no FROM c WHERE fences % 2 = 0 AND contains(s, '  ') AND NOT regexp_matches(s, '^(\||!\[|---|```)')"""
)
def double_spaces(spark, sf):
    t = F.concat(F.lit("```\na  b\n```\n"), F.regexp_replace("text", r"\. ", ".  "))
    return V.read(spark, sf, "documents").select("doc_id", F.explode(T.double_space_lines(t)).alias("line_no"))


@query("SELECT doc_id, doc_id AS id, lang || '-' || source AS tag FROM documents")
def json_fence_parse(spark, sf):
    body = F.concat(F.lit("```json\n"), payload("doc_id", "lang", "source"), F.lit("\n```"))
    df = V.read(spark, sf, "documents").select("doc_id", F.from_json(unfenced(body), "doc_id long, lang string, source string").alias("j"))
    return df.select("doc_id", F.col("j.doc_id").alias("id"), F.concat_ws("-", "j.lang", "j.source").alias("tag"))


@query(r"""SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '\n\t' || source || '"}' AS payload FROM documents""")
def json_repair(spark, sf):
    """An answer behind a preamble with brackets, with raw line ends and tabs inside a string."""
    raw = F.concat(F.lit('Here [1] it is:\n{"doc_id":'), F.col("doc_id").cast("string"), F.lit(',"lang":"'), F.col("lang"), F.lit("\n\t"), F.col("source"), F.lit('"}\n```\n'))
    return V.read(spark, sf, "documents").select("doc_id", json_answer(raw).alias("payload"))


# --- sections and structure -----------------------------------------------------------------

_ATX = r"'^(#{1,6})\s+(.+?)(?:\s+#+)?\s*$'"


@query(
    rf"""WITH {V.CONV_MD}, l AS (SELECT conv_id, i - 1 AS pos, ls[i] AS line FROM (SELECT conv_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT conv_id, string_split(text, chr(10)) AS ls FROM conv_md)))
SELECT conv_id, CAST(pos AS INTEGER) AS pos, CASE WHEN regexp_matches(line, {_ATX}) THEN 'heading' WHEN regexp_matches(line, '^\s*$') THEN 'blank' ELSE 'text' END AS kind,
CASE WHEN regexp_matches(line, {_ATX}) THEN CAST(length(regexp_extract(line, {_ATX}, 1)) AS INTEGER) END AS level,
CASE WHEN regexp_matches(line, {_ATX}) THEN {STRIP(f'regexp_extract(line, {_ATX}, 2)')} END AS heading FROM l"""
)
def line_kinds(spark, sf):
    rows = line_table(V.conv_md(spark, sf), "conv_id")
    kind = F.when(F.col("level").isNotNull(), "heading").when(T.strip(F.col("line")) == "", "blank").otherwise("text")
    return rows.select("conv_id", "pos", kind.alias("kind"), "level", "heading")


@query(
    rf"""WITH {V.TURNS} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS sec_idx, {STRIP('heading')} AS heading, 2 AS level, {STRIP('text')} AS content FROM turns"""
)
def conv_sections(spark, sf):
    return md_sections(V.conv_md(spark, sf), "conv_id")


@query(
    rf"""WITH {PAGE_LINES}, b AS (SELECT *, regexp_matches(line, {_ATX}) AS atx, {STRIP(rf"regexp_extract({STRIP('line')}, '^\*\*([^*]+)\*\*$', 1)")} AS name FROM p_lines),
m AS (SELECT *, NOT atx AND length(name) BETWEEN 8 AND 80 AND length(regexp_replace(name, '[^\p{{L}}]', '', 'g')) >= 4 AND upper(name) = name AND NOT contains(name, 'ß') AS mark FROM b),
h AS (SELECT *, CAST(atx OR mark AS INTEGER) AS hit FROM m), g AS (SELECT *, sum(hit) OVER (PARTITION BY page_id ORDER BY pos) AS sid FROM h),
s AS (SELECT page_id, sid, max(CASE WHEN atx THEN {STRIP(f'regexp_extract(line, {_ATX}, 2)')} WHEN mark THEN '(' || lower(name) || ')' END) AS heading, max(CASE WHEN atx THEN length(regexp_extract(line, {_ATX}, 1)) END) AS level,
  {STRIP("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT atx), '')")} AS content, count(*) FILTER (NOT atx) AS n FROM g GROUP BY page_id, sid),
k AS (SELECT *, max(sid) OVER (PARTITION BY page_id) AS last FROM s)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY sid) - 1 AS INTEGER) AS sec_idx, coalesce(heading, '(preamble)') AS heading, CAST(coalesce(level, 0) AS INTEGER) AS level, content
FROM k WHERE (sid = 0 AND content <> '') OR (sid > 0 AND (n > 0 OR sid = last))"""
)
def page_sections(spark, sf):
    return md_sections(V.pages_md(spark, sf), "page_id")


_STYLES = """styles AS (SELECT n_regionkey AS doc, 'S' || n_nationkey AS style_id, CASE WHEN n_nationkey % 6 = 1 THEN n_nationkey % 11 END AS outline_lvl,
  CASE WHEN n_nationkey % 7 = 3 THEN 'S' || n_nationkey ELSE 'S' || (n_nationkey - 5) END AS based_on FROM nation)"""


@query(
    f"""WITH RECURSIVE {_STYLES}, own AS (SELECT *, CASE WHEN outline_lvl BETWEEN 0 AND 8 THEN outline_lvl + 1 END AS lvl FROM styles),
walk AS (SELECT doc, style_id, lvl, based_on, 0 AS depth FROM own UNION ALL
  SELECT w.doc, w.style_id, o.lvl, o.based_on, w.depth + 1 FROM walk w JOIN own o ON o.doc = w.doc AND o.style_id = w.based_on WHERE w.lvl IS NULL AND w.depth < 12)
SELECT doc, style_id, CAST(lvl AS INTEGER) AS level FROM walk WHERE lvl IS NOT NULL"""
)
def style_inheritance(spark, sf):
    n = F.col("n_nationkey")
    name = lambda x: F.concat(F.lit("S"), x.cast("string"))
    t = V.read(spark, sf, "nation").select(
        F.col("n_regionkey").alias("doc"),
        name(n).alias("style_id"),
        F.when(n % 6 == 1, n % 11).alias("outline_lvl"),
        F.when(n % 7 == 3, name(n)).otherwise(name(n - 5)).alias("based_on"),
    )
    return styles.style_levels(t, "doc")


_BULLET_NAME, _NUMBER_NAME = r"'(?i)^(list[-\s]?bullet|bullets?$)'", r"'(?i)^list[-\s]?number'"


@query(
    rf"""WITH s AS (SELECT n_regionkey AS doc, n_nationkey AS pos, CASE n_nationkey % 4 WHEN 0 THEN 'ListBullet' WHEN 1 THEN 'List Number' WHEN 2 THEN 'MyBulletList' ELSE 'B' END || CASE WHEN n_nationkey > 9 THEN '' ELSE '' || n_nationkey END AS id,
  CASE WHEN n_nationkey % 8 = 3 THEN 'Bullets' WHEN n_nationkey % 8 = 7 THEN 'list-number x' ELSE 'Normal List Bullet' END AS name FROM nation),
k AS (SELECT *, regexp_matches(id, {_BULLET_NAME}) OR regexp_matches(name, {_BULLET_NAME}) AS b, regexp_matches(id, {_NUMBER_NAME}) OR regexp_matches(name, {_NUMBER_NAME}) AS n FROM s),
b AS (SELECT doc, id, row_number() OVER (PARTITION BY doc ORDER BY length(id), pos) AS r FROM k WHERE b), m AS (SELECT doc, id, row_number() OVER (PARTITION BY doc ORDER BY length(id), pos) AS r FROM k WHERE n AND NOT b)
SELECT d.doc, b.id AS bullet, m.id AS numbered FROM (SELECT DISTINCT doc FROM s) d LEFT JOIN b ON b.doc = d.doc AND b.r = 1 LEFT JOIN m ON m.doc = d.doc AND m.r = 1"""
)
def list_styles(spark, sf):
    n = F.col("n_nationkey")
    kind = F.element_at(F.array(F.lit("ListBullet"), F.lit("List Number"), F.lit("MyBulletList"), F.lit("B")), (n % 4 + 1).cast("int"))
    name = F.when(n % 8 == 3, "Bullets").when(n % 8 == 7, "list-number x").otherwise("Normal List Bullet")
    t = V.read(spark, sf, "nation").select(
        F.col("n_regionkey").alias("doc"), n.alias("pos"), F.concat(kind, F.when(n > 9, "").otherwise(n.cast("string"))).alias("style_id"), name.alias("name")
    )
    return styles.list_styles(t, "doc")


def _styled_sections(spark, sf):
    t = V.turns(spark, sf)
    return t.select("conv_id", F.col("turn").alias("sec_idx"), F.col("turn").alias("pos"), (F.col("turn") % 3).cast("int").alias("level"), F.concat(F.lit("St"), ((F.col("conv_id") + F.col("turn")) % 2).cast("string")).alias("style_id"))


_USE = """s AS (SELECT conv_id, turn % 3 AS level, 'St' || ((conv_id + turn) % 2) AS style_id, turn FROM conversations),
c AS (SELECT conv_id, level, style_id, count(*) AS n, min(turn) AS seen FROM s WHERE level > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, level ORDER BY n DESC, seen) AS k FROM c),
u AS (SELECT conv_id, CAST(level AS INTEGER) AS level, style_id, n FROM r WHERE k = 1)"""


@query(f"WITH {_USE} SELECT * FROM u")
def styles_in_use(spark, sf):
    return styles.styles_in_use(_styled_sections(spark, sf), "conv_id")


@query(
    f"""WITH {_USE}, d AS (SELECT DISTINCT conv_id, unnest([1, 2, 3]) AS level FROM conversations)
SELECT d.conv_id, d.level, coalesce(u.style_id, 'Heading' || d.level) AS style_id, u.style_id IS NOT NULL AS in_use FROM d LEFT JOIN u ON u.conv_id = d.conv_id AND u.level = d.level"""
)
def merged_styles(spark, sf):
    used = styles.styles_in_use(_styled_sections(spark, sf), "conv_id")
    declared = V.turns(spark, sf).select("conv_id").distinct().select("conv_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("level"))
    return styles.merged_styles(used, declared.withColumn("style_id", F.concat(F.lit("Heading"), F.col("level").cast("string"))), "conv_id")


_CB = rf"""cb AS (SELECT conv_id, CAST(turn AS INTEGER) * 2 AS pos, 'heading' AS kind, heading AS text, turn FROM turns UNION ALL SELECT conv_id, CAST(turn AS INTEGER) * 2 + 1, 'para', text, turn FROM turns)"""


def _conv_blocks(spark, sf):
    """A heading and a paragraph block for each turn."""
    t = V.turns(spark, sf)
    p = F.col("turn").cast("int") * 2
    return t.select("conv_id", p.alias("pos"), F.lit("heading").alias("kind"), F.col("heading").alias("text"), "turn").unionByName(
        t.select("conv_id", (p + 1).alias("pos"), F.lit("para").alias("kind"), "text", "turn")
    )


@query(
    f"""WITH {V.TURNS}, {_CB}, h AS (SELECT conv_id, text AS heading, pos AS start, lead(pos) OVER (PARTITION BY conv_id ORDER BY pos) AS nx FROM cb WHERE kind = 'heading'),
m AS (SELECT conv_id, max(pos) + 1 AS e FROM cb GROUP BY 1) SELECT h.conv_id, heading, start, CAST(coalesce(nx, e) AS INTEGER) AS "end" FROM h JOIN m USING (conv_id)"""
)
def section_range(spark, sf):
    return edits.section_ranges(_conv_blocks(spark, sf), "conv_id")


@query(
    f"""WITH {V.TURNS}, {_CB}, m AS (SELECT conv_id, max(pos) + 1 AS e FROM cb GROUP BY 1),
r AS (SELECT conv_id, pos AS anchor, -1 AS edit, text, kind, turn FROM cb WHERE turn % 4 NOT IN (1, 2)
  UNION ALL SELECT conv_id, CAST(turn AS INTEGER) * 2, CAST(turn AS INTEGER), 'replaced ' || turn, 'para', turn FROM turns WHERE turn % 4 = 1
  UNION ALL SELECT conv_id, CAST(turn AS INTEGER) * 2 + 1, CAST(turn AS INTEGER), 'inserted ' || turn, 'para', turn FROM turns WHERE turn % 4 = 3)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY anchor, edit) - 1 AS INTEGER) AS pos, kind, text, CASE WHEN edit >= 0 THEN edit END AS edit FROM r"""
)
def apply_edits(spark, sf):
    turn = F.col("turn").cast("int")
    kind = F.when(turn % 4 == 1, "replace").when(turn % 4 == 2, "delete").when(turn % 4 == 3, "insert")
    word = F.when(turn % 4 == 1, "replaced ").otherwise("inserted ")
    e = V.turns(spark, sf).select("conv_id", turn.alias("ord"), kind.alias("kind"), F.col("heading").alias("target"), F.array(F.concat(word, turn.cast("string"))).alias("texts")).filter("kind is not null")
    return edits.apply_edits(_conv_blocks(spark, sf), e, "conv_id")[0]


@query(
    f"""WITH {V.TURNS}, {_CB} SELECT conv_id, pos, kind, CASE WHEN kind = 'heading' AND turn % 3 = 0 THEN 'new ' || text ELSE text END AS text, turn FROM cb"""
)
def heading_rename(spark, sf):
    r = V.turns(spark, sf).filter("turn % 3 = 0").select("conv_id", "heading", F.concat(F.lit("new "), F.col("heading")).alias("new_heading"))
    return edits.rename_headings(_conv_blocks(spark, sf), r, "conv_id").select("conv_id", "pos", "kind", "text", "turn")


@query(
    """SELECT doc_id, b AS block_idx, r AS row_idx, cells FROM (
SELECT doc_id, 0 AS b, 0 AS r, 'id,opening,origin' AS cells FROM documents UNION ALL
SELECT doc_id, 0, 1, doc_id || ',a_b,,' || lang FROM documents UNION ALL
SELECT doc_id, 1, 0, source || ',z' FROM documents)"""
)
def table_blocks(spark, sf):
    d = V.read(spark, sf, "documents")
    text = F.concat(
        F.lit("intro\n| id | opening | origin |\n|---|:-:|--|\n| "), F.col("doc_id").cast("string"), F.lit(" | a\\_b || **"), F.col("lang"), F.lit("** |\n\n# x | y\n"), F.col("source"), F.lit(" | z\n||")
    )
    rows = tables.table_rows(d.select("doc_id", text.alias("text")), "doc_id")
    return rows.select("doc_id", "block_idx", "row_idx", F.array_join("cells", ",").alias("cells"))


@query(
    rf"""WITH {PAGE_LINES} SELECT page_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (regexp_matches(line, '^\s*$')) AS BIGINT) AS n_blank,
count(*) FILTER (contains(line, '|')) > 0 AS has_tables, left(coalesce(string_agg({STRIP('line')}, ' ' ORDER BY pos) FILTER (NOT regexp_matches(line, '^\s*$')), ''), 150) AS preview FROM p_lines GROUP BY page_id"""
)
def structural_summary(spark, sf):
    rows = line_table(V.pages_md(spark, sf), "page_id").withColumn("s", T.strip(F.col("line")))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("s") != "", F.struct("pos", "s")))), lambda x: x["s"])
    return rows.groupBy("page_id").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("s") == "").alias("n_blank"), F.bool_or(F.col("line").contains("|")).alias("has_tables"), F.substring(F.array_join(ordered, " "), 1, 150).alias("preview")
    )


@query(
    f"""WITH {V.TURNS}, {_CB}, k AS (SELECT *, CASE WHEN kind = 'para' AND turn % 5 = 4 THEN 'separator' WHEN kind = 'heading' AND turn = 0 THEN 'para' ELSE kind END AS k2 FROM cb),
p AS (SELECT *, sum(CAST(k2 <> 'para' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY pos) AS part FROM k)
SELECT conv_id, CAST(part AS BIGINT) AS sec_idx, coalesce(max(CASE k2 WHEN 'heading' THEN text WHEN 'separator' THEN '(' || lower({STRIP('text')}) || ')' END), '(preamble)') AS heading,
coalesce(max(CASE k2 WHEN 'heading' THEN 2 WHEN 'separator' THEN 0 END), 0) AS level, count(*) AS n FROM p GROUP BY conv_id, part"""
)
def block_sections(spark, sf):
    kind = F.when((F.col("kind") == "para") & (F.col("turn") % 5 == 4), "separator").when((F.col("kind") == "heading") & (F.col("turn") == 0), "para").otherwise(F.col("kind"))
    b = _conv_blocks(spark, sf).withColumns({"level": F.lit(2), "kind": kind})
    out = blocks.chunk_blocks(b, "conv_id").groupBy("conv_id", "sec_idx", "sec_heading", "sec_level").agg(F.count("*").alias("n"))
    return out.withColumnsRenamed({"sec_heading": "heading", "sec_level": "level"})


@query(f"""WITH {V.TURNS}, {_CB} SELECT conv_id, turn, {STRIP("string_agg(replace(text, chr(10), ' '), ' ' ORDER BY pos)")} AS text FROM cb GROUP BY conv_id, turn""")
def section_text(spark, sf):
    b = _conv_blocks(spark, sf).withColumn("runs", F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"), F.lit(False).alias("bold"))))
    return blocks.section_text(b, ["conv_id", "turn"])


@query(f"""WITH {V.TURNS}, {_CB} SELECT conv_id, pos FROM cb WHERE kind = 'heading' AND turn % 2 = 0 AND turn % 3 <> 0""")
def drawing_rescue(spark, sf):
    b = _conv_blocks(spark, sf).filter("kind = 'heading'")
    old, new = b.withColumn("has_drawing", F.col("turn") % 2 == 0), b.withColumn("has_drawing", F.col("turn") % 3 == 0)
    return blocks.rescued_drawings(old, new, ["conv_id", "turn"]).select("conv_id", "pos")


@query(f"""WITH {V.TURNS}, {_CB} SELECT conv_id, pos FROM cb WHERE NOT (kind = 'heading' AND turn % 3 = 0)""")
def empty_headings(spark, sf):
    b = _conv_blocks(spark, sf).withColumn("text", F.when((F.col("kind") == "heading") & (F.col("turn") % 3 == 0), " \t").otherwise(F.col("text")))
    return blocks.without_empty_headings(b).select("conv_id", "pos")


@query("SELECT doc_id, doc_id || '/false|' || lang || '/true, ' || source || '/false|plain/false' AS runs FROM documents")
def cell_runs(spark, sf):
    d = V.read(spark, sf, "documents")
    old = F.array(F.lit("x"), F.lit("y"), F.lit("plain"))
    new = F.array(F.concat(F.lit("**"), F.col("doc_id").cast("string"), F.lit("**")), F.concat(F.lit("**"), F.col("lang"), F.lit("** "), F.col("source")))
    runs = F.transform(blocks.set_cells(old, new), lambda c: F.array_join(F.transform(c, lambda r: F.concat(r["text"], F.lit("/"), r["bold"].cast("string"))), ","))
    return d.select("doc_id", F.array_join(runs, "|").alias("runs"))


# --- alignment --------------------------------------------------------------------------------

_DIFF = rf"""{V.TURNS}, rows AS (
  SELECT conv_id, turn * 2 AS o, 'inserted ' || (conv_id * 100 + turn) AS source_heading, NULL AS base_heading, 'new' AS action, false AS heading_renamed FROM turns WHERE k = 4
  UNION ALL SELECT conv_id, turn * 2 + 1, {STRIP("heading || CASE WHEN k = 3 THEN ' revised' ELSE '' END")}, {STRIP('heading')},
    CASE WHEN k = 1 AND len(w) >= 6 THEN 'minor_edit' WHEN k = 2 THEN 'major_change' ELSE 'identical' END, k = 3 FROM turns),
diff AS (SELECT conv_id AS pair_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1 AS INTEGER) AS source_idx, source_heading, base_heading, action, heading_renamed FROM rows)"""


def _diff(spark, sf):
    return align.section_diff(V.conv_md(spark, sf), V.conv_md_revised(spark, sf), "conv_id")


@query(f"WITH {_DIFF} SELECT * FROM diff")
def section_diff(spark, sf):
    return _diff(spark, sf).select("pair_id", "source_idx", "source_heading", "base_heading", "action", "heading_renamed")


@query(
    f"""WITH {_DIFF}, c AS (SELECT pair_id, count(*) AS n, count(*) FILTER (action = 'identical') AS identical, count(*) FILTER (action = 'minor_edit') AS minor_edit, count(*) FILTER (action = 'major_change') AS major_change,
count(*) FILTER (action = 'new') AS new, count(*) FILTER (heading_renamed) AS renamed, count(*) FILTER (action IN ('identical', 'minor_edit')) AS similar_n FROM diff GROUP BY pair_id)
SELECT * EXCLUDE (similar_n), similar_n AS "similar", similar_n / n >= 0.5 AS reliable, similar_n / n < 0.25 AND new > identical + minor_edit AND n >= 3 AS diverged FROM c"""
)
def action_counts(spark, sf):
    return align.diff_summary(_diff(spark, sf))


@query(
    f"""WITH {_DIFF} SELECT pair_id, source_idx, source_heading AS md_heading, CASE action WHEN 'new' THEN 'insert' WHEN 'major_change' THEN 'replace' ELSE 'unchanged' END AS action,
CASE action WHEN 'new' THEN 'insert' ELSE 'unchanged' END AS settled FROM diff"""
)
def section_mapping(spark, sf):
    d = _diff(spark, sf)
    action = align.mapping_action(F.col("action"), F.col("base_idx").isNotNull())
    return d.select("pair_id", "source_idx", F.col("source_heading").alias("md_heading"), action.alias("action"), align.settled_action(action, F.col("source_heading")).alias("settled"))


@query(
    f"""WITH {_DIFF}, a AS (SELECT *, coalesce(last_value(base_heading IGNORE NULLS) OVER (PARTITION BY pair_id ORDER BY source_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '(end)') AS anchor FROM diff)
SELECT pair_id, source_idx, source_heading, anchor FROM a WHERE base_heading IS NULL"""
)
def insert_anchor_asof(spark, sf):
    return align.insert_anchors(_diff(spark, sf)).select("pair_id", "source_idx", "source_heading", "anchor")


@query(
    f"""WITH {_DIFF}, a AS (SELECT *, last_value(base_heading IGNORE NULLS) OVER (PARTITION BY pair_id ORDER BY source_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e,
first_value(base_heading IGNORE NULLS) OVER (PARTITION BY pair_id ORDER BY source_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS l FROM diff)
SELECT pair_id, source_idx, coalesce(e, l) AS anchor, CASE WHEN e IS NOT NULL THEN 'after' WHEN l IS NOT NULL THEN 'before' ELSE 'start' END AS side FROM a WHERE base_heading IS NULL"""
)
def neighbour_anchor(spark, sf):
    return align.neighbour_anchors(_diff(spark, sf), "pair_id", "source_idx", "base_heading").select("pair_id", "source_idx", "anchor", "side")


_WANT = f"""want AS (SELECT conv_id, CAST(turn AS INTEGER) AS idx, CASE k WHEN 0 THEN heading WHEN 1 THEN 'T' || substr(heading, 2) WHEN 2 THEN '* 1. ' || heading WHEN 3 THEN heading || ' revised' ELSE '**' || heading || '**' END AS heading, k,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, heading AS plain FROM turns)"""


def _wanted(spark, sf):
    h, k = F.col("heading"), F.col("k")
    name = F.when(k == 0, h).when(k == 1, F.concat(F.lit("T"), F.expr("substr(heading, 2)"))).when(k == 2, F.concat(F.lit("* 1. "), h)).when(k == 3, F.concat(h, F.lit(" revised"))).otherwise(F.concat(F.lit("**"), h, F.lit("**")))
    return V.turns(spark, sf).select("conv_id", F.col("turn").cast("int").alias("idx"), name.alias("heading"))


@query(
    f"""WITH {V.TURNS}, {_WANT} SELECT conv_id, idx, heading, CASE WHEN k <> 3 THEN CAST(place AS INTEGER) END AS sec_idx,
CASE k WHEN 0 THEN 'exact' WHEN 1 THEN 'lower' WHEN 3 THEN NULL ELSE 'normalized' END AS tier FROM want"""
)
def heading_join(spark, sf):
    return align.heading_lookup(_wanted(spark, sf), md_sections(V.conv_md(spark, sf), "conv_id"), "conv_id")


@query(f"WITH {V.TURNS}, {_WANT} SELECT conv_id, idx, heading FROM want WHERE k = 3")
def unmatched_headings(spark, sf):
    found = align.heading_lookup(_wanted(spark, sf), md_sections(V.conv_md(spark, sf), "conv_id"), "conv_id").filter("sec_idx is not null")
    return _wanted(spark, sf).join(found, ["conv_id", "idx"], "left_anti").select("conv_id", "idx", "heading")


@query(f"WITH {V.TURNS}, {_WANT} SELECT conv_id AS pair_id, idx AS source_idx, CASE WHEN k <> 3 THEN CAST(place AS INTEGER) END AS base_idx, CASE WHEN k = 3 THEN 'insert' ELSE 'replace' END AS action FROM want")
def section_claims(spark, sf):
    source = _wanted(spark, sf).select(F.col("conv_id").alias("pair_id"), F.col("idx").alias("sec_idx"), "heading")
    return align.claim_sections(source, md_sections(V.conv_md(spark, sf), "conv_id").withColumnRenamed("conv_id", "pair_id"))


@query(
    """WITH i AS (SELECT conv_id, turn, length(text) AS n, sum(CAST(length(text) > 300 AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations),
p AS (SELECT *, CASE WHEN n > 300 THEN -1 ELSE CAST(floor((row_number() OVER (PARTITION BY conv_id, island, n > 300 ORDER BY turn) - 1) / 5) AS INTEGER) END AS part FROM i),
f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, island, part) AS first FROM p)
SELECT conv_id, turn, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY first) AS INTEGER) AS batch, n > 300 AS large, CASE WHEN n > 300 THEN 32768 ELSE 16384 END AS max_tokens FROM f"""
)
def batch_assignment(spark, sf):
    items = V.read(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    return align.batches(items, "conv_id", "turn", "chars", large=300).select("conv_id", "turn", "batch", "large", "max_tokens")


_NEAR = f"{LINES}, o AS (SELECT doc_id, pos, lower(line) AS t FROM d_lines)"


def _neighbours(spark, sf):
    """Every line of every document with the line after it, both whole: (doc_id, pos, ta, tb). A
    document's pairs are made inside its row, so their number is that of its lines."""
    ls = F.split(F.lower("text"), "\n")
    pair = lambda a, i: F.struct(i.alias("pos"), a.alias("ta"), F.get(ls, i + 1).alias("tb"))
    return V.read(spark, sf, "documents").select("doc_id", F.explode(F.transform(ls, pair)).alias("x")).select("doc_id", "x.*").filter("tb is not null")


@query(
    f"""WITH {_NEAR} SELECT x.doc_id, CAST(x.pos AS INTEGER) AS pos FROM o x JOIN o y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1
WHERE 2 * least(length(x.t), length(y.t)) / greatest(length(x.t) + length(y.t), 1) >= 0.95"""
)
def length_bound_neighbours(spark, sf):
    return _neighbours(spark, sf).filter(length_bound(F.col("ta"), F.col("tb")) >= 0.95).select("doc_id", "pos")


@query(
    f"""WITH {_NEAR}, c AS (SELECT doc_id, pos, ch, count(*) AS n FROM (SELECT doc_id, pos, unnest(string_split(t, '')) AS ch FROM o) WHERE ch <> '' GROUP BY ALL),
s AS (SELECT x.doc_id, x.pos, sum(least(x.n, y.n)) AS shared FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 AND x.ch = y.ch GROUP BY ALL)
SELECT s.doc_id, CAST(s.pos AS INTEGER) AS pos, CAST(round(2 * shared / (length(p.t) + length(q.t)) * 1000) AS BIGINT) AS bound FROM s
JOIN o p ON p.doc_id = s.doc_id AND p.pos = s.pos JOIN o q ON q.doc_id = s.doc_id AND q.pos = s.pos + 1 WHERE 2 * shared / (length(p.t) + length(q.t)) >= 0.8"""
)
def multiset_bound_neighbours(spark, sf):
    near = _neighbours(spark, sf).filter(length_bound(F.col("ta"), F.col("tb")) >= 0.8)
    near = near.withColumn("x", multiset_bound(F.col("ta"), F.col("tb"))).filter("x >= 0.8")
    return near.select("doc_id", "pos", F.round(F.col("x") * 1000).cast("bigint").alias("bound"))


@query()
def similar_neighbours(spark, sf):
    """Lines with a ratio of 0.9 or more to the line after them, behind both bounds."""
    a, b = F.col("ta"), F.col("tb")
    near = _neighbours(spark, sf).filter(length_bound(a, b) >= 0.9).filter(multiset_bound(a, b) >= 0.9)
    return near.withColumn("r", ratio_column("ta", "tb")).filter("r >= 0.9").select("doc_id", "pos", F.round("r", 6).alias("similarity"))


# --- row-level reconciliation -----------------------------------------------------------------

_REV = f"""{V.ROW_PAIRS}, rev AS (SELECT table_id, nth, 0 AS extra FROM rows_base WHERE nth % 7 <> 0 UNION ALL SELECT table_id, nth, 1 FROM rows_base WHERE nth % 7 = 2),
n AS (SELECT table_id, nth, extra, row_number() OVER (PARTITION BY table_id ORDER BY nth, extra) AS r FROM rev)"""


def _with_header(rows: DataFrame, order: list[str], tables: DataFrame) -> DataFrame:
    """The rows numbered behind a header, which every one of the tables has."""
    w = Window.partitionBy("table_id").orderBy(*order)
    body = rows.withColumn("row_idx", F.row_number().over(w)).select("table_id", "row_idx", "cells")
    head = tables.select("table_id", F.lit(0).alias("row_idx"), F.array(F.lit("id"), F.lit("line"), F.lit("origin")).alias("cells"))
    return head.unionByName(body)


def _row_patch(spark, sf):
    base, docs = V.base_rows(spark, sf), V.row_tables(spark, sf)
    return tables.row_patch(_with_header(base, ["nth"], docs), _with_header(V.revised_rows(base), ["nth", "extra"], docs))


@query(
    f"""WITH {_REV} SELECT table_id, 'keep' AS action, 0 AS base_row, 0 AS new_row FROM (SELECT DISTINCT table_id FROM rows_base)
UNION ALL SELECT b.table_id, CASE WHEN b.nth % 7 = 1 THEN 'update' ELSE 'keep' END, CAST(b.nth + 1 AS INTEGER), CAST(n.r AS INTEGER) FROM rows_base b JOIN n ON n.table_id = b.table_id AND n.nth = b.nth AND extra = 0
UNION ALL SELECT table_id, 'insert', NULL, CAST(r AS INTEGER) FROM n WHERE extra = 1
UNION ALL SELECT table_id, 'remove', CAST(nth + 1 AS INTEGER), NULL FROM rows_base WHERE nth % 7 = 0"""
)
def row_patch(spark, sf):
    return _row_patch(spark, sf).select("table_id", "action", "base_row", "new_row")


@query(
    f"""WITH {V.ROW_PAIRS} SELECT table_id, 'insert' AS action, CAST(NULL AS INTEGER) AS base_row, CAST(nth + 1 AS INTEGER) AS new_row FROM rows_base WHERE nth % 7 = 0
UNION ALL SELECT table_id, 'remove', CAST(nth + 1 AS INTEGER), NULL FROM rows_base WHERE nth % 7 = 0"""
)
def row_key_stale(spark, sf):
    """Rows rewritten beyond recognition under the same key: the new one comes, the old one goes."""
    base, docs = V.base_rows(spark, sf), V.row_tables(spark, sf)
    other = F.array(F.get("cells", F.lit(0)), F.lit("0123456789" * 8), F.lit("QQQQ"))
    new = base.withColumn("cells", F.when(F.col("nth") % 7 == 0, other).otherwise(F.col("cells")))
    p = tables.row_patch(_with_header(base, ["nth"], docs), _with_header(new, ["nth"], docs))
    return p.filter("action in ('insert', 'remove')").select("table_id", "action", "base_row", "new_row")


@query(f"WITH {V.ROW_PAIRS} SELECT table_id, nth, 2 AS col, cells[3] AS old, cells[3] || '1' AS new FROM rows_base WHERE nth % 7 = 1")
def changed_cells(spark, sf):
    base = V.base_rows(spark, sf)
    new = V.revised_rows(base).filter("extra = 0").select("table_id", "nth", F.col("cells").alias("new_cells"))
    both = base.join(new, ["table_id", "nth"])
    return both.select("table_id", "nth", F.explode(tables.changed_cells(F.col("cells"), F.col("new_cells"))).alias("c")).select("table_id", "nth", "c.*")


@query(
    """SELECT table_id, CAST(count(*) AS BIGINT) AS n_old, CAST(count(*) FILTER (doc_id % 7 <> 0) AS BIGINT) AS n_new, CASE WHEN count(*) FILTER (doc_id % 7 <> 0) = 0 THEN 'restore_old'
WHEN count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 3 <> 0) = 0 THEN 'restore_old' ELSE 'keep_new' END AS verdict FROM (SELECT doc_id, doc_id // 10 AS table_id FROM documents) GROUP BY table_id"""
)
def table_rescue(spark, sf):
    d = V.read(spark, sf, "documents").select(F.expr("doc_id DIV 10").alias("table_id"), F.col("doc_id").alias("nth"))
    old = d.withColumn("n_rows", F.lit(10))
    new = d.filter("nth % 7 <> 0").withColumn("n_rows", F.when(F.col("nth") % 3 == 0, 4).otherwise(9))
    return edits.rescued_tables(old, new, ["table_id"])


def _patches(spark, sf, *steps):
    """Five lines for each document; those of even ids are revised: a word changed, bold added, a
    line added, bullets swapped, one of them longer, one replaced."""
    d = V.read(spark, sf, "documents").withColumn("id", F.col("doc_id").cast("string"))
    first, remark = F.format_string("The first sentence of document %s is plain", "id"), F.format_string("A second remark with the word %s follows it", "lang")
    one, two = F.format_string("* the first bullet of document %s", "id"), F.format_string("* another bullet about %s here", "source")
    base = F.concat_ws("\n", first, remark, one, two, F.lit("* qqqq zzzz xxxx"))
    revised = F.concat_ws(
        "\n",
        F.replace(first, F.lit(" is "), F.lit(" was ")),
        F.replace(remark, F.lit("the word"), F.lit("the **word**")),
        F.format_string("An added closing line %s", "id"),
        two,
        F.concat(one, F.lit(" extended")),
        F.lit("* 0000 1111 2222"),
    )
    old = d.select("doc_id", base.alias("text"))
    new = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, revised).otherwise(base).alias("text"))
    out = patch.patch_sections(patch.section_pairs(old, new, "doc_id"), steps)
    return out.select("pair_id", "action", "pos", "anchor", "side", "text")


def _patch_sql(*rows: str, odd: str = "") -> str:
    """Rows (action, pos, anchor, side, text) of even documents, and those of odd ones."""
    parts = [f"SELECT doc_id AS pair_id, {r} FROM documents WHERE doc_id % 2 = 0" for r in rows]
    return " UNION ALL ".join(parts + ([odd] if odd else []))


def _row(action: str, pos: str, anchor: str, side: str, text: str) -> str:
    return f"'{action}' AS action, CAST({pos} AS INTEGER) AS pos, CAST({anchor} AS INTEGER) AS anchor, CAST({side} AS VARCHAR) AS side, {text} AS text"


_ONE, _TWO = "'the first bullet of document ' || doc_id", "'another bullet about ' || source || ' here'"
_KEPT = " UNION ALL ".join(
    f"SELECT doc_id, 'keep', {i}, NULL, NULL, {t} FROM documents WHERE doc_id % 2 = 1" for i, t in ((2, _ONE), (3, _TWO), (4, "'qqqq zzzz xxxx'"))
)


@query(
    _patch_sql(
        _row("keep", "3", "NULL", "NULL", _TWO),
        _row("update", "2", "NULL", "NULL", f"{_ONE} || ' extended'"),
        _row("insert", "NULL", "2", "'after'", "'0000 1111 2222'"),
        odd=_KEPT,
    )
)
def bullet_bands(spark, sf):
    return _patches(spark, sf, "bullet")


@query(_patch_sql(_row("remove", "4", "NULL", "NULL", "'qqqq zzzz xxxx'")))
def stale_bullets(spark, sf):
    return _patches(spark, sf, "stale")


@query(_patch_sql(_row("move", "2", "3", "'to'", _ONE), _row("move", "3", "2", "'to'", _TWO)))
def bullet_order(spark, sf):
    return _patches(spark, sf, "order")


@query(
    _patch_sql(
        _row("update", "0", "NULL", "NULL", "'The first sentence of document ' || doc_id || ' was plain'"),
        _row("update", "2", "NULL", "NULL", f"{_ONE} || ' extended'"),
    )
)
def text_corrections(spark, sf):
    return _patches(spark, sf, "table_free_text")


@query(_patch_sql(_row("insert", "NULL", "1", "'after'", "'An added closing line ' || doc_id")))
def orphan_lines(spark, sf):
    return _patches(spark, sf, "orphan")


@query(_patch_sql(_row("update", "1", "NULL", "NULL", "'25:29'")))
def bold_emphasis(spark, sf):
    return _patches(spark, sf, "bold")


_CAPITALS = "upper(replace(heading, 'ß', 's'))"


@query(f"WITH {V.TURNS} SELECT conv_id AS pair_id, CAST(turn AS INTEGER) AS sec_idx, {_CAPITALS} AS heading, {_CAPITALS} || ' X' AS new_heading FROM turns WHERE length(heading) >= 10")
def rename_candidates(spark, sf):
    """All headings of a conversation compete for as many lines in capitals, which stand in the opposite order."""
    t = V.turns(spark, sf).withColumn("heading", F.upper(F.translate("heading", "ß", "s")))
    heads = t.select("conv_id", F.col("turn").cast("int").alias("sec_idx"), "heading")
    named = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("turn", "heading")))), lambda x: F.concat(x["heading"], F.lit(" X")))
    source = t.groupBy("conv_id").agg(F.concat(F.lit("# title\nplain text\n"), F.array_join(named, "\n"), F.lit("\nQQQQ ZZZZ")).alias("text"))
    return patch.rename_candidates(heads, source, "conv_id").select("pair_id", "sec_idx", "heading", "new_heading")


@query()
def unchanged_sections(spark, sf):
    """Every turn against its text in bold, lightly edited (k = 1) or cut to a third (k = 2)."""
    w = F.split("text", " ")
    k = F.col("k")
    edited = F.when(k == 1, F.array_join(F.filter(w, lambda x, i: i % 12 != 5), " ")).when(k == 2, F.array_join(F.filter(w, lambda x, i: i % 3 == 0), " "))
    md = F.coalesce(edited, F.concat(F.lit("**"), F.col("text"), F.lit("**")))
    pairs = V.turns(spark, sf).select("conv_id", "turn", md.alias("md"), F.col("text").alias("base_text"), F.lit(0).alias("md_bullets"), F.lit(0).alias("base_bullets"), F.lit(False).alias("has_table"))
    return patch.text_match(pairs).select("conv_id", "turn", "unchanged")


@query(
    f'''WITH {V.TURNS} SELECT conv_id, CAST(turn AS INTEGER) AS sec_idx, CAST(p AS BIGINT) AS part, CASE p WHEN 1 THEN 'Annex ' || turn || ' of the agreement' WHEN 2 THEN 'Closing Notes' END AS heading,
CASE p WHEN 0 THEN 'start' WHEN 1 THEN {STRIP("text")} ELSE 'end' END AS content FROM turns, (VALUES (0), (1), (2)) AS v(p)'''
)
def section_resplit(spark, sf):
    t = V.turns(spark, sf).withColumn("sec_idx", F.col("turn").cast("int"))
    number = F.col("turn").cast("string")
    content = F.concat(F.lit("start\nAnnex "), number, F.lit(" of the\n"), F.col("text"), F.lit("\n**2. CLOSING notes**\nend"))
    large = t.select("conv_id", "sec_idx", content.alias("content"), F.lit(0).alias("base_chars"))
    names = t.select("conv_id", F.concat(F.lit("Annex "), number, F.lit(" of the agreement")).alias("heading")).unionByName(t.select("conv_id", F.lit("Closing Notes").alias("heading")))
    return resplit(large, names, "conv_id", chars=1)


def _revision(spark, sf):
    """Of a revision what its blocks and its warnings read."""
    made = revise(V.conv_md(spark, sf), V.conv_md_revised(spark, sf), "conv_id")
    made.release("blocks")
    return made


@query()
def revised_blocks(spark, sf):
    return _revision(spark, sf).blocks


@query()
def revision_warnings(spark, sf):
    return _revision(spark, sf).warnings


@query(
    f'''WITH {V.TURNS}, {_CB} SELECT conv_id AS doc_id, pos, kind, CASE WHEN kind = 'heading' THEN 2 ELSE 0 END AS level, CASE WHEN kind = 'heading' THEN 'Heading2' END AS style_id, text FROM cb'''
)
def docx_round_trip(spark, sf):
    b = _conv_blocks(spark, sf).withColumns({"level": F.when(F.col("kind") == "heading", 2).otherwise(0), "cells": F.lit(None).cast("array<string>"), "table_id": F.lit(None).cast("int")})
    return docx.read_blocks(docx.render(b, "conv_id")).select("doc_id", "pos", "kind", "level", "style_id", "text")


def _with_changes(files: DataFrame) -> DataFrame:
    """Documents with as many tracked insertions, deletions and comments as their row says."""

    def run(frames):
        for pdf in frames:
            made = []
            for r in pdf.itertuples():
                word = lambda tag, inner, n: "".join(f'<w:p><w:{tag} w:id="{i}" w:author="a"><w:r><w:{inner}>x</w:{inner}></w:r></w:{tag}></w:p>' for i in range(n))
                notes = "".join(f'<w:comment w:id="{i}" w:author="a"/>' for i in range(r.n_notes))
                extra = {docx.PARTS["comments"]: f'<w:comments xmlns:w="{docx.W[1:-1]}">{notes}</w:comments>'.encode()} if r.n_notes else {}
                made.append(docx.with_body_end(bytes(r.content), word("ins", "t", r.n_ins) + word("del", "delText", r.n_del), extra))
            yield pdf[["doc_id"]].assign(content=made)

    return files.mapInPandas(run, "doc_id long, content binary")


@query(
    f"""WITH {V.TURNS} SELECT conv_id AS doc_id, CAST(count(*) FILTER (k = 1) AS INTEGER) AS insertions, CAST(count(*) FILTER (k = 2) AS INTEGER) AS deletions,
CAST(count(*) FILTER (k = 3) AS INTEGER) AS comments FROM turns GROUP BY conv_id"""
)
def docx_conflicts(spark, sf):
    """Documents with an insertion, a deletion or a comment for each turn of k = 1, 2 or 3."""
    b = _conv_blocks(spark, sf).withColumns({"level": F.lit(1), "cells": F.lit(None).cast("array<string>"), "table_id": F.lit(None).cast("int")})
    k = F.col("k")
    n = V.turns(spark, sf).groupBy(F.col("conv_id").alias("doc_id")).agg(F.count_if(k == 1).alias("n_ins"), F.count_if(k == 2).alias("n_del"), F.count_if(k == 3).alias("n_notes"))
    return docx.read_conflicts(_with_changes(docx.render(b, "conv_id").join(n, "doc_id")))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'update' ELSE 'create' END AS mode, CASE WHEN p_size % 5 = 0 THEN 'excel' WHEN p_size % 2 = 0 THEN 'edit' ELSE 'create' END AS approach FROM part")
def plan_choice(spark, sf):
    size = F.col("p_size")
    p = V.read(spark, sf, "part").select("p_partkey", (size % 2 == 0).alias("has_base"), F.when(size % 5 == 0, "a.xlsx").otherwise("a.docx").alias("output"))
    return choose_plan(p).select("p_partkey", "mode", "approach")


@query(
    f"""WITH {_DIFF} SELECT pair_id, count(*) AS n, count(*) FILTER (action = 'new') AS inserts FROM diff GROUP BY pair_id"""
)
def insert_share(spark, sf):
    d = _diff(spark, sf)
    m = d.select("pair_id", align.mapping_action(F.col("action"), F.col("base_idx").isNotNull()).alias("action"), "similarity")
    return align.secondary_divergence(m).select("pair_id", "n", "inserts")


@query("SELECT doc_id FROM documents WHERE trim(text, chr(10) || ' ') <> '' AND (CASE WHEN doc_id % 2 = 0 THEN 2 * length(text) ELSE length(text) END > 1.5 * length(text))")
def preamble_fallback(spark, sf):
    d = V.read(spark, sf, "documents")
    texts = d.select("doc_id", F.col("text").alias("base_text"), F.when(F.col("doc_id") % 2 == 0, F.concat("text", "text")).otherwise(F.col("text")).alias("text"))
    return align.preamble_only(md_sections(d, "doc_id"), texts, "doc_id").select("doc_id")


@query(f"""WITH {V.TURNS}, {_CB} SELECT conv_id, pos, CASE WHEN turn % 2 = 0 THEN pos END AS base_pos FROM cb WHERE kind = 'heading'""")
def subheading_anchor(spark, sf):
    b = _conv_blocks(spark, sf).filter("kind = 'heading'").select("conv_id", "pos", "text", "turn")
    return align.subheading_anchors(b, b.filter("turn % 2 = 0"), ["conv_id"]).select("conv_id", "pos", "base_pos")


@query(
    rf"""WITH {PAGE_LINES}, i AS (SELECT page_id, pos, {INLINE(r"regexp_extract(line, '^[ \t]*[-*+]\s+(.+?)[ \t]*$', 1)")} AS t FROM p_lines WHERE regexp_matches(line, '^[ \t]*[-*+]\s+(.+?)[ \t]*$'))
SELECT page_id, CAST(pos AS INTEGER) AS pos, t || ' and more' AS text FROM i WHERE length(t) >= 8 AND pos % 2 = 0"""
)
def bullet_styles(spark, sf):
    b = md_blocks(V.pages_md(spark, sf), "page_id").filter("kind = 'list'")
    plain = b.filter("pos % 2 = 0 and length(text) >= 8").select("page_id", "pos", F.concat("text", F.lit(" and more")).alias("text"))
    return patch.bullet_style_targets(plain, b.select("page_id", "text"), "page_id")


_EVEN, _ALL = "(SELECT count(*) FROM documents WHERE doc_id % 2 = 0)", "(SELECT count(*) FROM documents)"


@query(f"SELECT * FROM (VALUES ('insert', 2 * {_EVEN}), ('keep', 3 * {_ALL} - 2 * {_EVEN}), ('move', 2 * {_EVEN}), ('remove', {_EVEN}), ('update', 4 * {_EVEN})) AS t(action, n)")
def patch_totals(spark, sf):
    return _patches(spark, sf, *patch.STEPS).groupBy("action").agg(F.count("*").alias("n"))


# --- duplicates and order ---------------------------------------------------------------------


def _doc_blocks(spark, sf, blanks: bool = False):
    """Lines as blocks, in sections of 20, of which every other run of four is edited."""
    b = md_blocks(V.read(spark, sf, "documents"), "doc_id").withColumn("norm", F.lower(T.collapse(F.col("text"))))
    b = b if blanks else b.filter("kind <> 'blank'")
    return b.withColumns({"sec_idx": F.expr("pos DIV 20"), "edited": (F.expr("pos DIV 4") % 2) == 1})


_DB = rf"""{LINES}, dall AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, {INLINE('line')} AS text, lower({COLLAPSE(INLINE('line'))}) AS norm, pos // 20 AS sec_idx, pos // 4 % 2 = 1 AS edited,
  CASE WHEN regexp_matches(line, '^\s*$') THEN 'blank' WHEN contains(line, '|') THEN 'table_row' WHEN regexp_matches(line, '^[ \t]*[-*+]\s+(.+?)[ \t]*$') THEN 'list' ELSE 'para' END AS kind FROM d_lines),
db AS (SELECT * FROM dall WHERE kind <> 'blank')"""


@query(
    f"""WITH {_DB}, p AS (SELECT *, lag(CASE WHEN kind IN ('para', 'list') AND norm <> '' THEN norm END) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM dall)
SELECT doc_id, pos FROM p WHERE kind IN ('para', 'list') AND norm <> '' AND norm = b"""
)
def consecutive_dups(spark, sf):
    return dedup.consecutive_duplicates(_doc_blocks(spark, sf, blanks=True), "doc_id").select("doc_id", "pos")


@query(
    f"""WITH {_DB}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec_idx, norm ORDER BY pos) AS nth FROM db WHERE edited AND length(text) >= 40 AND kind IN ('para', 'list'))
SELECT doc_id, pos, CAST(nth AS INTEGER) AS nth FROM p WHERE nth > 1"""
)
def section_dedup(spark, sf):
    return dedup.repeated_in_section(_doc_blocks(spark, sf), "doc_id").select("doc_id", "pos", "nth")


@query(
    f"""WITH {_DB}, s AS (SELECT *, pos // 4 AS sec FROM db), l AS (SELECT * FROM s WHERE kind IN ('para', 'list') AND length(text) >= 40),
g AS (SELECT doc_id, pos FROM l WHERE edited AND EXISTS (SELECT 1 FROM l h WHERE h.doc_id = l.doc_id AND h.norm = l.norm AND NOT h.edited)),
n AS (SELECT s.*, g.pos IS NOT NULL AS c FROM s LEFT JOIN g ON g.doc_id = s.doc_id AND g.pos = s.pos),
b AS (SELECT *, lag(pos) OVER w AS bp, lag(kind) OVER w AS bk, lag(length(text)) OVER w AS bn, lag(sec) OVER w AS bs, coalesce(lag(c) OVER w, false) AS bc FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, 'copy' AS reason FROM b WHERE c UNION ALL SELECT doc_id, bp, 'orphan' FROM b WHERE c AND NOT bc AND bk = 'para' AND bs = sec AND bn BETWEEN 1 AND 99"""
)
def cross_section_dups(spark, sf):
    """Sections of four lines, every other one edited."""
    return dedup.across_sections(_doc_blocks(spark, sf).withColumn("sec_idx", F.expr("pos DIV 4")), "doc_id")


_HEADED = "CASE WHEN pos % 20 = 0 THEN 'heading' ELSE 'para' END"


def _headed(spark, sf):
    return _doc_blocks(spark, sf).withColumn("kind", F.when(F.col("pos") % 20 == 0, "heading").otherwise("para"))


@query(
    f"""WITH {_DB}, k AS (SELECT * REPLACE ({_HEADED} AS kind) FROM db),
h AS (SELECT *, kind = 'para' AND edited AND norm <> '' AND EXISTS (SELECT 1 FROM k h WHERE h.doc_id = k.doc_id AND h.norm = k.norm AND h.kind = 'heading' AND NOT h.edited) AS c FROM k),
b AS (SELECT *, lag(pos) OVER w AS bp, lag(kind) OVER w AS bk, lag(length(text)) OVER w AS bn, lag(sec_idx) OVER w AS bs, coalesce(lag(c) OVER w, false) AS bc FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, 'heading' AS reason FROM b WHERE c UNION ALL SELECT doc_id, bp, 'orphan' FROM b WHERE c AND NOT bc AND bk = 'para' AND bs = sec_idx AND bn BETWEEN 1 AND 99"""
)
def preserved_heading_dups(spark, sf):
    return dedup.preserved_headings(_headed(spark, sf), "doc_id")


@query(
    f"""WITH {_DB}, k AS (SELECT * REPLACE ({_HEADED} AS kind) FROM db), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec_idx ORDER BY pos) AS nth FROM k WHERE kind = 'para' AND norm <> '')
SELECT b.doc_id, b.pos FROM b JOIN k h ON h.doc_id = b.doc_id AND h.sec_idx = b.sec_idx AND h.kind = 'heading' AND h.norm = b.norm WHERE nth <= 2"""
)
def repeated_near_top(spark, sf):
    return dedup.repeated_near_top(_headed(spark, sf), "doc_id").select("doc_id", "pos")


@query(f"""WITH {_DB}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec_idx ORDER BY pos) AS nth FROM db WHERE pos % 7 = 0) SELECT doc_id, pos, CAST(nth AS INTEGER) AS nth FROM k WHERE nth > 1""")
def extra_headings(spark, sf):
    b = _doc_blocks(spark, sf).withColumn("kind", F.when(F.col("pos") % 7 == 0, "heading").otherwise("para"))
    return dedup.extra_headings(b, "doc_id").select("doc_id", "pos", "nth")


@query(
    f"""WITH {V.TURNS} SELECT conv_id, turn * 4 + i AS pos, CASE i WHEN 0 THEN heading ELSE text END AS text FROM turns, (VALUES (0), (1)) AS v(i) WHERE turn % 3 = 2"""
)
def duplicated_sections(spark, sf):
    """A heading and a body for each turn; behind an edited one the next section stands twice."""
    t = V.turns(spark, sf)
    copies = F.when(F.col("turn") % 3 == 2, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    b = t.select("conv_id", "turn", "heading", "text", F.explode(copies).alias("at"))
    part = lambda kind, name, at: b.select("conv_id", (F.col("turn") * 4 + F.col("at") + at).alias("pos"), F.lit(kind).alias("kind"), F.col(name).alias("text"), (F.col("turn") % 3 == 1).alias("edited"))
    return dedup.duplicated_sections(part("heading", "heading", 0).unionByName(part("para", "text", 1)), "conv_id").select("conv_id", "pos", "text")


@query(
    f"""WITH {V.TURNS} SELECT conv_id, turn, heading, CASE k WHEN 0 THEN 'prepended' WHEN 3 THEN 'restored' ELSE 'same' END AS how FROM turns"""
)
def kept_headings(spark, sf):
    t = V.turns(spark, sf)
    new = t.filter("k <> 0").select("conv_id", "turn", F.when(F.col("k") == 3, F.concat("heading", F.lit(" revised"))).otherwise(F.col("heading")).alias("heading"))
    return dedup.kept_heading(t, new, ["conv_id", "turn"])


@query(
    rf"""WITH {PAGE_LINES}, l AS (SELECT page_id, pos, regexp_matches(line, '^[ \t]*[-*+]\s+(.+?)[ \t]*$') AS item FROM p_lines WHERE NOT regexp_matches(line, '^\s*$')),
g AS (SELECT *, sum(CAST(NOT item AS INTEGER)) OVER (PARTITION BY page_id ORDER BY pos) AS g FROM l),
a AS (SELECT page_id, g, min(pos) AS first, max(pos) AS last, count(*) AS n FROM g WHERE item GROUP BY ALL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS INTEGER) AS "group", CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, n FROM a"""
)
def list_groups(spark, sf):
    return dedup.list_groups(md_blocks(V.pages_md(spark, sf), "page_id").filter("kind <> 'blank'"), "page_id")


@query(
    """WITH i AS (SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN (turn * 5) % 7 END AS o FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rs, row_number() OVER (PARTITION BY conv_id ORDER BY o, turn) AS ro FROM i WHERE o IS NOT NULL)
SELECT i.conv_id, i.turn, coalesce(b.turn, i.turn) AS new_slot FROM i LEFT JOIN r a ON a.conv_id = i.conv_id AND a.turn = i.turn LEFT JOIN r b ON b.conv_id = a.conv_id AND b.rs = a.ro"""
)
def bullet_reorder(spark, sf):
    items = V.read(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 != 3, (F.col("turn") * 5) % 7).alias("o"))
    return dedup.reordered(items, ["conv_id"], "turn", "o").select("conv_id", "turn", "new_slot")


@query(f"""WITH {_DB} SELECT doc_id, pos, CAST(row_number() OVER (PARTITION BY doc_id, norm ORDER BY pos) AS INTEGER) AS nth FROM db""")
def nth_occurrence(spark, sf):
    return dedup.nth_occurrence(_doc_blocks(spark, sf), ["doc_id", "norm"], "pos").select("doc_id", "pos", "nth")


@query(f"""WITH {LINES} SELECT doc_id, {STRIP('line')} AS line, count(*) AS n FROM d_lines WHERE length({STRIP('line')}) >= 20 GROUP BY ALL HAVING count(*) >= 3""")
def repeated_lines(spark, sf):
    rows = V.read(spark, sf, "documents").select("doc_id", F.explode(F.transform(T.lines(T.unix_lines(F.col("text"))), T.strip)).alias("line"))
    return dedup.repeated_lines(rows, "doc_id")


@query(
    """WITH p AS (SELECT p_partkey, 'part' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '_v' || lpad(CAST(p_partkey % 12 AS VARCHAR), 3, '0') END || '.docx' AS path, p_size, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 12 END AS v FROM part), t AS (SELECT DISTINCT p_size, v FROM p), r AS (SELECT *, v - row_number() OVER (PARTITION BY p_size ORDER BY v) AS run FROM t),
e AS (SELECT p_size, v, max(v) OVER (PARTITION BY p_size, run) + 1 AS e FROM r)
SELECT p_partkey, path, 'part' || p.p_size || '_v' || lpad(CAST(e AS VARCHAR), 3, '0') || '.docx' AS next_path FROM p JOIN e ON e.p_size = p.p_size AND e.v = p.v"""
)
def version_path(spark, sf):
    k = F.col("p_partkey")
    version = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("_v"), F.lpad((k % 12).cast("string"), 3, "0")))
    p = V.read(spark, sf, "part").select("p_partkey", F.concat(F.lit("part"), F.col("p_size").cast("string"), version, F.lit(".docx")).alias("path"))
    return edits.next_versions(p, "path").select("p_partkey", "path", "next_path")


# --- checks -----------------------------------------------------------------------------------


@query(
    f"""WITH {V.TURNS} SELECT conv_id, 2 AS level, count(*) AS n_source, count(*) FILTER (turn % 4 <> 3) AS n_output, count(*) FILTER (turn % 4 = 3) AS missing FROM turns GROUP BY conv_id"""
)
def level_histogram_diff(spark, sf):
    source = md_sections(V.conv_md(spark, sf), "conv_id")
    return checks.level_histogram(source, source.filter(F.regexp_extract("heading", r"^turn (\d+)", 1).cast("int") % 4 != 3), "conv_id")


@query("SELECT conv_id, 1 AS n_source, count(*) AS n_output FROM conversations GROUP BY conv_id HAVING count(*) > 2 AND count(*) - 1 > 5")
def over_structured(spark, sf):
    source = md_sections(V.conv_md(spark, sf), "conv_id")
    return checks.over_structured(source.filter("sec_idx = 0"), source, "conv_id").select("conv_id", F.col("n_source").cast("int").alias("n_source"), "n_output")


@query(
    f"""WITH {LINES}, a AS (SELECT doc_id, {STRIP('line')} AS line, count(*) AS n_source, count(*) FILTER (pos % 2 = 0) AS n_output FROM d_lines WHERE length({STRIP('line')}) >= 20 GROUP BY ALL)
SELECT * FROM a WHERE n_source >= 3 AND n_output < n_source"""
)
def lost_repeats(spark, sf):
    d = V.read(spark, sf, "documents").select("doc_id", "text")
    half = d.select("doc_id", F.array_join(F.filter(F.split("text", "\n"), lambda x, i: i % 2 == 0), "\n").alias("text"))
    return checks.lost_repeats(d, half, "doc_id")


@query()
def roundtrip_warnings(spark, sf):
    return checks.round_trip_warnings(V.conv_md_revised(spark, sf), V.conv_md(spark, sf), "conv_id")


_STRONG = r"regexp_replace(html, '(?is)<b>(.*?)<br>', '<p><strong>\1:</strong> tail</p>', 'g')"


def _strong(spark, sf):
    html = F.regexp_replace("html", r"(?is)<b>(.*?)<br>", "<p><strong>$1:</strong> tail</p>")
    return V.read(spark, sf, "pages").select("page_id", html.alias("html"), V.html_to_md(F.col("html")).alias("source"))


@query(
    rf"""SELECT page_id, 'F14' AS issue_id, CAST(n AS INTEGER) AS inside, 0 AS outside, 0 AS mismatches, CASE WHEN n = 0 THEN 'NOT_APPLICABLE' ELSE 'PASS' END AS status
FROM (SELECT page_id, len(list_filter(regexp_extract_all({_STRONG}, '(?is)<strong>(.*?)</strong>', 1), lambda x: length({COLLAPSE(r"regexp_replace(x, '<[^>]+>', ' ', 'g')")}) >= 5)) AS n FROM pages)"""
)
def colon_boundary(spark, sf):
    return checks.colon_boundary(_strong(spark, sf), "page_id", "F14", source="source")


_QUOTED = f"CASE WHEN page_id % 2 = 0 THEN regexp_replace({_STRONG}, '[aeiou]', '’', 'g') ELSE {_STRONG} END"


@query(
    f"""WITH {V.PAGES_MD}, q AS (SELECT page_id, regexp_matches({_QUOTED}, '[‘’“”]') AS here, page_id % 3 = 0 OR regexp_matches(m.text, '[‘’“”]') AS there FROM pages p JOIN pages_md m USING (page_id))
SELECT page_id, 'F-new4' AS issue_id, CASE WHEN here AND NOT there THEN 'FAIL' ELSE 'PASS' END AS status FROM q"""
)
def smart_quote_check(spark, sf):
    """Curly quotes planted in every second page and in the source of every third."""
    k = F.col("page_id")
    curly = F.when(k % 2 == 0, F.regexp_replace("html", "[aeiou]", "’")).otherwise(F.col("html"))
    source = F.when(k % 3 == 0, F.concat("source", F.lit(" “"))).otherwise(F.col("source"))
    return checks.smart_quotes(_strong(spark, sf).withColumns({"html": curly, "source": source}), "page_id", "F-new4", source="source")


@query(
    rf"""SELECT page_id, 'A9' AS issue_id, CASE WHEN NOT contains(lower({COLLAPSE(r"regexp_replace(h, '<[^>]+>', ' ', 'g')")}), 'tail') THEN 'NOT_APPLICABLE'
WHEN len(list_filter(regexp_extract_all(h, '(?is)<(?:b|strong)>(.*?)</(?:b|strong)>', 1), lambda x: contains(lower(x), 'tail'))) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM (SELECT page_id, {_STRONG} AS h FROM pages)"""
)
def phrase_not_bold(spark, sf):
    return checks.phrase_not_bold(_strong(spark, sf), "page_id", "A9", "tail")


@query(
    rf"""WITH d AS (SELECT doc_id, replace(text, '. ', '.  ') AS source, CASE WHEN doc_id % 2 = 0 THEN text ELSE replace(text, '. ', '.  ') END AS html FROM documents),
l AS (SELECT doc_id, i, {STRIP('ls[i]')} AS s FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(source, chr(10)) AS ls FROM d))),
c AS (SELECT doc_id, s, sum(CAST(starts_with(s, '```') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS fences FROM l),
n AS (SELECT DISTINCT doc_id FROM c WHERE fences % 2 = 0 AND contains(s, '  ') AND NOT regexp_matches(s, '^(\||!\[|---|```)'))
SELECT d.doc_id, 'A10' AS issue_id, CASE WHEN n.doc_id IS NOT NULL AND NOT regexp_matches(html, '(^|[^\s])  ([^\s]|\n?$)') AND NOT contains(html, '&nbsp;') THEN 'FAIL' ELSE 'PASS' END AS status
FROM d LEFT JOIN n ON n.doc_id = d.doc_id"""
)
def double_space_check(spark, sf):
    """Every second document is rendered without the double spaces that its source has behind full stops."""
    source = F.regexp_replace("text", r"\. ", ".  ")
    d = V.read(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(source).alias("html"), source.alias("source"))
    return checks.double_spaces(d, "doc_id", "A10")


@query(r"SELECT page_id, CAST(len(regexp_extract_all(substr(html, strpos(lower(html), '</h1>')), '(?i)<(p|li|td|table)\b')) AS BIGINT) AS n FROM pages WHERE contains(lower(html), '</h1>') AND len(regexp_extract_all(substr(html, strpos(lower(html), '</h1>')), '(?i)<(p|li|td|table)\b')) > 0")
def html_section_span(spark, sf):
    e = checks.html_elements(V.read(spark, sf, "pages"), "page_id")
    return checks.section_span(e, "page_id", "").groupBy("page_id").agg(F.count("*").alias("n"))


@query(r"SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<(h[1-6]|p|li|td|table)\b')) + 1 AS INTEGER) AS pos FROM pages WHERE page_id % 2 = 0")
def html_table_after(spark, sf):
    tail = F.when(F.col("page_id") % 2 == 0, "<p>QQQ marker</p><table><tr><td>cell</td></tr></table>").otherwise("")
    p = V.read(spark, sf, "pages").select("page_id", F.concat("html", tail).alias("html"))
    return checks.table_after(checks.html_elements(p, "page_id"), "page_id", "qqq MARKER")


_BOLDS = rf"regexp_extract_all(html, '(?is)<b>(.*?)<br>', 1)"
_PLAIN = COLLAPSE(r"regexp_replace(x, '<[^>]+>', ' ', 'g')")


@query(rf"SELECT page_id, array_to_string(list_transform({_BOLDS}, lambda x: {STRIP('x')} || ':/tail'), '|') AS items FROM pages")
def html_bold_items(spark, sf):
    return _strong(spark, sf).select("page_id", F.array_join(F.transform(checks.bold_items(F.col("html")), lambda x: F.concat_ws("/", x["bold"], x["after"])), "|").alias("items"))


@query(
    rf"""WITH b AS (SELECT page_id, list_filter(list_transform({_BOLDS}, lambda x: length({_PLAIN})), lambda n: n + 6 >= 10) AS ns FROM pages)
SELECT page_id, 'F5' AS issue_id, CASE WHEN len(ns) = 0 THEN 'NOT_APPLICABLE' WHEN len(list_filter(ns, lambda n: n + 1 >= (n + 6) * 0.9)) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM b"""
)
def bold_scope(spark, sf):
    return checks.bold_scope(_strong(spark, sf), "page_id", "F5", 0.9, False)


@query(rf"SELECT page_id, contains(lower({COLLAPSE(r"regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g')")}), 'er') AS in_h1 FROM pages")
def heading_rank(spark, sf):
    r = checks.heading_rank(V.read(spark, sf, "pages"), "page_id", "F8", "er")
    return r.select("page_id", (F.col("status") == "INCONCLUSIVE").alias("in_h1"))


@query()
def check_report(spark, sf):
    p = _strong(spark, sf)
    return checks.report(
        [
            checks.bold_scope(p, "page_id", "F5", 0.9, False),
            checks.bold_scope(p, "page_id", "F10", 0.8, True),
            checks.heading_rank(p, "page_id", "F8", "a"),
            checks.colon_boundary(p, "page_id", "F14", source="source"),
            checks.smart_quotes(p, "page_id", "F-new4", source="source"),
            checks.phrase_not_bold(p, "page_id", "A9", "tail"),
            checks.double_spaces(p, "page_id", "A10"),
        ],
        "page_id",
    )


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<li[ >]')) AS BIGINT) AS n_items, CAST(len(regexp_extract_all(html, '(?i)<h1[ >]')) AS BIGINT) AS n_headings FROM pages")
def html_structure(spark, sf):
    e = checks.html_elements(V.read(spark, sf, "pages"), "page_id")
    return e.groupBy("page_id").agg(F.count_if(F.col("tag") == "li").alias("n_items"), F.count_if(F.col("level") == 1).alias("n_headings"))


_SETS = {"A9": ["even"], "F5": ["odd"]}


@query(
    f"""WITH f AS (({ORACLES["bold_scope"]}) UNION ALL ({ORACLES["phrase_not_bold"]})),
g AS (SELECT page_id, issue_id, CASE WHEN (issue_id = 'A9' AND page_id % 3 = 0) OR (issue_id = 'F5' AND page_id % 3 = 1) THEN status ELSE 'NOT_APPLICABLE' END AS status FROM f)
SELECT page_id, {", ".join(f"coalesce(string_agg(issue_id, ', ' ORDER BY issue_id) FILTER (status = '{s}'), 'none') AS {n}" for s, n in (("FAIL", "defects"), ("PASS", "artifacts"), ("INCONCLUSIVE", "inconclusive"), ("NOT_APPLICABLE", "not_applicable")))}
FROM g GROUP BY page_id"""
)
def check_verdicts(spark, sf):
    """Two checks gated by document sets; every third page is in none."""
    p = _strong(spark, sf)
    found = checks.bold_scope(p, "page_id", "F5", 0.9, False).unionByName(checks.phrase_not_bold(p, "page_id", "A9", "tail"))
    sets = p.select("page_id", F.when(F.col("page_id") % 3 == 0, "even").when(F.col("page_id") % 3 == 1, "odd").alias("doc_set"))
    return checks.verdicts(checks.gated(found, sets, "page_id", _SETS), "page_id")


# --- maps and plans by a callback -----------------------------------------------------------


def map_equal(messages: list[dict]) -> str:
    """A callback that maps sections to base sections of equal heading; in fences, after a refusal."""
    if len(messages) == 1 and "turn 3 " in messages[0]["content"]:
        return "I would rather not."
    request = json.loads(messages[0]["content"])
    known = set(request["base_headings"])
    found = [(x["heading"], x["heading"] in known) for x in request["sections"]]
    return "```json\n" + json.dumps([{"source_heading": h, "base_heading": h if k else None, "action": "replace" if k else "insert"} for h, k in found]) + "\n```"


@query(
    f"""WITH {V.TURNS} SELECT conv_id AS pair_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS ord, turn AS source_idx, heading,
CASE WHEN k <> 4 THEN turn END AS base_idx, CASE WHEN k <> 4 THEN 'replace' ELSE 'insert' END AS action FROM turns"""
)
def callback_map(spark, sf):
    """All turns against a base that lacks each fifth."""
    t = V.turns(spark, sf).select(F.col("conv_id").alias("pair_id"), F.col("turn").alias("sec_idx"), "heading", F.col("text").alias("content"), "k")
    return planner.section_map(t.drop("k"), t.filter("k <> 4").drop("k"), map_equal)


def plan_echo(messages: list[dict]) -> str:
    """A callback that answers each section with an empty paragraph under its own action."""
    request = json.loads(messages[0]["content"])
    return json.dumps([{"kind": x["action"], "target": x["target"], "content": "<w:p/>"} for x in request["sections"]])


@query(
    f"""WITH {V.TURNS}, a AS (SELECT *, CASE WHEN k <> 4 THEN heading ELSE coalesce(last_value(CASE WHEN k <> 4 THEN heading END IGNORE NULLS) OVER
  (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '(end)') END AS target FROM turns),
n AS (SELECT *, len(regexp_extract_all(text, '(?m)^[ \\t]*[-*]\\s+')) AS bullets FROM a WHERE k <> 0)
SELECT conv_id AS pair_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS ord, CASE WHEN k = 4 THEN 'insert' ELSE 'replace' END AS kind, target,
'<w:p/>' AS content, CASE WHEN bullets > 0 THEN 'bullet loss: 0 of ' || bullets END AS warning FROM n"""
)
def callback_plan(spark, sf):
    """A plan for all turns but each fifth, which is unchanged; another fifth is new."""
    k = F.col("k")
    kept = lambda c: F.when(k != 4, F.col(c))
    t = V.turns(spark, sf).select(
        F.col("conv_id").alias("pair_id"), F.col("turn").alias("source_idx"), "heading", F.col("text").alias("content"), F.lit(2).alias("level"),
        F.when(k == 0, "unchanged").when(k == 4, "insert").otherwise("replace").alias("action"),
        kept("turn").alias("base_idx"), kept("heading").alias("base_heading"), F.lit(2).alias("base_level"),
    )
    return planner.edit_plan(t, plan_echo)


@query(
    f"""WITH {V.PAGES_MD}, b AS (SELECT p.page_id, CAST(len(regexp_extract_all(m.text, '(?m)^[ \\t]*[-*]\\s+')) AS INTEGER) AS wanted,
CASE WHEN p.page_id % 3 = 0 THEN CAST(len(regexp_extract_all(p.html, '<li')) AS INTEGER) ELSE 0 END AS made FROM pages p JOIN pages_md m USING (page_id))
SELECT page_id, wanted, made, wanted > 0 AND made < wanted * 0.5 AS lost FROM b"""
)
def bullet_loss(spark, sf):
    """List paragraphs planted for the items of every third page, none for the others."""
    html = F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit("<li"), F.lit("<p ListBullet"))).otherwise(F.col("html"))
    wanted, made, lost = planner.bullet_loss(V.html_to_md(F.col("html")), html, F.lit("replace"))
    return V.read(spark, sf, "pages").select("page_id", wanted.alias("wanted"), made.alias("made"), lost.alias("lost"))
