"""The registered queries of the training-data operators, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import table, written


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import quality_model as q
    from palimpsest.llm.labelled import remainder, training_rows

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 4) == 2
    model = q.train(training_rows(docs, labels, "quality", ~held_out, q.SAMPLE_DOCS, q.SAMPLE_CHARS))
    scored = q.score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.line_dedup import remove_wide_lines

    return remove_wide_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_wide_lines", "n_removed", "text"
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.warc import planned, read_archives, write_archives

    archives = written(write_archives(planned(table(spark, sf_dir, "pages"))), "warc")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
    return read_archives(archives, payloads=False).select(*columns)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import toxicity as x
    from palimpsest.llm.labelled import remainder, training_rows

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 5) == 0
    model = x.train(training_rows(docs, labels, "toxic", ~held_out, x.SAMPLE_DOCS, x.SAMPLE_CHARS))
    scored = x.score_toxicity(docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending"
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.quality_rules import quality_rules

    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules(table(spark, sf_dir, "documents")).select(*columns)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.sentencepiece_table import encode

    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.secret_scan import secret_scan

    columns = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    return secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_pii,
        op3_line_dedup,
        op4_warc,
        op5_toxicity,
        op6_decontamination,
        op7_minhash_dedup,
        op8_quality_rules,
        op9_sentencepiece,
        op10_secret_scan,
    )
}


def _op8_sql() -> str:
    from palimpsest.llm.quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS

    tests = []
    for _, top, below, low, high in RULES:
        per = f" * greatest({below}, 1)" if below else ""
        tests += [f"{top} >= {low}{per}"] if low is not None else []
        tests += [f"{top} <= {high}{per}"] if high is not None else []
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    space = r"\x20\x09-\x0D"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rn, doc_id, t, regexp_extract_all(t, '[^{space}]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS ls FROM d),
i AS (SELECT rn, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT rn, i, count(*) OVER (PARTITION BY rn, ws[i], ws[i + 1], ws[i + 2]) AS c FROM i),
r AS (SELECT rn, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) AS o(k) WHERE c > 1 GROUP BY rn),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
             len(ls) AS n_lines,
             length(regexp_replace(t, '[^!]+', '', 'g')) AS n_bangs,
             len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
             len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\t]*[-*•]'))) AS n_bullet_lines,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\t\r]*$'))) AS n_ellipsis_lines
      FROM w LEFT JOIN r ON w.rn = r.rn),
b AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(tests)} AS kept
FROM b"""


def _op3_sql() -> str:
    from palimpsest.llm.line_dedup import MIN_SITES

    space = r" \t\n\x0b\x0c\r"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(source, '') AS site, text,
                  string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT rn, site, unnest(range(1, len(ls) + 1)) AS i, ls FROM d),
l AS (SELECT rn, site, i, regexp_replace(ls[i], '^[{space}]+|[{space}]+$', '', 'g') AS x FROM u),
w AS (SELECT x FROM l WHERE x <> '' GROUP BY x HAVING count(DISTINCT site) >= {MIN_SITES}),
h AS (SELECT rn, list(i) AS wide FROM l WHERE x IN (SELECT x FROM w) GROUP BY rn),
n AS (SELECT rn, count(*) AS n_lines FROM l WHERE x <> '' GROUP BY rn),
j AS (SELECT d.doc_id, d.text, d.ls, coalesce(n.n_lines, 0) AS n_lines, h.wide,
             h.wide IS NOT NULL AND len(h.wide) < n.n_lines AS c
      FROM d LEFT JOIN h ON d.rn = h.rn LEFT JOIN n ON d.rn = n.rn)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(coalesce(len(wide), 0) AS BIGINT) AS n_wide_lines,
       CAST(CASE WHEN c THEN len(wide) ELSE 0 END AS BIGINT) AS n_removed,
       CASE WHEN c THEN array_to_string(list_filter(ls, lambda x, i: NOT list_contains(wide, i)), chr(10)) ELSE text END AS text
FROM j"""


_OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM f"""


def oracles() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op4_warc": _OP4_SQL, "op3_line_dedup": _op3_sql(), "op8_quality_rules": _op8_sql()}
