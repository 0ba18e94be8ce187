"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage gets the documents that its predecessor kept, read again from Parquet, and its decisions
take effect: documents that the rules reject go, widespread lines are cut from the texts, one
document of each near-duplicate class stays, documents that hold a benchmark passage go, and what is
left is encoded. The last stage gives the tokens; the others give the columns of documents.

SQL cannot express the signatures, the alignment and the tokenizer, so ORACLE_SQL is None and the
pipeline is tested against a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import table, written
from palimpsest.llm.decontaminate import decontaminated
from palimpsest.llm.line_dedup import remove_wide_lines
from palimpsest.llm.near_dedup import one_of_each
from palimpsest.llm.quality_rules import quality_rules
from palimpsest.llm.sentencepiece_table import encode


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs).filter("kept").select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = remove_wide_lines(docs).select(docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, ids=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece", token_stage),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
