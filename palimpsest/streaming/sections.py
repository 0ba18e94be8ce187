"""Sectioning of documents as they arrive: an extension, as the batch operators are stateless.

`md_sections` and `line_table` work inside a row, so they run on a stream as they are. Counts of
arrivals use a watermark on the arrival time and so keep bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.sections import md_sections


def section_stream(docs: DataFrame, doc_id: str) -> DataFrame:
    """Sections of a stream of (doc_id, text)."""
    return md_sections(docs, doc_id)


def level_counts(docs: DataFrame, doc_id: str, arrived: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sections by level and arrival window; documents later than `late` are left out."""
    timed = docs.withWatermark(arrived, late).select(F.struct(F.col(doc_id), F.col(arrived)).alias("key"), "text")
    sections = md_sections(timed, "key").select(F.col(f"key.{arrived}").alias(arrived), "level")
    return sections.groupBy(F.window(arrived, window).alias("window"), "level").agg(F.count("*").alias("n"))


def read_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)
