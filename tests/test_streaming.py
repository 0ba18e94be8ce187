"""Sections of a stream equal those of a batch."""

from datetime import datetime

from palimpsest.operators.sections import md_sections
from palimpsest.streaming.sections import level_counts, read_folder, section_stream


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"intro\n# A{i}\nx\n## B\ny", datetime(2024, 1, 1, 0, i)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc long, text string, at timestamp")
    docs.write.parquet(str(tmp_path / "in"))
    stream = read_folder(spark, str(tmp_path / "in"), "doc long, text string, at timestamp")
    q = section_stream(stream, "doc").writeStream.format("memory").queryName("secs").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("secs").collect())) == sorted(map(tuple, md_sections(docs, "doc").collect()))
    q = level_counts(stream, "doc", "at").writeStream.outputMode("complete").format("memory").queryName("lv").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.level, r.n) for r in spark.table("lv").collect()) == [(0, 10), (0, 10), (1, 10), (1, 10), (2, 10), (2, 10)]
