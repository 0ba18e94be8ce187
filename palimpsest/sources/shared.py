"""Tables on the way, in the folder that driver and executors share: they cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a
    folder of this machine if all of Spark runs in this process, as in tests; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class _Made(threading.local):
    """Paths of the tables that written() has made in this thread and nobody has deleted yet."""

    def __init__(self):
        self.paths: list[str] = []


_MADE = _Made()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again.

    Steps delete with discard() what nothing reads any more. What a lazy result still reads stays
    until whoever uses that result calls sweep(), or the folder is emptied."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(df: DataFrame | None) -> None:
    """Delete a table of written() that no later step reads."""
    path = getattr(df, "table_path", None)
    if path in _MADE.paths:
        _MADE.paths.remove(path)
        _delete(df.sparkSession, path)


def made_so_far() -> list[str]:
    return list(_MADE.paths)


def sweep(spark: SparkSession, keep: list[str]) -> None:
    """Delete the tables of this thread that are not among `keep`: no result may read them."""
    for path in [x for x in _MADE.paths if x not in keep]:
        _MADE.paths.remove(path)
        _delete(spark, path)
