"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, meet, written


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges (u, v) with u > v."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours are led to the least of its neighbourhood. A hub may have a
    great share of all edges, so its rows aren't brought together."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("often")), "least")
    return meet(both, least, ["u"], "often").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    )


def _settled(edges: DataFrame) -> bool:
    """True if all edges lead to the least node of their component: each node has one edge and no
    target has an edge of its own. Only counts reach the driver."""
    n, sources = edges.agg(F.count("*"), F.count_distinct("u")).first()
    return n == sources and edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Of edges (u, v), a row (node, component) for each node but the least of its component, which
    names it. Each step writes its edges to the shared folder. Null ends are left out."""
    now = written(_oriented(edges), "edges")
    while not _settled(now):
        old, now = now, written(_oriented(_small_star(_oriented(_large_star(now)))), "edges")
        discard(old)
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out.table_path = now.table_path
    return out
