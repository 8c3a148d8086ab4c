"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a group-by-minimum and a join, written to the shared folder; nothing is
collected but whether a step is needed.  The number of steps grows with the
logarithm of the longest path; stars need none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teebox.llm import scratch


def _stars(e: DataFrame) -> bool:
    """Whether every node of the distinct edges (u, v), u > v, is the u of one edge, or the v of any and the u of none."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node of its component."""
    e = scratch.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        n = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = n.groupBy("u").agg(F.min("v").alias("m"))
        n = n.join(low, "u")
        n = n.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(n.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        n = scratch.written(n, "edges")
        scratch.remove(e)
        e = n
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
