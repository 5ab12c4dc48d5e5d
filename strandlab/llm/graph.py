"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm.common import discard, staged


def _settled(edges: DataFrame) -> bool:
    """Is each node linked to one root, and no root linked on?"""
    links = edges.groupBy("u").agg(F.count("*").alias("n"))
    roots = edges.select(F.col("v").alias("u")).distinct().withColumn("root", F.lit(True))
    return links.join(roots, "u", "left").where("n > 1 or root").isEmpty()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u long, v long); root is the component's smallest node.

    Each step is one aggregation (combined before the shuffle) and one join on the node, whose hot keys AQE splits;
    every step is written to the shared folder, and nothing but whether it was the last one comes to the driver.  Nodes
    without an edge to another node are not returned.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for step in range(most + 1):
        if _settled(now):
            break
        if step == most:
            raise RuntimeError("the components didn't settle")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))  # edges point to the smaller node already
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = staged(small, "small")
        discard(large, now)
        now = small
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
