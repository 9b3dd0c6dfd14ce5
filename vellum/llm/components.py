"""Connected components of a graph of long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import stage


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of each node of ``edges(a, b)``; root is the smallest node of its component.

    Every round hangs each node's larger neighbours, then its smaller ones, on the least of them: minima by partial
    aggregation, so a node with very many neighbours is no hot group. Rounds are logarithmic in the longest
    path; each is written to the shared folder. Loops and repeated edges don't matter; no edge, no row.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return nodes.join(now.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("root"))
