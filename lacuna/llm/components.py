"""Connected components of an edge table by alternating large-star and small-star steps, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _digest(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) to (u, root): for each node with an edge, the smallest node reachable; the root itself is not listed.

    Each step reduces to the minimum per node, which is combined before the shuffle, then joins it back, a join that adaptive execution splits where
    one node is hot. Every step is written to the shared folder, so lineage stays short and the loop survives lost executors. Edges from a node to itself are ignored; no edges give no rows.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        last, now, before = now, materialize(small, "edges"), seen
        discard(large)
        discard(last)
        seen = _digest(now)
        if seen == before:
            break
    return now.select("u", F.col("v").alias("root"))
