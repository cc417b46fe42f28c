"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a grouped minimum (combined before the shuffle) and one join; every
state is a written table, so no step is recomputed when an executor is lost, and no
links reach the driver: only a row count and a checksum do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def connected_components(edges: DataFrame, a: str, b: str, name: str = "cc") -> DataFrame:
    """edges: an undirected edge per row (long columns a and b; nulls and loops are ignored).

    Returns (node, component): every node of an edge with the smallest node reachable
    from it. No edges: no rows. The number of rounds grows with the logarithm of the
    longest path.
    """
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), name)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = written(both.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low")
        low = lowest.withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, f"{name}-large")
        forget(lowest, now)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        forget(low, large)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._table_path = now._table_path
    return out
