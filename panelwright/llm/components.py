"""Connected components of an edge table by alternating large and small stars.

Every step is a grouped minimum and a join, so a node with very many edges is no task's burden;
each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _nearest_minimum(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): adds m, the smallest of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of whole numbers.  Returns (node, component), component being the smallest
    node that can be reached; nodes without an edge are not listed.  Edges with a null end and
    loops are left out; repeated edges count once."""
    now = stored(edges.dropna().where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _nearest_minimum(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            # each node now hangs on its component's smallest
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = seen
