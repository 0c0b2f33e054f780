"""Connected components of an edge table, by alternating large and small stars.

Every step is a minimum per node and a join, so no node's neighbours are gathered; each step is written to the
shared folder.  The number of steps grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of all nodes of ``edges`` (a, b).  A node without an
    edge to another one is not listed; repeated edges and loops do no harm."""
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = stored(small, "edges")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
