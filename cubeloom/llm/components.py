"""Connected components of a link table, by alternating star contraction.

Large-star steps link every larger neighbour of a node to the smallest node it
knows, small-star steps link a node and its smaller neighbours to the smallest
of them; both are a partial aggregation and a join, so no neighbourhood is ever
gathered.  Components become stars around their smallest node in a number of
rounds that grows with the logarithm of their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    return both.join(least, "a").filter("b > a and b != least").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` of all nodes of *edges* (``a, b``, different numbers) but each component's smallest.

    The result is the table ``components`` of *scratch*, in place of one from a call before.
    """
    now = scratch.write(edges.select("a", "b").filter("a != b").distinct(), "components-round")
    before = None
    while True:
        now = scratch.replace(_small_star(_large_star(now)), "components-round")
        # Stars around the smallest nodes don't change any more: equal sums of both columns and equal counts tell it.
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == before or found[0] == 0:
            stars = scratch.replace(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
            scratch.drop("components-round")
            return stars
        before = found
