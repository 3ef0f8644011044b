"""Connected components of a table of links, by large-star and small-star.

Links stay a distributed table: every round is two shuffles of at most the
links there are, staged in the shared checkpoint folder.  Each round needs
the smallest neighbour of a node only (a partial aggregate), joined back to
the node's links.  The smallest neighbours are staged first, so both sides of
that join have a shuffle of their own and Spark can split the partition of a
node that has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import staged


def connected(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs -> (node, root): the smallest node reachable.

    Nodes without a link to another node are left out.  Repeated links,
    loops and both directions are allowed; no links give no rows."""
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                   .distinct())
    before = None
    while True:
        # Large star: each neighbour above a node links to the node's smallest neighbour.
        both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = staged(both.where("v > u").join(low, "u")
                       .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        # Small star: a node's smaller neighbours and itself link to the smallest of them.
        least = staged(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = (large.join(least, "hi").select(F.explode(F.array(
            F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
            F.struct("hi", F.col("m").alias("lo")))).alias("e"))
            .select("e.*").where("hi <> lo").distinct())
        edges = staged(small)
        # Each round keeps or lowers every node's link; equal sums of both ends mean no change.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.col("lo").cast("decimal(38,0)")),
                        F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now
