"""Connected components of a link table, by repeated star contraction on Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rounds after which something must be wrong: each round at least halves the longest path to a component's root.
MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of each node of ``links`` (a, b), which are undirected.

    Each round points every node to the smallest of its neighbours (large star), then every larger neighbour to the
    smallest of the smaller ones (small star), until no link changes; all that remains is a star around each root. Sums
    and minima are pre-aggregated map-side, and the joins are between written tables, so that adaptive execution can
    split the partition of a node with very many links. Nothing is collected but two counters a round."""
    edges = written(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        # large star: every neighbour above a node is linked to the smallest node of that node's neighbourhood
        least = written(
            edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"))).groupBy("node").agg(F.least("node", F.min("other")).alias("least")),
            "least",
        )
        up = edges.join(least, edges["lo"] == least["node"]).select("hi", F.col("least").alias("lo"))
        large = written(up.filter("hi <> lo").distinct(), "large")
        # small star: every node below another is linked to the smallest of those below it
        low = written(large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least")), "low")
        down = large.join(low, large["hi"] == low["node"]).select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")), F.struct(F.col("hi"), F.col("least").alias("lo")))).alias("e")).select("e.*")
        edges = written(down.filter("hi <> lo").distinct(), "links")
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
