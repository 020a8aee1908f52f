"""Connected components of a graph of links, without a driver-side step over nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.staging import staged


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach, for every node with a link.

    Alternates two steps until nothing changes: each node sends its larger
    neighbours to its smallest one, then its smaller-or-equal ones.  Links only
    shrink towards stars, so rounds grow with the logarithm of the graph, and a
    node with many links is grouped by minima and joins that Spark can split.
    Every round is a written table, so a lost executor costs one round at most.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(edges.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("x")).select("n", F.least("n", "x").alias("least"))
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("hi"), F.col("least").alias("lo")).where("hi <> lo").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = (
            large.join(down, "hi").where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
            .unionByName(down.select("hi", F.col("least").alias("lo")))
            .distinct()
        )
        edges = staged(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components have not settled")
    stars = edges.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "node")
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
