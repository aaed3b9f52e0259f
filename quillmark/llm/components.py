"""Connected components by alternating stars, as joins and aggregations.

Each round makes every node point at the smallest node it knows of; the tables of a round
are written to shared storage. Only two sums a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_place, removed, written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs to (node, component) for every node of an edge; component is
    the smallest node reachable. Self-links, repeated links and either direction are fine;
    links with a null are left out. No links give no rows.

    The smallest neighbour of a node is aggregated before the shuffle; joining it back to a
    node of very many links is a plain join, which adaptive execution splits.
    """
    spark = edges.sparkSession
    current = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    place = new_place(spark, "links")
    current = written(current.distinct(), "links", place)
    before = None
    while True:  # stars grow every round, so a logarithm of the nodes bounds the rounds
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(smallest, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(smallest.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        following = new_place(spark, "links")
        nxt = written(small, "links", following)
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        removed(spark, place)
        current, place = nxt, following
        if now == before:
            break
        before = now
    roots = current.select("b").distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select(F.col("b"), F.col("b")))
