"""Connected components of an edge table by alternating large and small stars; only minima are shuffled to a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node it is linked to) for every node of the columns a and b.

    Repeated edges and loops change nothing; edges with a null end are left out. Raises if rounds are used up.
    """
    star = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    star = stored(star, "stars")
    nodes = star.select(F.col("a").alias("node")).union(star.select("b")).distinct()
    last = None
    for _ in range(rounds):
        both = star.select("a", "b").union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the grouped side is written before it is joined, so that a hub's links have an exchange of their own, which adaptive execution can split
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))  # after this step a node has few smaller neighbours left
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        star = stored(small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return nodes.join(star.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        last = now
    raise RuntimeError("the components did not settle")
