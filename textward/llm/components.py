"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component): each id of `links` (columns a, b) with the smallest id that it can reach.

    Rounds of large-star and small-star: links are hung on the smallest
    neighbour until nothing moves, in a number of rounds that grows with the
    logarithm of the longest path.  Minima are formed before the shuffle, and the joins are such as Spark
    can split where an id has many links.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = fingerprint(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b"), F.col("m"))
        edges = staged(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                       .unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = fingerprint(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    own = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(own)


def fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())
