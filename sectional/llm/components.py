"""Connected components of a link table, by alternating large-star and small-star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` (its smallest node) for every node of the links ``a, b`` (no nulls); nodes alone have no row.

    Each node ends with one edge to its component's smallest node. A round is two joins on tables with a row per link;
    the number of rounds grows with the logarithm of the longest path. Only counts and a sum reach the driver.
    """
    edges = stage(edges.where("a <> b").select("a", "b").distinct(), name)
    before = None
    while True:
        edges = stage(_small_star(_large_star(edges)), name)
        now = edges.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if before == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
