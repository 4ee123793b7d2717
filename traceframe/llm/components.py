"""Connected components of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.llm.common import stored


def _star(both: DataFrame) -> DataFrame:
    """(n, least) for each node: the least of its neighbours and itself; ``both`` is (u, v)."""
    return both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the least node reachable.

    Each round replaces the links by stars around smaller nodes and keeps connectivity; rounds grow
    with the logarithm of the longest path. Every round is written to the shared folder, and
    only a count and a checksum of it reach the driver. Links with a null end or to itself are ignored.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def tidy(df: DataFrame) -> DataFrame:
        return df.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = stored(tidy(links), "links")
    before, seen = None, state(now)
    while seen != before and seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # Large star: every larger neighbour goes to the least of the neighbourhood.
        large = both.join(_star(both), "u").where("v > u").select(F.col("v").alias("a"), F.col("least").alias("b"))
        large = tidy(large)
        # Small star: every node and its smaller neighbours go to the least of those.
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("least"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("least").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("least").alias("b"))
        )
        now = stored(tidy(small), "links")
        before, seen = seen, state(now)
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
