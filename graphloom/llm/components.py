"""Connected components of a link table by alternating large and small stars.

Each round points every node at the least node it knows of; the table shrinks to one link from
each node to the least of its component in a number of rounds that grows with the logarithm of a
component's diameter. Least nodes are found by partial sums before the shuffle, so a node with
very many links is no hot spot, and each round's table is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of all nodes in links(a, b) that aren't the least of theirs."""
    links, before = written(links.filter("a <> b").select("a", "b").distinct()), None
    while True:
        links = written(_small(_large(links)).filter("a <> b").distinct())
        now = links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
