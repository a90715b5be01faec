"""Connected components of a table of links, by alternating stars.

Every node points its larger neighbours at the smallest node it knows, then its smaller
ones; after a number of rounds that grows with the logarithm of the longest path all nodes
of a component point at its smallest.  Minima are taken with partial sums, and each round
is written to the shared folder, so that no plan grows and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` point from larger to smaller nodes."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    turned = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b")
    return turned.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes but the smallest of each component.

    ``links`` has columns a and b; order, repetition and links of a node to itself do not
    matter.
    """
    scratch = Scratch()
    before = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = None
    while True:
        after = scratch.table(_small_star(_large_star(before)), "links")
        if state is not None:
            scratch.drop(before)
        found = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            return after.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before, state = after, found
