"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins over the remaining links, written to the
shared folder; the links end as stars around the smallest node of each component. Only
two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentry.session import discard, materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least, "a")
    return joined.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` point from the larger node a to the smaller node b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0))).first())


def component_roots(links: DataFrame) -> DataFrame:
    """Links (a, b) of longs in any order, repeats allowed -> (node, root), root the smallest node reachable.

    Nodes without links are absent. An empty table gives an empty table; self-links are ignored.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = materialize(pairs.distinct(), "links")
    state = _state(current)
    while state[0]:
        following = materialize(_small_star(_large_star(current)), "links")
        reached = _state(following)
        discard(current)
        current = following
        if reached == state:
            break
        state = reached
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
