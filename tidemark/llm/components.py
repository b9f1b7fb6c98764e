"""Connected components of a link table by alternating large-star and small-star steps, all in DataFrames.

Each step takes every node's smallest neighbour (pre-aggregated before its shuffle) and joins it back, so a hub's links
are split like any skewed join; nothing goes to the driver but one row of totals a round. Each round's links are
written to the shared folder. The rounds needed grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _totals(e: DataFrame):
    # Wrapping sums of hashes; decimal, so that ANSI mode has nothing to overflow.
    return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "links") -> DataFrame:
    """(node, component) for every node that has a link; component is its smallest reachable node. Loops and repeats
    are allowed; null ends are left out. Empty table: empty result."""
    e = links.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"), (F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).alias("ok"))
    e = written(e.where("ok").select("a", "b").distinct(), name)
    before = _totals(e)
    while before[0]:
        # Large star: every larger neighbour of u is linked to the least of u and its neighbours.
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: the smaller neighbours of u, and u, are linked to the least of them.
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, large.a == least.u).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = written(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), name)
        after = _totals(new)
        drop_written(e)
        e = new
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
