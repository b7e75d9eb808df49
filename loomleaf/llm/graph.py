"""Connected components of a large graph, by alternating star steps on tables.

Each round points every node's larger neighbours to its smallest one and then
every node to the smallest neighbour of its neighbours; edges shrink to stars.
Every step reads a table in the shared folder and writes the next, so a lost
executor costs one step, and only whether all are stars comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, release, small


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that isn't the smallest of its component.

    ``edges`` holds pairs in either direction, repeats and loops allowed, nulls
    ignored.  The result is a materialised table; an empty one gives an empty one.
    """
    big, low = F.greatest(a, b), F.least(a, b)
    pairs = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialise(pairs.select(big.alias("x"), low.alias("y")).distinct())
    while not _stars(now):
        # Small star: the smaller neighbours of x, and x, go to the smallest of them.
        least = materialise(now.groupBy("x").agg(F.min("y").alias("m")))
        hop = now.join(small(least), "x").filter("y != m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        mid = materialise(hop.union(least.select("x", F.col("m").alias("y"))).distinct())
        release(now, least)
        # Large star: what points to y points to the smallest neighbour of y instead.
        least = materialise(mid.groupBy("x").agg(F.min("y").alias("m")))
        up = small(least.select(F.col("x").alias("y"), "m"))
        now = materialise(mid.join(up, "y", "left").select("x", F.coalesce("m", "y").alias("y")).distinct())
        release(mid, least)
    out = now.select(F.col("x").alias("node"), F.col("y").alias("root"))
    out._loomleaf_path = now._loomleaf_path
    return out


def _stars(pairs: DataFrame) -> bool:
    """Whether every x points to one y only, and to none that points on itself."""
    ends = pairs.select(F.col("x").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(pairs.select("y", F.lit(0), F.lit(1)))
    sums = ends.groupBy("n").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return sums.filter("out > 1 or out > 0 and into > 0").isEmpty()
