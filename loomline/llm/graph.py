"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.shared import checkpointed, few, sweep


def _least(pairs: DataFrame) -> DataFrame:
    """(v, m): for each v the least of itself and its neighbours."""
    return pairs.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of `edges` (a, b, both long): the least node that is reachable.

    Each round hangs nodes on lesser ones: first the greater neighbours of each node (large star), then the lesser (small star),
    until nothing changes; rounds grow with the logarithm of the longest path. Minima are taken on the map side first, and
    adaptive execution splits the joins of nodes with many neighbours.
    """
    now = checkpointed(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    seen = None
    now = few(now, now.count())
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = both.join(_least(both), "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u <> v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*").filter("u <> v").distinct()
        # No more rows than before, as each node keeps one edge to a lesser one.
        now = checkpointed(small if seen is None else few(small, 2 * seen[0]))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        sweep(edges.sparkSession)
    roots = now.select("u").distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("component")))
