"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchwise.session import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link to another.

    Each step keeps the same components with shallower links; after a few steps every node hangs on its smallest one.
    A hub's links are many rows against one row of its minimum, which Spark can split. Steps are written tables.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = stored(links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u <> v").distinct(), "links")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))
        small = (
            large.join(down, "u")
            .select(F.explode(pair).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        edges = stored(small, "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 30))).first())
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now
