"""Connected components of an edge table by alternating star contraction, staged each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, narrow, stage


def _least(edges: DataFrame) -> DataFrame:
    """u and the least of u and its neighbours, pre-aggregated before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _print(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and root for each node of edges (u, v); the root is the least node of its component.

    Large-star links each node's greater neighbours to its least one, small-star the others; both
    keep the edges linear in number. Skewed nodes are split by AQE, as all joins are inner ones. It ends
    once large-star changes nothing and every node has one edge at most, the least of its component.
    """
    now = stage(narrow(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), edges.count()), "edges")
    seen = _print(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = stage(narrow(narrow(large, 2 * seen[0]).distinct(), seen[0]), "large-star")
        # stars, where each node but the roots has one edge, are what small-star leaves as it is
        if _print(large) == seen and large.select("u").distinct().count() == seen[0]:
            discard(large)
            break
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        after = stage(narrow(narrow(small, 2 * seen[0]).distinct(), seen[0]), "small-star")
        discard(now, large)
        now, seen = after, _print(after)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
