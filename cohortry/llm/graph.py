"""Connected components of a graph that is never gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, heavy_keys, saved, spread_join


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``label`` for each node of an edge: ``label`` is the smallest node that can be reached.

    Alternates large-star and small-star steps until the edges are stars around the smallest nodes: until every node
    with a smaller neighbour has no other neighbour. A step moves each edge a constant number of times, and each is
    written to the shared folder. Loops and repeated edges change nothing; null ends are ignored; no edges give no
    rows.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    loops = saved(now.where("u = v").select("u").distinct())
    now = saved(now.where("u > v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("degree")))
        if not least.agg(F.max(F.expr("m < u and degree > 1"))).first()[0]:
            discard(least)
            break
        large = spread_join(both, least, ["u"], heavy_keys(least, ["u"], "degree"), ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = saved(large)
        low = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")))
        small = spread_join(large, low, ["u"], heavy_keys(low, ["u"], "degree"), ["v"]).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(now, least, large, low)
        now = after
    found = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    tops = now.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    alone = loops.select(F.col("u").alias("node")).withColumn("label", F.col("node"))
    stars = found.unionByName(tops)
    return stars.unionByName(alone.join(stars, "node", "left_anti"))
