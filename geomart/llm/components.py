"""Connected components over an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_unique


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node, root: the smallest node reachable over edges (u, v), for every node that has one.

    Each round hangs every node's larger neighbours, then its smaller ones, under the smallest; the rounds end when the
    edges stay the same and form stars, after a number that grows with the logarithm of the longest path. A node with
    very many neighbours is joined without a shuffle of these.
    """
    e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = (e.count(),)
    for _ in range(limit):
        below = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = cut(join_unique(e, below, ["v"], "left", rows=mark[0]).select("u", F.coalesce("m", "v").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_unique(large, least, ["u"], rows=mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small, "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {limit} rounds")
