"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.session import cut_lineage


def _to_min(rows: DataFrame, up: bool) -> DataFrame:
    """Links of every node u to v, turned into links to the smallest node around u; a hot u is one value per task."""
    low = rows.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).hint("rebalance")
    out = rows.join(low, "u")
    if up:  # large star: only larger neighbours move
        return out.where("v > u and v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    moved = out.where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.where("u > m").select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame, a="a", b="b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge to another.

    Rounds go on until every node hangs on one node that hangs on none, which is checked exactly;
    their number grows with the logarithm of the longest path.
    """
    edges = cut_lineage(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct())
    while True:
        roles = edges.groupBy(F.col("a").alias("n")).agg(F.count("*").alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).cast("long").alias("up"), F.lit(1).alias("down")))
        if roles.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _to_min(both, True).distinct()
        edges = cut_lineage(_to_min(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False).distinct())
