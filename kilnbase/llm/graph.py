"""Connected components by Spark joins, for link tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def hung(rows: DataFrame, least: DataFrame) -> DataFrame:
    """Each of `rows` (u, v) with the node m that `least` (u, m) names for u: v, m.

    `least` must be a written table: both sides of the join are then plain exchanges, which adaptive execution splits where
    one node holds a large share of the rows. Joined with the aggregate itself they could not be split.
    """
    return rows.join(least, "u").select("v", "m")


def components(links: DataFrame) -> DataFrame:
    """Each node of the undirected links (a, b) with the smallest node it reaches: node, component.

    Alternates large-star and small-star steps: every node hangs its larger (then its smaller)
    neighbours on the smallest neighbour it knows, until the links are stars. The smallest neighbour
    is an aggregate, written, and the rest a join on the node that can be split, so no node's neighbours are ever gathered in
    one row or one task. Rounds grow with the logarithm of the longest path. Each step is a table in the
    shared folder, deleted when the next is there. Self links and repeated links do no harm.
    """
    spark = links.sparkSession

    def step(df: DataFrame, *done: DataFrame) -> DataFrame:
        out = common.written(df, "links")
        for table in done:
            common.discard(spark, table)
        return out

    edges = step(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = step(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = step(hung(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), edges, least)
        # small star: every node and its smaller neighbours point to the smallest of them
        low = step(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            hung(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        )
        edges = step(small, large, low)
        # stars: a node that points points once, and none points to it
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("points")).unionAll(edges.select("v", F.lit(0)))
        seen = ends.groupBy("node").agg(F.sum("points").alias("out"), F.min("points").alias("least"))
        if seen.where("out > 1 or (out = 1 and least = 0)").isEmpty():
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
