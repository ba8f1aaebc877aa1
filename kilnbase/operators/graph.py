"""Iterated joins over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnbase.sources.scratch import shared_path


def page_rank(links: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """`links` (src, dst), each once: node and rank, which begins at 1 and sums to the number of nodes where none is a dead end.

    A round is one join of ranks with links and one sum by target, combined before the shuffle, so a target that
    very many link to is no hot group. Ranks are written to the shared folder between rounds: lineage stays short and a lost
    executor costs one round. Nodes without incoming links keep 1 - damping.
    """
    spark = links.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        path = shared_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    out = links.groupBy("src").agg(F.count("*").alias("out"))
    links = written(links.join(out, "src"), "rank-links")
    nodes = written(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct(), "rank-nodes")
    ranks = nodes.withColumn("rank", F.lit(1.0))
    for _ in range(rounds):
        sent = links.join(ranks, links.src == ranks.node).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("sum"))
        after = nodes.join(sent, nodes.node == sent.dst, "left").select("node", (F.lit(1 - damping) + F.lit(damping) * F.coalesce("sum", F.lit(0.0))).alias("rank"))
        ranks = written(after, "ranks")
    return ranks
